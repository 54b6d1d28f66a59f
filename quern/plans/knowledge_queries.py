"""Supersession, audit trails, caches, scoring, gates and snapshots."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import documents as D
from ..operators import knowledge as K
from .registry import query

R = lambda c, n=6: F.round(c, n)
OLD = "e AS (SELECT p_partkey AS old, p_partkey // 2 AS new FROM part WHERE p_partkey >= 16)"


def supersedes(t):
    return t.part.where("p_partkey >= 16").selectExpr("p_partkey AS old", "p_partkey div 2 AS new")


@query("kno_supersession_chains", f"""WITH RECURSIVE {OLD}, c AS (SELECT old AS start, new AS node, 1 AS hops FROM e UNION SELECT c.start, e.new, c.hops + 1 FROM c JOIN e ON e.old = c.node WHERE c.hops < 20),
  z AS (SELECT *, row_number() OVER (PARTITION BY start ORDER BY hops DESC, node) AS r FROM c WHERE node NOT IN (SELECT old FROM e)) SELECT start, node AS latest, hops FROM z WHERE r = 1""")
def kno_chains(t):
    return K.supersession_chains(supersedes(t))


@query("kno_audit_trail", "SELECT s_suppkey, coalesce(n, 0) AS n_citations, CASE WHEN s_acctbal < 0 THEN 'REJECT_SUPERSEDED' WHEN coalesce(n, 0) >= 600 THEN 'ACCEPT_CITED' ELSE 'ACCEPT' END AS decision FROM supplier LEFT JOIN (SELECT l_suppkey, count(*) AS n FROM lineitem GROUP BY 1) ON l_suppkey = s_suppkey")
def kno_audit(t):
    s = t.supplier.select("s_suppkey")
    return K.audit_trail(s, t.supplier.where("s_acctbal < 0"), t.lineitem.select(F.col("l_suppkey").alias("s_suppkey")), "s_suppkey", 600)


@query("kno_embedding_quality", "WITH c AS (SELECT CASE WHEN a.vec_id = b.vec_id THEN 0 ELSE list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) END AS c FROM embeddings a, embeddings b) SELECT (SELECT count(*) FROM embeddings) AS n, round(avg(c), 5) AS mean, round(stddev_pop(c), 5) AS std FROM c")
def kno_embedding(t):
    out = K.embedding_quality(t.embeddings, "vec_id", "embedding")
    return out.select("n", R(F.col("mean"), 5).alias("mean"), R(F.col("std"), 5).alias("std"))


@query("kno_semantic_cache", "SELECT a.vec_id AS query, arg_max(b.vec_id, list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[])) AS cached FROM embeddings a, embeddings b WHERE a.vec_id % 50 = 0 AND b.vec_id % 50 <> 0 AND b.vec_id % 2 = 0 AND list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) >= 0.2 GROUP BY 1")
def kno_cache(t):
    cache = t.embeddings.where("vec_id % 50 <> 0").select(F.col("vec_id").alias("id"), "embedding", (F.col("vec_id") % 2).alias("x")).withColumn("expires", 1 - F.col("x"))
    q = t.embeddings.where("vec_id % 50 = 0").select(F.col("vec_id").alias("id"), "embedding")
    return K.cached_answers(q, cache, "embedding", 0.2, F.lit(0)).select("query", "cached")


@query("kno_adapted_weights")
def kno_weights(t):
    f = t.events.select("user_id", "event_id", F.array(F.col("value") / 100, 1 - F.col("value") / 100).alias("s"), (F.col("event_id") % 5 / 5).alias("r"))
    return K.adapted_weights(f, "user_id", "event_id", "s", "r", 2)


@query("kno_retrieval_modes", "SELECT p_partkey AS id, CASE WHEN p_size > 25 THEN 0.8 ELSE p_retailprice / 2000 END AS score, CASE WHEN p_size > 25 THEN 'graph' ELSE 'text' END AS source FROM part WHERE p_size > 25 OR p_retailprice > 1000")
def kno_modes(t):
    text = t.part.where("p_retailprice > 1000").select(F.lit(1).alias("query"), F.col("p_partkey").alias("id"), (F.col("p_retailprice") / 2000).alias("score"))
    graph = t.part.where("p_size > 25").select(F.lit(1).alias("query"), F.col("p_partkey").alias("id"))
    return K.retrieve("HYBRID_GRAPH_FIRST", text, graph).select("id", "score", "source")


@query("kno_qa_scores")
def kno_qa(t):
    c = t.conversations
    ask = c.where("role = 'user'").select("conv_id", "turn", F.col("text").alias("q"))
    say = c.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("a"))
    s = K.qa_scores(F.col("q"), F.col("a"), F.concat_ws(" ", "q", "a"))
    return ask.join(say, ["conv_id", "turn"]).select("conv_id", "turn", *[R(v).alias(k) for k, v in s.items()])


@query("kno_templated_questions", "SELECT p_partkey, q AS question FROM (SELECT p_partkey, unnest(['What is ' || p_name || '?', 'Describe ' || p_name || '.']) AS q FROM part)")
def kno_templates(t):
    return K.templated_questions(t.part.withColumn("x", F.col("p_name")), "p_partkey", "p_name", "x", ["What is {}?", "Describe {}."]).select("p_partkey", "question")


@query("kno_write_gate", """SELECT o_orderkey, o_orderkey % 2 = 0 AS accepted FROM orders""")
def kno_gate(t):
    refs = F.array(F.col("o_orderstatus"), F.col("o_orderpriority"))
    good = F.substring(F.sha2(F.to_json(F.array_sort(refs)), 256), 1, 8)
    w = t.orders.select("o_orderkey", refs.alias("refs"), F.when(F.col("o_orderkey") % 2 == 0, F.concat(good, F.lit("rest"))).otherwise("none").alias("proof"))
    return K.gated(w, "refs", "proof").select("o_orderkey", "accepted")


@query("kno_snapshots", "SELECT n_nationkey, true AS later, n_nationkey = 0 OR n_regionkey = lag(n_regionkey) OVER (ORDER BY n_nationkey) AS same_version, n_nationkey % 4 <> 1 AS sound FROM nation")
def kno_snapshots(t):
    n = t.nation.withColumn("digest", F.when(F.col("n_nationkey") % 4 == 1, "x").otherwise(F.sha2("n_name", 256)))
    return K.chain_of_snapshots(n, "n_nationkey", "n_regionkey", "n_name", "digest")


@query("kno_citations", "SELECT p_brand, rank, '[' || rank || '] ' || p_name || ', ' || p_type AS citation FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS rank FROM part) WHERE rank <= 3")
def kno_citations(t):
    from ..operators.windows import top_per

    hits = top_per(t.part, ["p_brand"], [F.desc("p_retailprice"), "p_partkey"], 5)
    return K.formatted_citations(hits, "p_brand", 3, "p_name", "p_type")


@query("kno_anchored_chunks")
def kno_anchored(t):
    c = D.chunk_fixed(t.documents.where("text IS NOT NULL"), "doc_id", "text", 400, 0)
    return K.anchored(c, "doc_id", "chunk", "text", "[Aa]rticle")


@query("kno_resolved_results")
def kno_resolved(t):
    results = t.part.select(F.lit(1).alias("query"), F.col("p_partkey").alias("id"), F.col("p_retailprice").alias("score"))
    return K.resolve_supersession(results, supersedes(t)).select("id", "score")


@query("kno_token_statistics", r"SELECT lang, round(avg(len(w)), 6) AS mean_words, max(len(w))::INT AS most_words FROM (SELECT lang, list_filter(string_split_regex(trim(text), '\s+'), lambda x: x <> '') AS w FROM documents WHERE text IS NOT NULL) GROUP BY 1")
def kno_tokens(t):
    d = t.documents.where("text IS NOT NULL").select("lang", F.size(T.words(F.col("text"))).alias("n"))
    return d.groupBy("lang").agg(R(F.avg("n")).alias("mean_words"), F.max("n").alias("most_words"))

