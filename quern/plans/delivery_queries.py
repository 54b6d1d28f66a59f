"""Queries over delivery: sources and sinks read back, outbox, ledgers, queues, labelling, evidence."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import delivery as D
from ..operators import governance as V
from ..shared import shared_dir
from ..sources import readers, writers
from .registry import query

R = lambda c, n=6: F.round(c, n)


def scratch(t) -> str:
    return f"{shared_dir(t.spark)}/{uuid.uuid4().hex}"


def customers(t) -> str:
    """The customers as JSON lines; every seventh line is cut short."""
    path = f"{scratch(t)}/customers.jsonl"
    whole = F.to_json(F.struct("c_custkey", "c_name"))
    t.customer.select(F.when(F.col("c_custkey") % 7 == 0, F.substring(whole, 1, 12)).otherwise(whole).alias("value")).write.text(path)
    return path


SHAPE = T.StructType([T.StructField("c_custkey", T.LongType()), T.StructField("c_name", T.StringType())])


@query("src_json_lines", "SELECT CASE WHEN c_custkey % 7 <> 0 THEN c_custkey END AS c_custkey, CASE WHEN c_custkey % 7 <> 0 THEN c_name END AS c_name, c_custkey % 7 = 0 AS corrupt FROM customer")
def src_json_lines(t):
    rows = readers.read_any(t.spark, customers(t), SHAPE)
    bad = F.col("_corrupt_record").isNotNull()
    return rows.select(F.when(~bad, F.col("c_custkey")).alias("c_custkey"), F.when(~bad, F.col("c_name")).alias("c_name"), bad.alias("corrupt"))


@query("src_load_status", "SELECT count(*) AS n, count(*) FILTER (c_custkey % 7 = 0) AS failed FROM customer")
def src_load_status(t):
    return readers.load_status(readers.read_json_lines(t.spark, customers(t), SHAPE)).agg(F.sum("n").alias("n"), F.sum("failed").alias("failed"))


@query("src_load_files", """SELECT c_nationkey AS nation, CASE WHEN count(*) FILTER (c_acctbal < -900) > 0 THEN 'FAILED' WHEN count(*) < 5 THEN 'SKIPPED' ELSE 'SUCCESS' END AS status,
    CASE WHEN count(*) FILTER (c_acctbal < -900) > 0 THEN 3 ELSE 1 END AS attempts FROM customer GROUP BY 1""")
def src_load_files(t):
    """A file of balances for each nation: very low ones make the loader fail, short files are not valid."""
    path = scratch(t)
    t.customer.select("c_nationkey", F.col("c_acctbal").cast("string").alias("value")).repartition("c_nationkey").write.partitionBy("c_nationkey").text(path)

    def load(raw: bytes) -> list[float]:
        values = [float(x) for x in raw.decode().split()]
        if min(values) < -900:
            raise ValueError("balance too low")
        return values

    got = readers.load_files(t.spark, path, "*.txt", load, lambda values: len(values) >= 5, attempts=3)
    return got.select(F.regexp_extract("path", "c_nationkey=([0-9]+)/", 1).cast("int").alias("nation"), "status", "attempts")


@query("src_lines", r"SELECT trim(line) AS line, count(*) AS n FROM (SELECT unnest(string_split(text, chr(10))) AS line FROM documents WHERE text IS NOT NULL AND NOT contains(text, chr(13))) WHERE trim(line) <> '' GROUP BY 1")
def src_lines(t):
    path = f"{scratch(t)}/lines"
    t.documents.where("text IS NOT NULL AND NOT contains(text, '\r')").select("text").write.text(path)
    return readers.read_lines(t.spark, path).groupBy("line").agg(F.count("*").alias("n"))


@query("src_discover", "SELECT c_mktsegment AS segment, (10 * count(*))::BIGINT AS bytes FROM customer GROUP BY 1")
def src_discover(t):
    """Text files of the customers, a folder for each segment, found by pattern and size among files of another kind;
    a line has ten bytes."""
    path = scratch(t)
    t.customer.select("c_mktsegment", F.lpad(F.col("c_custkey").cast("string"), 9, "0").alias("value")).write.partitionBy("c_mktsegment").text(f"{path}/text")
    t.customer.select("c_mktsegment", "c_name").write.partitionBy("c_mktsegment").json(f"{path}/other")
    found = readers.discover(t.spark, path, "*.txt", low=1)
    return found.groupBy(F.url_decode(F.regexp_extract("path", "/text/c_mktsegment=([^/]+)/", 1)).alias("segment")).agg(F.sum("size").alias("bytes"))


@query("src_csv", "SELECT p_partkey, p_name, p_retailprice FROM part")
def src_csv(t):
    path = f"{scratch(t)}/part.csv"
    rows = t.part.select("p_partkey", "p_name", "p_retailprice")
    rows.write.option("header", "true").csv(path)
    return readers.read_any(t.spark, path, rows.schema)


@query("src_record_graph", "SELECT src, dst, 'MENTIONS' AS type FROM (SELECT CAST(doc_id AS VARCHAR) AS src, unnest(list_distinct(regexp_extract_all(coalesce(text, ''), '[0-9]{4,}'))) AS dst FROM documents)")
def src_record_graph(t):
    """A graph built from JSON lines of documents."""
    path = f"{scratch(t)}/documents.jsonl"
    t.documents.select("doc_id", "text").write.json(path)
    rows = readers.read_json_lines(t.spark, path, T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType())]))
    return D.graph_of_records(rows, "doc_id", "text", "[0-9]{4,}")[1]


@query("snk_graph_json", "SELECT 'edge' AS kind, c_custkey || '>' || c_nationkey AS item FROM customer UNION ALL SELECT 'node', CAST(c_custkey AS VARCHAR) FROM customer")
def snk_graph_json(t):
    path = scratch(t)
    nodes, edges = t.customer.select(F.col("c_custkey").alias("id")), t.customer.select(F.col("c_custkey").alias("src"), F.col("c_nationkey").alias("dst"))
    writers.write_graph(nodes, edges, path)
    back = t.spark.read.schema("id long").json(f"{path}/nodes").select(F.lit("node").alias("kind"), F.col("id").cast("string").alias("item"))
    return back.unionByName(t.spark.read.schema("src long, dst long").json(f"{path}/edges").select(F.lit("edge").alias("kind"), F.concat_ws(">", "src", "dst").alias("item")))


@query("snk_graphml", """SELECT '<node id="' || n_name || '"/>' AS line FROM nation UNION ALL SELECT '<edge source="' || n_name || '" target="' || r_name || '"/>' FROM nation JOIN region ON n_regionkey = r_regionkey""")
def snk_graphml(t):
    edges = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_name").alias("src"), F.col("r_name").alias("dst"))
    return D.graphml(t.nation.select(F.col("n_name").alias("id")), edges)


@query("snk_splits", "SELECT CASE WHEN c_nationkey < 5 THEN 'test' ELSE 'train' END AS split, c_custkey FROM customer")
def snk_splits(t):
    path = scratch(t)
    rows = t.customer.select("c_custkey", F.when(F.col("c_nationkey") < 5, "test").otherwise("train").alias("split"))
    writers.write_splits(rows, path)
    return t.spark.read.schema("c_custkey long, split string").json(path).select("split", "c_custkey")


@query("snk_outbox", "SELECT doc_id AS job, doc_id % 4 AS chunk, adapter, CASE WHEN adapter = 'search' AND doc_id % 3 = 0 THEN 'SENT' ELSE 'PENDING' END AS status FROM documents, (VALUES ('search'), ('graph'), ('vectors')) a(adapter)")
def snk_outbox(t):
    items = t.documents.selectExpr("doc_id AS job", "doc_id % 4 AS chunk")
    return D.outbox(items, ["search", "graph", "vectors"], items.where("job % 3 = 0").withColumn("adapter", F.lit("search")))


@query("snk_ledger_append", """WITH RECURSIVE e AS (SELECT user_id, event_id, props AS body, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM events),
  h AS (SELECT user_id, CASE WHEN user_id % 2 = 0 THEN 100 ELSE 0 END AS head, CASE WHEN user_id % 2 = 0 THEN sha256(CAST(user_id AS VARCHAR)) ELSE repeat('0', 64) END AS hash FROM (SELECT DISTINCT user_id FROM events)),
  c AS (SELECT e.user_id, event_id, i, head + i AS seq, h.hash AS prev_hash, sha256(body || h.hash) AS hash FROM e JOIN h USING (user_id) WHERE i = 1
   UNION ALL SELECT e.user_id, e.event_id, e.i, c.seq + 1, c.hash, sha256(e.body || c.hash) FROM c JOIN e ON e.user_id = c.user_id AND e.i = c.i + 1)
  SELECT event_id, seq, prev_hash, hash FROM c""")
def snk_ledger_append(t):
    """Chains of half of the users go on from a stored head; the batch is appended and read back."""
    path = scratch(t)
    heads = t.events.where("user_id % 2 = 0").select("user_id").distinct().select("user_id", F.lit(100).alias("seq"), F.sha2(F.col("user_id").cast("string"), 256).alias("hash"))
    D.append_ledger(D.ledger_batch(t.events.select("user_id", "event_id", "props"), heads, "user_id", "event_id", "props"), path)
    return t.spark.read.schema("event_id long, seq long, prev_hash string, hash string").json(path)


@query("gov_merkle_proof", """WITH RECURSIVE l AS (SELECT row_number() OVER (ORDER BY h) - 1 AS i, h, 0 AS lev FROM (SELECT sha256(CAST(c_custkey AS VARCHAR)) AS h FROM customer)),
  t AS (SELECT lev, list(h ORDER BY i) AS hs FROM l GROUP BY lev UNION ALL SELECT lev + 1, list_transform(range(1, (len(hs) + 1) // 2 + 1), lambda k: sha256(hs[2 * k - 1] || coalesce(hs[2 * k], hs[2 * k - 1]))) FROM t WHERE len(hs) > 1),
  w AS (SELECT h, i FROM l WHERE h IN (SELECT sha256(CAST(c_custkey AS VARCHAR)) FROM customer WHERE c_custkey % 50 = 0))
  SELECT h, lev AS level, coalesce(hs[CASE WHEN (i >> lev) % 2 = 0 THEN (i >> lev) + 2 ELSE (i >> lev) END], hs[(i >> lev) + 1]) AS sibling, CASE WHEN (i >> lev) % 2 = 0 THEN 'right' ELSE 'left' END AS side FROM w, t WHERE len(hs) > 1""")
def gov_merkle_proof(t):
    leaves = t.customer.select("c_custkey", F.sha2(F.col("c_custkey").cast("string"), 256).alias("h"))
    return V.merkle_proofs(leaves, "h", leaves.where("c_custkey % 50 = 0"))


@query("agg_label_statistics", "SELECT event_type, count(*) AS n, count(*) FILTER (value > 50) AS n_flagged, count(DISTINCT user_id) AS n_sources, round(avg(value / 100), 6) AS mean_confidence FROM events GROUP BY 1")
def agg_label_statistics(t):
    rows = t.events.withColumn("confidence", F.col("value") / 100)
    return D.label_statistics(rows, "event_type", F.col("value") > 50, "user_id", "confidence").withColumn("mean_confidence", R(F.col("mean_confidence")))


@query("agg_queue_metrics", """WITH j AS (SELECT o_orderpriority, CASE o_orderstatus WHEN 'F' THEN 'DONE' WHEN 'O' THEN 'FAILED' ELSE 'WAITING' END AS s, o_orderkey % 5 AS a FROM orders)
  SELECT o_orderpriority, count(*) AS n, count(*) FILTER (s = 'DONE') AS succeeded, count(*) FILTER (s = 'WAITING' OR s = 'FAILED' AND a < 3) AS waiting, count(*) FILTER (s = 'FAILED' AND a >= 3) AS dead,
  round(coalesce(count(*) FILTER (s = 'DONE') / nullif(count(*) FILTER (s = 'DONE' OR s = 'FAILED' AND a >= 3), 0), 0), 6) AS success_rate FROM j GROUP BY 1""")
def agg_queue_metrics(t):
    jobs = t.orders.withColumn("s", F.when(F.col("o_orderstatus") == "F", "DONE").when(F.col("o_orderstatus") == "O", "FAILED").otherwise("WAITING"))
    return D.queue_metrics(jobs, "o_orderpriority", "s", F.col("o_orderkey") % 5, 3).withColumn("success_rate", R(F.col("success_rate")))


@query("unc_priority", "SELECT l_orderkey, l_linenumber, round(0.7 * l_discount * 10 + 0.3 * CASE WHEN l_linenumber > 2 THEN l_tax ELSE 0 END, 6) AS priority FROM lineitem")
def unc_priority(t):
    return t.lineitem.select("l_orderkey", "l_linenumber", R(D.labelling_priority(F.col("l_discount") * 10, F.when(F.col("l_linenumber") > 2, F.col("l_tax")))).alias("priority"))


@query("top_unwound", "SELECT c_custkey, unnest([c_mktsegment, c_name] || CASE WHEN c_nationkey > 10 THEN [c_name] ELSE [] END || ['x']) AS item FROM customer")
def top_unwound(t):
    rows = t.customer.select("c_custkey", F.array("c_mktsegment", "c_name").alias("a"), F.when(F.col("c_nationkey") > 10, F.array("c_name")).alias("b"), F.array(F.lit("x")).alias("c"))
    return D.unwound(rows, "c_custkey", "a", "b", "c")


@query("kno_evidence", r"""SELECT doc_id AS id, round(n_chars / 1000, 6) AS score, substr(trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g')), 1, 80) AS excerpt,
  array_to_string(list_sort(list_distinct(regexp_extract_all(coalesce(text, ''), '[0-9]{3,}'))), '|') AS entities FROM documents""")
def kno_evidence(t):
    hits = t.documents.select(F.lit(1).alias("query"), F.col("doc_id").alias("id"), R(F.col("n_chars") / 1000).alias("score"))
    return D.evidence(hits, t.documents, "doc_id", "text", "[0-9]{3,}").select("id", "score", "excerpt", F.array_join("entities", "|").alias("entities"))
