"""Operators that combine retrieval, graph and records: supersession, audit trails,
caches, question-answer scoring, gates and snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T
from .graph import cut


def supersession_chains(edges: DataFrame, depth: int = 20) -> DataFrame:
    """(start, latest, hops): where each superseded item's longest chain ends.
    edges: (old, new). Cycles end where they close."""
    e = edges.select("old", "new").distinct()
    now = e.select(F.col("old").alias("start"), F.col("new").alias("node"), F.lit(1).alias("hops"), F.array("old", "new").alias("seen"))
    ends = None
    for _ in range(depth):
        last = now.join(e, F.col("node") == F.col("old"), "left_anti").select("start", F.col("node").alias("latest"), "hops")
        ends = last if ends is None else ends.unionByName(last)
        step = now.join(e, F.col("node") == F.col("old")).where(~F.array_contains("seen", F.col("new")))
        now = cut(step.select("start", F.col("new").alias("node"), (F.col("hops") + 1).alias("hops"), F.concat("seen", F.array("new")).alias("seen")))
        if now.isEmpty():
            break
    best = Window.partitionBy("start").orderBy(F.desc("hops"), "latest")
    return ends.withColumn("_r", F.row_number().over(best)).where("_r = 1").drop("_r")


def resolve_supersession(results: DataFrame, edges: DataFrame) -> DataFrame:
    """Results with superseded ids replaced by their latest; the best score per id stays."""
    latest = supersession_chains(edges).select(F.col("start").alias("id"), "latest")
    out = results.join(latest, "id", "left").select("query", F.coalesce("latest", "id").alias("id"), "score")
    return out.groupBy("query", "id").agg(F.max("score").alias("score"))


def audit_trail(hits: DataFrame, superseded: DataFrame, citations: DataFrame, key: str, least: int) -> DataFrame:
    """Why each hit was kept: its citations and a decision."""
    n = citations.groupBy(key).agg(F.count("*").alias("n_citations"))
    gone = superseded.select(key).distinct().withColumn("_gone", F.lit(True))
    out = hits.join(n, key, "left").join(gone, key, "left").fillna(0, ["n_citations"])
    decision = F.when(F.coalesce("_gone", F.lit(False)), "REJECT_SUPERSEDED").when(F.col("n_citations") >= least, "ACCEPT_CITED").otherwise("ACCEPT")
    return out.select(*hits.columns, "n_citations", decision.alias("decision"))


def embedding_quality(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """Mean, largest, smallest and deviation of the cosine matrix with a zeroed diagonal.

    The sums need no pairs of rows: the sum of all cosines is the squared norm
    of the summed unit vectors, the sum of their squares that of the summed
    outer products. The extremes are left to a nearest-neighbour search.
    """
    from .retrieval import unit as unit_of

    unit = vectors.select(unit_of(F.col(vector)).alias("u"))
    cells = unit.select(F.posexplode(F.flatten(F.transform("u", lambda a: F.transform("u", lambda b: a * b)))).alias("i", "x")).groupBy("i").agg(F.sum("x").alias("x"))
    squares = cells.agg(F.sum(F.col("x") * F.col("x")).alias("sq"))
    total = unit.select(F.posexplode("u").alias("i", "x")).groupBy("i").agg(F.sum("x").alias("x"), F.count("*").alias("n")).agg(F.sum(F.col("x") * F.col("x")).alias("s"), F.max("n").alias("n"))
    n2 = F.col("n") * F.col("n")
    mean = (F.col("s") - F.col("n")) / n2
    return total.join(squares, how="cross").select("n", mean.alias("mean"), F.sqrt((F.col("sq") - F.col("n")) / n2 - mean * mean).alias("std"))  # one row each


def cached_answers(queries: DataFrame, cache: DataFrame, vector: str, least: float, now: Column) -> DataFrame:
    """(query, cached, score): the nearest unexpired cached query at a cosine of least or more. cache: (id, vector, expires)."""
    from .retrieval import nearest

    live = cache.where(F.col("expires") > now)
    got = nearest(live, queries, "id", vector, 1, least=least)
    return got.select("query", F.col("id").alias("cached"), "score")


def adapted_weights(feedback: DataFrame, run: str, order: str, scores: str, rating: str, n: int, rate: float = 0.1) -> DataFrame:
    """(run, weights): w += rate * (rating - score) * score per source, renormalised, in order, one by one as the
    answers stream by; the rate fades by a tenth each hundred. Answers without a rating or a score change nothing."""
    from ..shared import streamed

    def step(state: tuple | None, answer: tuple) -> tuple:
        w, k = state or ([1.0 / n] * n, 0)
        given, stars = answer
        if stars is None or given is None or None in given:
            return w, k
        lr = rate * 0.9 ** (k // 100)
        raw = [max(x + lr * (stars - s) * s, 0.0) for x, s in zip(w, given)]
        total = 1e-12 + sum(raw)
        return [x / total for x in raw], k + 1

    rows = feedback.select(run, order, F.col(scores).alias("s"), F.col(rating).cast("double").alias("r"))
    return streamed(rows, run, [order, "s", "r"], ["s", "r"], step, lambda state: state[0], "weights array<double>")


def retrieve(mode: str, text_hits: DataFrame, graph_hits: DataFrame, graph_score: float = 0.8) -> DataFrame:
    """(query, id, score, source) by mode: TEXT_ONLY, GRAPH_ONLY, HYBRID_GRAPH_FIRST, or
    AUTO (the graph's hits where a query has any, else the text's)."""
    t = text_hits.select("query", "id", "score", F.lit("text").alias("source"))
    g = graph_hits.select("query", "id", F.lit(graph_score).alias("score"), F.lit("graph").alias("source"))
    if mode == "TEXT_ONLY":
        return t
    if mode == "GRAPH_ONLY":
        return g
    if mode == "AUTO":
        return g.unionByName(t.join(g.select("query").distinct(), "query", "left_anti"))
    if mode != "HYBRID_GRAPH_FIRST":
        raise ValueError(mode)
    first = F.when(F.col("source") == "graph", 0).otherwise(1)
    return g.unionByName(t).groupBy("query", "id").agg(F.min_by(F.struct("score", "source"), first).alias("b")).select("query", "id", "b.score", "b.source")


def qa_scores(question: Column, answer: Column, source: Column) -> dict[str, Column]:
    """relevance, groundedness, coherence, completeness and their weighted sum (.25, .35, .2, .2)."""
    q, a, s = T.tokens(question), T.tokens(answer), T.tokens(source)
    relevance = T.jaccard(q, a)
    grounded = 0.5 * T.overlap(a, s) + 0.5 * T.overlap(T.ngrams(a, 3), T.ngrams(s, 3))
    ends = F.when(F.trim(answer).rlike("[.!?؟]$"), 1.0).otherwise(0.5)
    coherent = 0.5 * ends + 0.5 * F.when(F.size(a) > 0, F.size(F.array_distinct(a)) / F.when(F.size(a) > 0, F.size(a))).otherwise(0.0)
    complete = F.least(F.lit(1.0), F.size(a) / 30) * 0.7 + F.least(F.lit(1.0), F.size(T.sentences_plain(answer)) / 2) * 0.3
    total = 0.25 * relevance + 0.35 * grounded + 0.2 * coherent + 0.2 * complete
    return {"relevance": relevance, "groundedness": grounded, "coherence": coherent, "completeness": complete, "quality": total}


def templated_questions(docs: DataFrame, key: str, title: str, text: str, templates: list[str]) -> DataFrame:
    """(key, question, answer): each template filled with the title; the answer is the text's first sentences."""
    answer = F.array_join(F.slice(T.sentences(F.col(text)), 1, 2), " ")
    rows = docs.select(key, title, answer.alias("answer"), F.explode(F.array(*[F.lit(t) for t in templates])).alias("t"))
    return rows.select(key, F.replace("t", F.lit("{}"), F.col(title)).alias("question"), "answer")


def gated(writes: DataFrame, refs: str, proof: str) -> DataFrame:
    """accepted: the proof starts with the first 8 hex digits of the hash of the sorted references as JSON."""
    want = F.substring(F.sha2(F.to_json(F.array_sort(refs)), 256), 1, 8)
    return writes.withColumn("accepted", F.coalesce(F.col(proof).startswith(want), F.lit(False)))


def chain_of_snapshots(snapshots: DataFrame, order: str, version: str, body: str, digest: str) -> DataFrame:
    """(order, later, same_version, sound) of snapshots against the one before."""
    w = Window.orderBy(order)  # snapshots are few
    before, old = F.lag(order).over(w), F.lag(version).over(w)
    return snapshots.select(order, F.coalesce(F.col(order) > before, F.lit(True)).alias("later"), F.coalesce(F.col(version) == old, F.lit(True)).alias("same_version"), (F.sha2(body, 256) == F.col(digest)).alias("sound"))


def formatted_citations(hits: DataFrame, by: str, most: int, *parts: str) -> DataFrame:
    """(by, rank, citation): the first hits of each group as "[rank] part, part"."""
    ranked = hits.where(F.col("rank") <= most)
    return ranked.select(by, "rank", F.concat(F.lit("["), F.col("rank").cast("string"), F.lit("] "), F.concat_ws(", ", *parts)).alias("citation"))


def anchored(chunks: DataFrame, key: str, order: str, text: str, anchor: str) -> DataFrame:
    """Chunks with neighbours merged where a boundary cuts an anchor such as "Article 12" in two."""
    w = Window.partitionBy(key).orderBy(order)
    cut_here = F.coalesce(F.lag(text).over(w).rlike(rf"{anchor}\s*$") & F.col(text).rlike(r"^\s*\d+"), F.lit(False))
    group = F.sum(F.when(F.col("_cut"), 0).otherwise(1)).over(w)
    rows = chunks.withColumn("_cut", cut_here).withColumn("_g", group)
    got = rows.groupBy(key, "_g").agg(F.array_sort(F.collect_list(F.struct(order, text))).alias("x"))
    return got.select(key, (F.col("_g") - 1).cast("int").alias("chunk"), F.array_join(F.transform("x", lambda r: r[text]), " ").alias("text"))
