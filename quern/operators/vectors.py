"""Vectors as one byte a dimension, searched by bounds and settled by the whole vectors.

A vector's directions are kept as whole numbers from -127 to 127 and one scale.
A product with the codes is off by a known amount at most, so a task drops all
rows that cannot be among a query's best; the whole vectors of the few that are
left decide. The result is exact; how many rows were compared whole is reported.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..shared import stored
from .retrieval import MAX_BROADCAST_QUERIES, QUERY_CHUNK, dot, top, unit

LEVELS = 127
#: Candidate pairs of so few rows are broadcast to fetch their vectors: 16 bytes each.
MAX_BROADCAST_PAIRS = 1_000_000


def scale_of(v: Column) -> Column:
    """What one step of a vector's codes stands for; 0 for a zero vector."""
    return F.array_max(F.transform(v, lambda x: F.abs(x.cast("double")))) / LEVELS


def codes_of(v: Column, scale: Column) -> Column:
    """Whole numbers from -127 to 127; zeros for a zero vector."""
    return F.transform(v, lambda x: F.when(scale > 0, F.round(x.cast("double") / F.when(scale > 0, scale))).otherwise(0.0).cast("tinyint"))


def quantised(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """(id, scale, codes): a quarter of the bytes of floats. Null vectors go."""
    rows = vectors.where(F.col(vector).isNotNull()).select(F.col(key).alias("id"), F.col(vector).alias("v"))
    return rows.withColumn("scale", scale_of(F.col("v"))).select("id", "scale", codes_of(F.col("v"), F.col("scale")).alias("codes"))


def search_quantised(codes: DataFrame, vectors: DataFrame, queries: DataFrame, key: str, vector: str, k: int) -> tuple[DataFrame, DataFrame]:
    """((query, id, score, rank), (query, compared)): each query's k nearest by cosine, exactly.

    codes: quantised directions, as `quantised` gives them for `unit` vectors.
    Each task keeps, per query, rows whose upper bound reaches the k-th best
    lower bound it knows; the same is done with all tasks' rows; what is left
    is compared whole. Queries meet the codes in blocks of bounded size.
    """
    import numpy as np
    import pandas as pd

    n = queries.count()
    blocks = max(1, -(-n // MAX_BROADCAST_QUERIES))
    asked = stored(queries.where(F.col(vector).isNotNull()).select(F.col(key).cast("long").alias("query"), unit(F.col(vector)).alias("q")))
    spark, kept = queries.sparkSession, None
    for i in range(blocks):
        rows = asked.where(F.pmod(F.xxhash64("query"), F.lit(blocks)) == i).collect()  # a block of queries
        if not rows:
            continue
        ids = np.array([r["query"] for r in rows])
        sent = spark.sparkContext.broadcast(np.array([r["q"] for r in rows], float))

        def scan(batches, ids=ids, sent=sent, chunk=QUERY_CHUNK):
            q = sent.value
            single = q.astype(np.float32)
            # a code is off by half a step at most, in every dimension
            slack = np.abs(q).sum(axis=1) / 2
            lows = np.full((len(q), k), -np.inf)  # best lower bounds so far
            for pdf in batches:
                if pdf.empty:
                    continue
                c = np.array(pdf["codes"].tolist(), np.float32).reshape(len(pdf), -1)
                scale, own = pdf["scale"].to_numpy(), pdf["id"].to_numpy()
                for at in range(0, len(q), chunk):  # so many queries by a batch of rows are held at once
                    some = slice(at, at + chunk)
                    about = (single[some] @ c.T).astype(float) * scale
                    # float32 sums of 127 * |q|: a relative error below 1e-5 of what they add up
                    off = slack[some, None] * scale * (1 + 2e-3) + 1e-9
                    lows[some] = np.partition(np.concatenate([lows[some], about - off], axis=1), -k, axis=1)[:, -k:]
                    row, col = np.nonzero(about + off >= lows[some].min(axis=1)[:, None])
                    mid, gap = about[row, col], off[row, col]
                    yield pd.DataFrame({"query": ids[some][row], "id": own[col], "low": mid - gap, "high": mid + gap})

        part = codes.select(F.col("id").cast("long").alias("id"), "scale", "codes").mapInPandas(scan, "query long, id long, low double, high double")
        kept = part if kept is None else kept.unionByName(part)
    if kept is None:
        none = spark.createDataFrame([], "query long, id long, score double, rank int")
        return none, spark.createDataFrame([], "query long, compared long")
    kept = stored(kept)
    bar = top(kept.select("query", "id", F.col("low").alias("score")), k).groupBy("query").agg(F.when(F.count("*") >= k, F.min("score")).alias("bar"))
    left = stored(kept.join(bar, "query").where(F.col("bar").isNull() | (F.col("high") >= F.col("bar"))).select("query", "id"))
    small = F.broadcast if n <= MAX_BROADCAST_QUERIES else (lambda df: df)
    whole = vectors.select(F.col(key).cast("long").alias("id"), unit(F.col(vector)).alias("v"))
    pairs = whole.join(F.broadcast(left) if left.count() <= MAX_BROADCAST_PAIRS else left, "id")
    settled = pairs.join(small(asked), "query").select("query", "id", dot(F.col("v"), F.col("q")).alias("score"))
    return top(settled, k), left.groupBy("query").agg(F.count("*").alias("compared"))
