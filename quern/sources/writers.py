"""Writers: upsert, delete, splits, exports, retention. All go through Spark's
committers, to any file system Spark reaches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.joins import upsert


def checked_vectors(df: DataFrame, vector: str, size: int) -> DataFrame:
    """Rows whose vector has the size and only finite numbers."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return df.where((F.size(vector) == size) & fine)


def upsert_to(old: DataFrame, new: DataFrame, key: list[str], path: str, order: Column | None = None) -> None:
    """Write old rows replaced by new ones to a new path; readers switch over when it is complete."""
    upsert(old, new, key, order).write.mode("errorifexists").parquet(path)


def without(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    return df.join(ids.select(key), key, "left_anti")


def write_splits(df: DataFrame, path: str, by: str = "split") -> None:
    """JSON lines, one folder per split."""
    df.write.mode("overwrite").partitionBy(by).json(path)


def write_graph(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    nodes.write.mode("overwrite").json(f"{path}/nodes")
    edges.write.mode("overwrite").json(f"{path}/edges")


def retained(df: DataFrame, ts: str, now: Column, days: int, keep: Column | None = None) -> DataFrame:
    """Rows younger than so many days, or kept for another reason."""
    young = F.col(ts) >= now - F.make_interval(days=F.lit(days))
    return df.where(young | keep) if keep is not None else df.where(young)


def prometheus(df: DataFrame, name: str, labels: str, value: str) -> DataFrame:
    """(line): name{label="v"} value."""
    pairs = F.array_join(F.transform(F.array_sort(F.map_entries(labels)), lambda e: F.concat(e["key"], F.lit('="'), e["value"], F.lit('"'))), ",")
    return df.select(F.concat(F.col(name), F.lit("{"), pairs, F.lit("} "), F.col(value).cast("string")).alias("line"))


def flatten_nested(df: DataFrame, key: str, arrays: dict[str, str]) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) from nested records: arrays maps a column of ids to an edge type."""
    nodes, edges = df.select(F.col(key).cast("string").alias("id")), None
    for column, kind in arrays.items():
        part = df.select(F.col(key).cast("string").alias("src"), F.explode(F.col(column).cast("array<string>")).alias("dst"), F.lit(kind).alias("type"))
        edges = part if edges is None else edges.unionByName(part)
        nodes = nodes.union(part.select("dst"))
    return nodes.distinct(), edges
