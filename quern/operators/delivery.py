"""Delivery of rows: outbox, ledger appends, queues, caches, labelling statistics, graph exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def outbox(items: DataFrame, adapters: list[str], delivered: DataFrame | None = None) -> DataFrame:
    """(job, chunk, adapter, status): a row for each item and adapter, PENDING unless delivered (job, chunk, adapter) has it."""
    rows = items.select("job", "chunk", F.explode(F.array(*[F.lit(a) for a in adapters])).alias("adapter"))
    if delivered is None:
        return rows.withColumn("status", F.lit("PENDING"))
    done = delivered.select("job", "chunk", "adapter", F.lit("SENT").alias("status")).distinct()
    return rows.join(done, ["job", "chunk", "adapter"], "left").select("job", "chunk", "adapter", F.coalesce("status", F.lit("PENDING")).alias("status"))


def ledger_batch(entries: DataFrame, heads: DataFrame, chain: str, order: str, body: str) -> DataFrame:
    """Entries of a batch with seq, prev_hash and hash, to append to a ledger.

    heads: (chain, seq, hash) of what is stored; chains go on from there.
    """
    from .governance import chained

    w = Window.partitionBy(chain).orderBy(order)
    known = heads.select(F.col(chain).alias("head_chain"), F.col("seq").alias("head_seq"), F.col("hash").alias("head_hash"))
    rows = entries.join(known, F.col(chain) == F.col("head_chain"), "left").withColumn("seq", (F.row_number().over(w) + F.coalesce("head_seq", F.lit(0))).cast("long"))
    return chained(rows.drop("head_chain", "head_seq"), chain, order, body, head="head_hash").drop("head_hash")


def append_ledger(batch: DataFrame, path: str) -> None:
    batch.write.mode("append").json(path)


def label_statistics(entities: DataFrame, kind: str, flag: Column, source: str, confidence: str) -> DataFrame:
    """(kind, n, n_flagged, n_sources, mean_confidence) per entity type."""
    return entities.groupBy(kind).agg(F.count("*").alias("n"), F.count_if(flag).alias("n_flagged"), F.count_distinct(source).alias("n_sources"), F.avg(confidence).alias("mean_confidence"))


def queue_metrics(jobs: DataFrame, queue: str, status: str, attempts: Column, most_attempts: int) -> DataFrame:
    """(queue, n, succeeded, waiting, dead, success_rate): failed jobs with no attempts left are dead letters."""
    failed = F.col(status) == "FAILED"
    out = jobs.groupBy(queue).agg(F.count("*").alias("n"), F.count_if(F.col(status) == "DONE").alias("succeeded"), F.count_if((F.col(status) == "WAITING") | (failed & (attempts < most_attempts))).alias("waiting"), F.count_if(failed & (attempts >= most_attempts)).alias("dead"))
    over = F.col("succeeded") + F.col("dead")
    return out.withColumn("success_rate", F.when(over > 0, F.col("succeeded") / over).otherwise(0.0))


def labelling_priority(uncertainty: Column, diversity: Column) -> Column:
    return 0.7 * uncertainty + 0.3 * F.coalesce(diversity, F.lit(0.0))


def unwound(df: DataFrame, key: str, *lists: str) -> DataFrame:
    """(key, item): the lists joined end to end, an item to a row, repeats kept."""
    return df.select(key, F.explode(F.concat(*[F.coalesce(c, F.array().cast("array<string>")) for c in lists])).alias("item"))


def graph_of_records(records: DataFrame, key: str, text: str, pattern: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of documents: an edge to every mark the pattern finds in a text."""
    marks = records.select(F.col(key).cast("string").alias("src"), F.explode(F.array_distinct(F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(pattern), F.lit(0)))).alias("dst"))
    nodes = records.select(F.col(key).cast("string").alias("id"), F.lit("document").alias("kind")).union(marks.select("dst", F.lit("mark"))).distinct()
    return nodes, marks.withColumn("type", F.lit("MENTIONS"))


def graphml(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(line): nodes and edges as GraphML elements, escaped; head and foot belong to the file."""

    def safe(c: Column) -> Column:
        for mark, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
            c = F.replace(c, F.lit(mark), F.lit(entity))
        return c

    n = nodes.select(F.concat(F.lit('<node id="'), safe(F.col("id").cast("string")), F.lit('"/>')).alias("line"))
    e = edges.select(F.concat(F.lit('<edge source="'), safe(F.col("src").cast("string")), F.lit('" target="'), safe(F.col("dst").cast("string")), F.lit('"/>')).alias("line"))
    return n.union(e)


def evidence(hits: DataFrame, docs: DataFrame, key: str, text: str, entity: str, width: int = 80) -> DataFrame:
    """Hits (query, id, score) with a normalised excerpt and the entities of their document."""
    squeezed = F.trim(F.regexp_replace(F.coalesce(F.col(text), F.lit("")), r"\s+", " "))
    d = docs.select(F.col(key).alias("id"), F.substring(squeezed, 1, width).alias("excerpt"), F.array_sort(F.array_distinct(F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(entity), F.lit(0)))).alias("entities"))
    return hits.join(d, "id")
