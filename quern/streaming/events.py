"""Structured Streaming over event files."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..shared import shared_dir


def event_stream(spark: SparkSession, path: str, schema: T.StructType, files_per_batch: int = 100) -> DataFrame:
    """A file, or a folder's part files as they come, at most so many per micro-batch.

    The path is given as a pattern that only it fits: a stream takes a plain path for a folder.
    """
    return spark.readStream.format("parquet").schema(schema).option("maxFilesPerTrigger", files_per_batch).load(f"{path[:-1]}[{path[-1]}]")


def tumbling(events: DataFrame, ts: str, key: str, value: str, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Count and sum per window and key; rows later than the watermark are dropped."""
    return events.withWatermark(ts, late).groupBy(F.window(ts, width).alias("w"), key).agg(F.count("*").alias("n"), F.sum(value).alias("total")).select(F.col("w.start").alias("start"), key, "n", "total")


def sliding(events: DataFrame, ts: str, key: str, value: str, width: str, step: str, late: str = "10 minutes") -> DataFrame:
    return events.withWatermark(ts, late).groupBy(F.window(ts, width, step).alias("w"), key).agg(F.count("*").alias("n"), F.avg(value).alias("mean")).select(F.col("w.start").alias("start"), key, "n", "mean")


def sessions(events: DataFrame, ts: str, key: str, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    return events.withWatermark(ts, late).groupBy(F.session_window(ts, gap).alias("w"), key).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), key, "n")


def deduplicated(events: DataFrame, ts: str, *keys: str, late: str = "10 minutes") -> DataFrame:
    return events.withWatermark(ts, late).dropDuplicatesWithinWatermark(list(keys))


def suppressed_alerts(events: DataFrame, key: str, ts: str, seconds: float, late: str = "10 minutes") -> DataFrame:
    """(key, ts): alerts at least so long after the last one sent with their key.

    State per key is one time; it expires when the watermark is so long past it
    that no alert can be held back any more. A batch of one key is held as an
    array of times, bounded by the files of a micro-batch.
    """
    import numpy as np
    import pandas as pd
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    kind = dict(events.dtypes)[key]

    def send(k, batches, state: GroupState):
        if state.hasTimedOut:
            state.remove()
            return
        last = state.get[0] if state.exists else None
        times = np.sort(np.concatenate([pdf["t"].to_numpy() for pdf in batches]))
        at, out = 0, []
        if last is not None:
            at = int(np.searchsorted(times, last + seconds))
        while at < len(times):
            last = float(times[at])
            out.append(last)
            at = int(np.searchsorted(times, last + seconds))
        if last is not None:
            state.update((last,))
            state.setTimeoutTimestamp(max(int((last + seconds) * 1000), state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"key": [k[0]] * len(out), "t": out})

    rows = events.withWatermark(ts, late).select(F.col(ts), F.col(key).alias("key"), (F.unix_micros(F.col(ts).cast("timestamp")) / 1e6).alias("t"))
    return rows.groupBy("key").applyInPandasWithState(send, f"key {kind}, t double", "last double", "append", GroupStateTimeout.EventTimeTimeout)


def drained(stream: DataFrame, mode: str, *keys: str) -> DataFrame:
    """Run a stream over all that is there; its rows, read back from the shared folder.

    Each micro-batch is written to a folder of its own, which a retry writes
    again. In append mode all batches are the result, in complete mode the last,
    in update mode the last row of each key: batches then hold only what they
    changed, and the state of what is past the watermark is dropped.
    """
    base, epochs = f"{shared_dir(stream.sparkSession)}/{uuid.uuid4().hex}", []

    def write(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{base}/rows/{epoch}")
        epochs.append(epoch)

    q = stream.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    wanted = epochs[-1:] if mode == "complete" else sorted(set(epochs))
    if not wanted:
        return stream.sparkSession.createDataFrame([], stream.schema)
    rows = stream.sparkSession.read.schema(stream.schema).parquet(*[f"{base}/rows/{e}" for e in wanted])
    if mode != "update":
        return rows
    epoch = F.regexp_extract(F.col("_metadata.file_path"), "/rows/([0-9]+)/", 1).cast("long")
    rest = [c for c in stream.columns if c not in keys]
    return rows.withColumn("epoch_", epoch).groupBy(*keys).agg(F.max_by(F.struct(*rest), "epoch_").alias("x")).select(*[c if c in keys else f"x.{c}" for c in stream.columns])


def upsert_batches(stream: DataFrame, merge: Callable[[DataFrame, int], None], checkpoint: str, good=None, rejected: Callable[[DataFrame, int], None] | None = None):
    """Run merge per micro-batch; rows that fail the condition go to rejected instead."""

    def step(batch: DataFrame, epoch: int) -> None:
        merge(batch.where(good) if good is not None else batch, epoch)
        if good is not None and rejected is not None:
            rejected(batch.where(~F.coalesce(good, F.lit(False))), epoch)

    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
