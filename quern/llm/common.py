"""Helpers that several corpus operators share."""

from __future__ import annotations

import re
import tempfile
import uuid
from contextlib import contextmanager

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The 26 letters that the contracts lower-case, and no others.
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Separators of the plain word rule ``[^\\x20\\x09-\\x0D]+``.
SPACE_BYTES = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, UPPER.lower())


def held_out(doc_id: Column) -> Column:
    """True for the documents whose crc32(doc_id as text) mod 4 is 2."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which all executors reach.

    Only where the session names none and runs on one machine (tests) a local
    folder is set up; a cluster without one is an error.
    """
    jsc = spark.sparkContext._jsc.sc()
    got = jsc.getCheckpointDir()
    if got.isDefined():
        return got.get()
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors reach")
    spark.sparkContext.setCheckpointDir(named or tempfile.mkdtemp(prefix="ckpt"))
    return jsc.getCheckpointDir().get()


#: Spark deletes the shuffle files of a statement when it ends: its rows are stored by then.
CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def cleaned_shuffles(spark: SparkSession):
    before = spark.conf.get(CLEAN, None)
    spark.conf.set(CLEAN, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(CLEAN)
        else:
            spark.conf.set(CLEAN, before)


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write a frame to the shared folder and read it back: cuts the lineage,
    survives the loss of executors, and every later reader sees the same rows."""
    return Steps(df.sparkSession).stored(df, label)


class Steps:
    """Written steps of an operator, in a folder of their own in the shared folder."""

    def __init__(self, spark: SparkSession):
        self.spark, self.root, self.used = spark, f"{shared_dir(spark)}/{uuid.uuid4().hex}", 0

    def stored(self, df: DataFrame, label: str) -> DataFrame:
        path, self.used = f"{self.root}/{self.used}-{label}", self.used + 1
        with cleaned_shuffles(self.spark):
            df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._step_path = path
        return out

    def drop(self, *steps: DataFrame) -> None:
        """Delete written steps that nothing reads any more."""
        jvm, conf = self.spark._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        for df in steps:
            path = jvm.org.apache.hadoop.fs.Path(df._step_path)
            path.getFileSystem(conf).delete(path, True)


def named(name: str) -> Column:
    """A column by its whole name, dots and quotes included."""
    return F.col("`" + name.replace("`", "``") + "`")


def fresh(columns, *wanted: str) -> list[str]:
    """Names like those wanted that clash with no column, in any case."""
    taken = {c.lower() for c in columns}
    out = []
    for name in wanted:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def checkpointed(df: DataFrame) -> DataFrame:
    shared_dir(df.sparkSession)
    with cleaned_shuffles(df.sparkSession):
        return df.checkpoint(eager=True)


def shipped(spark: SparkSession, model):
    """Broadcast a model of this package. Its class goes along by value: plain
    broadcasts name classes by module, which executors may not have."""
    from pyspark import cloudpickle

    return spark.sparkContext.broadcast(cloudpickle.dumps(model))


def received(shared):
    from pyspark import cloudpickle

    return cloudpickle.loads(shared.value)


MIX_1 = np.uint64(0x9E3779B97F4A7C15)
MIX_2 = np.uint64(0xBF58476D1CE4E5B9)
MIX_3 = np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """Finalising bit mixer on unsigned 64-bit arrays."""
    x = x ^ (x >> np.uint64(30))
    x = x * MIX_2
    x = x ^ (x >> np.uint64(27))
    x = x * MIX_3
    return x ^ (x >> np.uint64(31))


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    out = np.ones(n, np.uint64)
    done = 1
    while done < n:
        take = min(done, n - done)
        out[done : done + take] = out[:take] * np.uint64(pow(base, done, 1 << 64))
        done += take
    return out


class WordHasher:
    """Hashes of the maximal runs of word bytes in a byte array.

    A run's hash is the sum of its byte values times powers of an odd base
    relative to the run's start, mixed with the run's length: equal runs hash
    alike wherever they lie. Powers are taken at global positions and divided
    out again (odd numbers have inverses modulo 2**64), so the work is three
    passes over the bytes. Make one per task; it keeps its tables.
    """

    BLOCK = 1 << 20

    def __init__(self, values: np.ndarray, seed: int = 1):
        """values: for each byte 0 if it separates words, else its value."""
        self.values, self.seed = values.astype(np.uint64), np.uint64(seed)
        self.base = 0x100000001B3 + 2 * seed
        self.up = powers(self.base, self.BLOCK)
        self.down = powers(pow(self.base, -1, 1 << 64), self.BLOCK)

    def __call__(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(hash of each run, start of each run)."""
        coded = self.values[data]
        edge = np.diff((coded != 0).view(np.int8), prepend=np.int8(0), append=np.int8(0))
        starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        if not len(starts):
            return np.empty(0, np.uint64), starts
        sums = np.empty(len(starts), np.uint64)
        i = 0
        while i < len(starts):
            at = starts[i]
            j = max(i + 1, int(np.searchsorted(ends, at + self.BLOCK, side="right")))
            part = coded[at : ends[j - 1]]
            if len(part) <= self.BLOCK:
                here = starts[i:j] - at
                sums[i:j] = np.add.reduceat(part * self.up[: len(part)], here) * self.down[here]
            else:  # one run longer than a block
                total, step = 0, pow(self.base, self.BLOCK, 1 << 64)
                for b in range((len(part) - 1) // self.BLOCK, -1, -1):
                    piece = part[b * self.BLOCK : (b + 1) * self.BLOCK]
                    total = (total * step + int(np.add.reduce(piece * self.up[: len(piece)]))) % (1 << 64)
                sums[i] = total
            i = j
        return mix(sums + (ends - starts).astype(np.uint64) * MIX_1 + self.seed), starts


def byte_values(separators, lower: bool = False) -> np.ndarray:
    """Value table of a WordHasher: separators 0, the rest byte + 1, A-Z as a-z on demand."""
    out = np.arange(1, 257, dtype=np.uint64)
    if lower:
        out[65:91] += 32
    out[list(separators)] = 0
    return out


def text_slices(batches, limit: int, column: int = 1, rows: int = 512):
    """(part of a batch, its texts): so few rows, and about so many characters, that
    what is made of them stays small; one long text stands alone."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            some = batch.slice(at, rows)
            texts = some.column(column).to_pylist()
            start = 0
            while start < len(texts):
                stop, size = start, 0
                while stop < len(texts) and (stop == start or size + len(texts[stop] or "") <= limit):
                    size += len(texts[stop] or "")
                    stop += 1
                yield some.slice(start, stop - start), texts[start:stop]
                start = stop

