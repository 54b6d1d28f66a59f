"""Quality classifier: a factorisation machine over hashed words and structure.

score = sigmoid(w0 + sum w_i x_i + sum_{i<j} <v_i, v_j> x_i x_j); the pair sum
is computed as half of (sum v_i x_i)^2 - sum (v_i x_i)^2 per factor, so a
document costs time linear in its features.

Features are the hashed words of the whole text (log counts, unit length),
structure statistics (shares of character classes, word and line lengths,
repetition) and the text's own length. Labels, language, source and id are
never inputs. The machine is fitted on the driver with AdaGrad on a bounded
sample of labelled rows, spread by a hash of the id.

Defined results: null and empty texts have structure features only and get
the score those give; without labels, or with one class only, the score is the
share of label 1 (0.5 without labels); repeated rows get equal scores; further
columns are ignored, whatever their names; an empty table gives no rows; texts
of any length are scored whole and must fit into a task.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACE_BYTES, WordHasher, byte_values, held_out, received, shipped

#: Labelled documents to learn from, at most about so many.
TRAIN_DOCS = 4_000
WORD_BITS, FACTORS, EPOCHS, RATE, BATCH = 15, 6, 12, 0.08, 64
SLICES = 1 << 30
CHUNK_BYTES = 1 << 20

CLASS_BYTES = {
    "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "digit": b"0123456789",
    "point": b".,;:!?",
    "mark": b"#*$%&|<>{}[]\\/@^~_=+",
    "space": bytes(SPACE_BYTES),
}
STATS = (*CLASS_BYTES, "beyond_ascii", "bang", "log_words", "log_chars", "word_len", "words_distinct", "log_lines", "line_words", "lines_distinct")
N_FEATURES = (1 << WORD_BITS) + len(STATS)


def _byte_class(values: bytes) -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(values)] = True
    return table


class Hashers:
    """Word and line hashing, made once per task."""

    def __init__(self):
        self.words = WordHasher(byte_values(SPACE_BYTES), seed=11)
        self.lines = WordHasher(byte_values([10]), seed=13)


def extract(texts: list[str | None], hashers: Hashers) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sparse features (row, index, value), rows ascending."""
    blobs = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    n = len(blobs)
    data = np.frombuffer(b"\n".join(blobs) + b"\n", np.uint8)
    sizes = np.array([len(b) for b in blobs])
    starts = np.concatenate([[0], np.cumsum(sizes + 1)[:-1]])
    space = _byte_class(CLASS_BYTES["space"])[data]
    hashes, at = hashers.words(data)
    row = np.searchsorted(starts, at, side="right") - 1
    n_words = np.bincount(row, minlength=n)

    def per_doc(flag: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(flag)])
        return total[starts + sizes] - total[starts]

    length = np.maximum(sizes, 1)
    stats = [per_doc(_byte_class(v)[data]) / length for v in CLASS_BYTES.values()]
    stats.append(per_doc(data >= 128) / length)
    stats.append(per_doc(data == ord("!")) / np.maximum(n_words, 1))
    key = (row.astype(np.uint64) << np.uint64(WORD_BITS)) | (hashes & np.uint64((1 << WORD_BITS) - 1))
    distinct, count = np.unique(key, return_counts=True)
    word_row = (distinct >> np.uint64(WORD_BITS)).astype(np.int64)
    n_distinct = np.bincount(word_row, minlength=n)
    lines, line_at = hashers.lines(data)
    line_row = np.searchsorted(starts, line_at, side="right") - 1
    n_lines = np.bincount(line_row, minlength=n)
    line_key = np.unique(np.stack([line_row.astype(np.uint64), lines]), axis=1) if len(lines) else np.empty((2, 0), np.uint64)
    d_lines = np.bincount(line_key[0].astype(np.int64), minlength=n)
    some = np.maximum(n_words, 1)
    stats += [np.log1p(n_words) / 8, np.log1p(sizes) / 10, per_doc(~space) / some / 10, n_distinct / some, np.log1p(n_lines) / 5, np.log1p(n_words / np.maximum(n_lines, 1)) / 5, d_lines / np.maximum(n_lines, 1)]

    value = np.log1p(count)
    norm = np.sqrt(np.bincount(word_row, weights=value**2, minlength=n))
    value = value / norm[word_row]
    stat_row = np.tile(np.arange(n), len(STATS))
    stat_at = np.repeat(np.arange(len(STATS)), n) + (1 << WORD_BITS)
    rows = np.concatenate([word_row, stat_row])
    at = np.concatenate([(distinct & np.uint64((1 << WORD_BITS) - 1)).astype(np.int64), stat_at])
    values = np.concatenate([value, np.concatenate(stats)])
    order = np.argsort(rows, kind="stable")
    return rows[order], at[order], values[order].astype(np.float32)


@dataclass
class Machine:
    bias: float
    linear: np.ndarray
    factors: np.ndarray

    def logits(self, rows: np.ndarray, at: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
        first = np.searchsorted(rows, np.arange(n))  # every document has features
        terms = self.factors[at] * values[:, None]
        total = np.add.reduceat(terms, first, axis=0)
        squares = np.add.reduceat(terms * terms, first, axis=0)
        linear = np.add.reduceat(self.linear[at] * values, first)
        return self.bias + linear + 0.5 * (total * total - squares).sum(axis=1)

    def score(self, texts: list[str | None], hashers: Hashers) -> np.ndarray:
        z = np.clip(self.logits(*extract(texts, hashers), len(texts)), -30, 30)
        return 1 / (1 + np.exp(-z))


def constant(share: float) -> Machine:
    share = min(max(share, 1e-6), 1 - 1e-6)
    return Machine(float(np.log(share / (1 - share))), np.zeros(N_FEATURES, np.float32), np.zeros((N_FEATURES, FACTORS), np.float32))


def train(rows: np.ndarray, at: np.ndarray, values: np.ndarray, labels: np.ndarray) -> Machine:
    """AdaGrad on the log loss; classes weigh the same. Rows must be 0..n-1, ascending."""
    n = len(labels)
    if not n or labels.min() == labels.max():
        return constant(float(labels.mean()) if n else 0.5)
    rng = np.random.default_rng(3)
    m = constant(0.5)
    m.factors = rng.normal(0, 0.02, m.factors.shape).astype(np.float32)
    g_bias, g_lin, g_fac = 1e-6, np.full(N_FEATURES, 1e-6, np.float32), np.full(m.factors.shape, 1e-6, np.float32)
    weight = np.where(labels == 1, 0.5 / labels.mean(), 0.5 / (1 - labels.mean()))
    edges = np.searchsorted(rows, np.arange(n + 1))
    for _ in range(EPOCHS):
        order = rng.permutation(n)
        for a in range(0, n, BATCH):
            docs = order[a : a + BATCH]
            lens = edges[docs + 1] - edges[docs]
            first = np.cumsum(lens) - lens
            pick = np.repeat(edges[docs] - first, lens) + np.arange(int(lens.sum()))
            i, x = at[pick], values[pick]
            terms = m.factors[i] * x[:, None]
            total = np.add.reduceat(terms, first, axis=0)
            squares = np.add.reduceat(terms * terms, first, axis=0)
            z = m.bias + np.add.reduceat(m.linear[i] * x, first) + 0.5 * (total * total - squares).sum(axis=1)
            err = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels[docs]) * weight[docs] / len(docs)
            e = np.repeat(err, lens)
            used, back = np.unique(i, return_inverse=True)
            lin = np.bincount(back, weights=e * x, minlength=len(used)) + 1e-6 * m.linear[used]
            inner = (np.repeat(total, lens, axis=0) - terms) * (e * x)[:, None]
            fac = np.stack([np.bincount(back, weights=inner[:, k], minlength=len(used)) for k in range(FACTORS)], axis=1) + 1e-6 * m.factors[used]
            g_lin[used] += lin**2
            g_fac[used] += fac**2
            g_bias += float(err.sum()) ** 2
            m.linear[used] -= RATE * lin / np.sqrt(g_lin[used])
            m.factors[used] -= 0.5 * RATE * fac / np.sqrt(g_fac[used])
            m.bias -= RATE * float(err.sum()) / np.sqrt(g_bias)
    return m


def _chunks(texts: list[str | None]):
    start = size = 0
    for i, t in enumerate(texts):
        if i > start and size + len(t or "") > CHUNK_BYTES:
            yield start, i
            start, size = i, 0
        size += len(t or "")
    if start < len(texts):
        yield start, len(texts)


FEATURE_SCHEMA = "label int, at binary, value binary"


def _feature_rows(batches):
    hashers = Hashers()
    for batch in batches:
        labels, texts = batch.column(0), batch.column(1).to_pylist()
        for a, b in _chunks(texts):
            rows, at, values = extract(texts[a:b], hashers)
            edges = np.searchsorted(rows, np.arange(b - a + 1))
            parts = list(zip(edges[:-1], edges[1:]))
            yield pa.RecordBatch.from_arrays(
                [labels.slice(a, b - a).cast(pa.int32()), pa.array([at[i:j].astype(np.int32).tobytes() for i, j in parts], pa.binary()), pa.array([values[i:j].tobytes() for i, j in parts], pa.binary())],
                ["label", "at", "value"],
            )


def fit(labelled: DataFrame, train_docs: int = TRAIN_DOCS) -> Machine:
    """Fit on rows (doc_id, text, quality), at most about train_docs of them."""
    known = labelled.where(F.col("quality").isin(0, 1))
    n = known.count()
    limit = int(min(1.0, train_docs / max(n, 1)) * SLICES)
    sample = known.where(F.pmod(F.xxhash64(F.lit(9), "doc_id"), F.lit(SLICES)) < limit)
    got = sample.select(F.col("quality").cast("int").alias("label"), "text").mapInArrow(_feature_rows, FEATURE_SCHEMA).toPandas()
    if not len(got):
        return constant(0.5)
    got = got.iloc[np.lexsort([got["value"].map(hash_bytes), got["label"]])]  # the same order whatever the partitions
    at = [np.frombuffer(x, np.int32) for x in got["at"]]
    values = [np.frombuffer(x, np.float32) for x in got["value"]]
    rows = np.repeat(np.arange(len(at)), [len(x) for x in at])
    return train(rows, np.concatenate(at).astype(np.int64), np.concatenate(values), got["label"].to_numpy(np.float64))


def hash_bytes(value: bytes) -> int:
    import zlib

    return zlib.crc32(value)


def score(docs: DataFrame, machine: Machine) -> DataFrame:
    """(doc_id, score) of every row; one narrow pass, the machine (a fixed 1 MB) is broadcast."""
    shared = shipped(docs.sparkSession, machine)

    def run(batches):
        hashers, model = Hashers(), received(shared)
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1).to_pylist()
            for a, b in _chunks(texts):
                yield pa.RecordBatch.from_arrays([ids.slice(a, b - a).cast(pa.int64()), pa.array(model.score(texts[a:b], hashers).astype(np.float64))], ["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, score double")


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    known = docs.select("doc_id", "text").join(labels.where(~held_out(F.col("doc_id"))), "doc_id")
    out = score(docs, fit(known))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))
