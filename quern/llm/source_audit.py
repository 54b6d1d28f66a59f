"""Source divergence audit: how the words of each source differ from its language's and from other sources'.

Terms are runs of letters A-Z, a-z and of all characters beyond ASCII, A-Z
lower-cased. A task finds their bounds with a lookup table over the
concatenated UTF-8 bytes of its texts, groups equal slices by xxhash, compares
every slice with the first of its group byte by byte (slices of colliding
hashes are told apart as bytes), and counts. Counts per (lang, source, term)
are combined by group-bys, on the map side first.

Divergences are sums over the kept terms of a language for every pair of its
sources. Kept terms are dealt into blocks, sources into tiles of TILE; a task
gets one block of two tiles as sparse rows (CSR), computes each source against
all rows at once with gathers and reduceat, and sums of blocks are added up.
The result has a row for every pair of sources of a language, as it must; the
work beside it is one pass over the sparse rows for each source of a tile.

At size: shuffled rows are counts, at most one per (lang, source, term) and
task; blocks hold about BLOCK_ENTRIES counts of whatever language; a hot
source, language or term only has larger numbers. Broadcast is what Spark
itself measures as small.

All arithmetic is in whole numbers: p = 1 + floor(SCALE * (count + 1) / (N + V))
by long division in steps of 1,000, so nothing overflows below 9e15 words.

Defined results: null texts, languages and sources count as ''; texts without
terms only make their group appear; equal values rank by item as UTF-8 bytes;
repeated rows count each; an empty table gives no rows; other columns are
ignored, whatever their names; a text of any length is counted whole and must
fit into a task.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Steps, table, text_slices

SCALE = 1_000_000_000
MIN_DOCS = 3
TOP_TERMS = 200
#: Characters tokenised at once.
SLICE_CHARS = 1 << 22
BLOCK_ENTRIES = 1 << 18
TILE = 512

#: 0 for bytes that end a term, else the byte, A-Z as a-z.
FOLD = np.arange(256, dtype=np.uint8)
FOLD[:0x41] = 0
FOLD[0x5B:0x61] = 0
FOLD[0x7B:0x80] = 0
FOLD[0x41:0x5B] += 32

COUNT_SCHEMA = "lang string, source string, term string, n long, docs long"


def bounds(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(starts, ends) of the runs of non-zero bytes."""
    edge = np.diff((data != 0).view(np.int8), prepend=np.int8(0), append=np.int8(0))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def _same_bytes(data: np.ndarray, a: np.ndarray, b: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """Which slices of equal lengths, at a and at b, hold the same bytes."""
    same = np.ones(len(a), bool)
    at = 0
    ends = np.cumsum(lens)
    while at < len(a):  # about a million bytes at once
        stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + (1 << 20), side="right")))
        size = lens[at:stop]
        ahead = np.cumsum(size) - size
        step = np.arange(int(size.sum())) - np.repeat(ahead, size)
        differ = data[np.repeat(a[at:stop], size) + step] != data[np.repeat(b[at:stop], size) + step]
        same[at:stop] = np.add.reduceat(differ, ahead) == 0
        at = stop
    return same


def group_slices(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, digest=None) -> tuple[np.ndarray, list[bytes]]:
    """(number of the group of each slice, bytes of each group); equal slices, and only these, share a group."""
    if digest is None:
        import xxhash

        digest = xxhash.xxh3_64_intdigest
    raw = data.tobytes()
    hashes = np.fromiter((digest(raw[a:b]) for a, b in zip(starts.tolist(), ends.tolist())), np.uint64, len(starts))
    _, first, group = np.unique(hashes, return_index=True, return_inverse=True)
    lens = ends - starts
    model = first[group]
    wrong = lens != lens[model]
    alike = np.flatnonzero(~wrong)
    wrong[alike] = ~_same_bytes(data, starts[alike], starts[model[alike]], lens[alike])
    terms = [raw[a:b] for a, b in zip(starts[first].tolist(), ends[first].tolist())]
    if wrong.any():  # colliding hashes: these go by their bytes
        number = {}
        for i in np.flatnonzero(wrong).tolist():
            word = raw[starts[i] : ends[i]]
            if word not in number:
                number[word] = len(terms)
                terms.append(word)
            group[i] = number[word]
    return group, terms


def _counts(batches):
    names = [c.split()[0] for c in COUNT_SCHEMA.split(", ")]
    for part, texts in text_slices(batches, SLICE_CHARS, column=2, rows=1 << 14):
        langs, sources = (part.column(i).dictionary_encode() for i in (0, 1))
        both = langs.indices.to_numpy(zero_copy_only=False).astype(np.int64) * len(sources.dictionary) + sources.indices.to_numpy(zero_copy_only=False)
        _, sample, kinds = np.unique(both, return_index=True, return_inverse=True)
        raw = [(t or "").encode() for t in texts]
        data = FOLD[np.frombuffer(b"\n".join(raw) + b"\n", np.uint8)]
        starts, ends = bounds(data)
        if not len(starts):
            continue
        group, terms = group_slices(data, starts, ends)
        doc = np.searchsorted(np.cumsum([len(t) + 1 for t in raw]), starts, side="right")
        by_doc, n = np.unique(doc * len(terms) + group, return_counts=True)
        kind, term = kinds[by_doc // len(terms)], by_doc % len(terms)
        key, at = np.unique(kind * len(terms) + term, return_inverse=True)
        total = np.zeros(len(key), np.int64)
        np.add.at(total, at, n)
        rows = pa.array(sample[key // len(terms)])
        words = pa.array(terms, pa.binary()).cast(pa.string()).take(pa.array(key % len(terms)))
        yield pa.RecordBatch.from_arrays([part.column(0).take(rows), part.column(1).take(rows), words, pa.array(total), pa.array(np.bincount(at, minlength=len(key)).astype(np.int64))], names)


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")], F.col("text").cast("string").alias("text"))


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs): occurrences and documents, over whole texts."""
    return _keyed(docs).mapInArrow(_counts, COUNT_SCHEMA).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(count: np.ndarray, whole: np.ndarray) -> np.ndarray:
    """1 + floor(SCALE * (count + 1) / whole), by long division."""
    out, rest = np.zeros(np.broadcast(count, whole).shape, np.int64), count + 1
    for _ in range(3):
        rest = rest * 1000
        out = out * 1000 + rest // whole
        rest = rest % whole
    return out + 1


def share_column(count: Column, whole: Column) -> Column:
    """The same as an expression."""
    div = lambda a, b: F.call_function("div", a.cast("decimal(38,0)"), b.cast("decimal(38,0)"))
    return div((count + 1).cast("decimal(28,0)") * F.lit(SCALE).cast("decimal(10,0)"), whole) + 1


def divergence(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    gap = p - q
    return gap * gap // q


def tile_sums(rows: np.ndarray, terms: np.ndarray, counts: np.ndarray, whole: np.ndarray, n_terms: int) -> np.ndarray:
    """out[a, b] = sum over n_terms terms of divergence(p of a, p of b).

    Counts are given as (row, term, count), sorted by row; whole[a] is N + V of a.
    """
    n = len(whole)
    none = share(np.zeros(n, np.int64), whole)  # p of a term that a source lacks
    both = divergence(none[:, None], none[None, :]) * n_terms
    if not len(rows):
        return both
    p = share(counts, whole[rows])
    has, first = np.unique(rows, return_index=True)
    of_row = none[rows]
    out = both
    for b in range(n):
        mine = rows == b
        q = np.full(n_terms, none[b], np.int64)
        q[terms[mine]] = p[mine]
        q = q[terms]
        # terms that a has: as they are, in place of as if neither had them
        out[has, b] += np.add.reduceat(divergence(p, q) - divergence(of_row, none[b]), first)
        in_b = np.zeros(n_terms, bool)
        in_b[terms[mine]] = True
        # terms that only b has
        lacking = (divergence(none[:, None], p[mine][None, :]) - divergence(none, none[b])[:, None]).sum(axis=1) if mine.any() else np.zeros(n, np.int64)
        shared = np.zeros(n, np.int64)
        shared[has] = np.add.reduceat(np.where(in_b[terms], divergence(of_row, q) - divergence(of_row, none[b]), 0), first)
        out[:, b] += lacking - shared
    return out


PAIR_SCHEMA = "a long, b long, value long"


def _tile(key, got):
    """Sums of one block of terms for the pairs between two tiles of sources."""
    first, second = key[1].as_py(), key[2].as_py()
    marks = got.filter(pc.is_null(got["term"]))
    gid, at = np.unique(marks["gid"].to_numpy(), return_index=True)
    whole, tile = marks["whole"].to_numpy()[at], marks["tile"].to_numpy()[at]
    got = got.filter(pc.is_valid(got["term"]))
    rows = np.searchsorted(gid, got["gid"].to_numpy())
    coded = got["term"].combine_chunks().dictionary_encode() if got.num_rows else None
    terms = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64) if got.num_rows else np.empty(0, np.int64)
    order = np.argsort(rows, kind="stable")
    sums = tile_sums(rows[order], terms[order], got["n"].to_numpy()[order], whole, len(coded.dictionary) if got.num_rows else 0)
    wanted = ~np.eye(len(gid), dtype=bool)
    if first != second:
        wanted &= tile[:, None] != tile[None, :]
    a, b = np.nonzero(wanted)
    return pa.table({"a": gid[a], "b": gid[b], "value": sums[a, b]})


class Audit:
    """Kept terms and groups of a corpus, written once; the two parts are read from them."""

    def __init__(self, docs: DataFrame, min_docs: int = MIN_DOCS, block_entries: int = BLOCK_ENTRIES, tile: int = TILE):
        self.steps, self.block_entries = Steps(docs.sparkSession), block_entries
        # one row a (lang, term) and source: sums over a term's sources
        w = Window.partitionBy("lang", "term")
        spread = term_counts(docs).select("*", F.sum("docs").over(w).alias("in_docs"), F.sum("n").over(w).alias("lang_n"), F.row_number().over(w.orderBy("source")).alias("nth"))
        self.kept = self.steps.stored(spread.where(F.col("in_docs") >= min_docs).drop("in_docs", "docs"), "kept")
        first = F.col("nth") == 1
        langs = self.kept.groupBy("lang").agg(F.sum(F.when(first, F.col("lang_n"))).alias("lang_total"), F.count_if(first).alias("v"), F.count("*").alias("entries"))
        sums = self.kept.groupBy("lang", "source").agg(F.sum("n").alias("total"))
        found = _keyed(docs).select("lang", "source").distinct().join(sums, ["lang", "source"], "left").join(langs, "lang", "left")
        zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
        found = found.select("lang", "source", *[zero(c) for c in ("total", "v", "lang_total", "entries")])
        of_lang = Window.partitionBy("lang")
        numbered = found.withColumn("gid", F.monotonically_increasing_id()).withColumn("tiles", F.ceil(F.count("*").over(of_lang) / tile).cast("int"))
        self.groups = self.steps.stored(numbered.withColumn("tile", F.pmod(F.xxhash64("source"), F.col("tiles")).cast("int")), "groups")

    def _to_tiles(self, rows: DataFrame) -> DataFrame:
        """A copy of each row for every tile that its own meets."""
        other = F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))
        rows = rows.withColumn("other", other)
        return rows.select("lang", F.least("tile", "other").alias("one"), F.greatest("tile", "other").alias("two"), "block", "gid", "tile", "whole", "term", "n")

    def pairs(self) -> DataFrame:
        """(lang, source, item, value) for every ordered pair of a language's sources."""
        blocks = F.greatest(F.lit(1), F.ceil(F.col("entries") / self.block_entries)).cast("int")
        groups = self.groups.select("lang", "source", "gid", "tile", "tiles", (F.col("total") + F.col("v")).alias("whole"), blocks.alias("blocks"))
        entries = self.kept.join(groups, ["lang", "source"]).withColumn("block", F.pmod(F.xxhash64("term"), F.col("blocks")).cast("int"))
        marks = groups.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumns({"term": F.lit(None).cast("string"), "n": F.lit(0).cast("long")})
        # a language without kept terms has no N + V; its sums have no terms, so any number does
        marks = marks.withColumn("whole", F.greatest("whole", F.lit(1)))
        dealt = self._to_tiles(entries).unionByName(self._to_tiles(marks))
        keyed = dealt.withColumn("lot", F.xxhash64("lang", "block"))
        # the language is part of the key through its hash and, against collisions, itself
        sums = keyed.groupBy("lot", "one", "two", "lang").applyInArrow(_tile, PAIR_SCHEMA).groupBy("a", "b").agg(F.sum("value").alias("value"))
        name = self.groups.select(F.col("gid").alias("a"), "lang", "source")
        item = self.groups.select(F.col("gid").alias("b"), F.col("source").alias("item"))
        return sums.join(name, "a").join(item, "b").select("lang", "source", "item", "value")

    def terms(self) -> DataFrame:
        """(lang, source, item, value) for the terms that a source has more often than its language."""
        groups = self.groups.select("lang", "source", (F.col("total") + F.col("v")).alias("whole"), (F.col("lang_total") + F.col("v")).alias("lang_whole"))
        p, q = share_column(F.col("n"), F.col("whole")), share_column(F.col("lang_n"), F.col("lang_whole"))
        rows = self.kept.join(groups, ["lang", "source"]).select("lang", "source", F.col("term").alias("item"), p.alias("p"), q.alias("q")).where("p > q")
        return rows.select("lang", "source", "item", F.expr("(p - q) * (p - q) div q").alias("value"))


def ranked(rows: DataFrame, part: str) -> DataFrame:
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    return rows.select("lang", "source", F.lit(part).alias("part"), "item", F.col("value").cast("long").alias("value"), F.row_number().over(order).alias("rank"))


def audit(docs: DataFrame, top_terms: int = TOP_TERMS) -> DataFrame:
    """lang, source, part, item, value, rank; part 'term' down to rank top_terms, 'pair' whole."""
    found = Audit(docs)
    # the bound on the rank reaches the tasks before the shuffle, so that no group is sorted whole
    top = ranked(found.terms(), "term").where(F.col("rank") <= top_terms)
    return ranked(found.pairs(), "pair").unionByName(top)


def query(spark, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents"))


ORACLE = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w
  FROM documents),
t AS (SELECT r, lang, source, term, count(*) AS n FROM (SELECT r, lang, source, unnest(w) AS term FROM d) GROUP BY ALL),
k AS (SELECT lang, term, sum(n)::BIGINT AS lang_n FROM t GROUP BY lang, term HAVING count(*) >= 3),
c AS (SELECT lang, source, term, sum(n)::BIGINT AS n FROM t SEMI JOIN k USING (lang, term) GROUP BY ALL),
l AS (SELECT lang, count(*) AS v, sum(lang_n)::BIGINT AS lang_total FROM k GROUP BY lang),
g AS (SELECT lang, source, coalesce(any_value(v), 0) AS v, coalesce(any_value(lang_total), 0) AS lang_total,
    coalesce(any_value(total), 0) AS total
  FROM d LEFT JOIN l USING (lang) LEFT JOIN (SELECT lang, source, sum(n)::BIGINT AS total FROM c GROUP BY ALL) USING (lang, source) GROUP BY lang, source),
p AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n,
    1 + 1000000000::HUGEINT * (coalesce(c.n, 0) + 1) // (g.total + g.v) AS p,
    1 + 1000000000::HUGEINT * (k.lang_n + 1) // (g.lang_total + g.v) AS q
  FROM g JOIN k USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
pair AS (SELECT a.lang, a.source, b.source AS item, coalesce(s.value, 0)::BIGINT AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN (SELECT x.lang, x.source, y.source AS item, sum((x.p - y.p) * (x.p - y.p) // y.p) AS value
    FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL) s
  ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
term AS (SELECT lang, source, term AS item, ((p - q) * (p - q) // q)::BIGINT AS value FROM p WHERE n > 0 AND p > q)
SELECT * FROM (
  SELECT lang, source, 'pair' AS part, item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item)::INTEGER AS rank FROM pair
  UNION ALL
  SELECT lang, source, 'term' AS part, item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item)::INTEGER AS rank FROM term)
WHERE part = 'pair' OR rank <= 200
"""
