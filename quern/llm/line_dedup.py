r"""Line dedup by a deletion-neighbourhood join, edit bound one character.

Two lines within one edit agree once the right character is deleted: they emit
an equal variant. To emit few variants for long lines, the place of the edit is
narrowed first with variants that delete whole blocks: lines of m and m or m+1
characters that are one edit apart agree outside one block of the shorter. Only
a block in which a line still has company is searched more finely, down to
single characters:

  level 1   two blocks, hashes made while the lines are first read
  level 2   blocks of a 32nd of the line, for lines with company at level 1
  level 3   one variant per character of a block with company at level 2

At level 3 variants are kept apart by kind (substitution at p; insertion), so
equal variants mean one edit exactly, the earliest of a group is a minimum, and
no pairs within a group are made. Hits are verified with the edit distance of
the texts.

Company and minima are counted by group-bys that combine before the shuffle,
written, and joined back: a variant that a third of the lines share is one row
for each task, and adaptive execution can split the join that follows. Joins of
texts, lines and keys are sort-merge joins at every size.

What goes: of equal lines that are not blank all but the earliest by (doc_id,
text hash, line); and every line of near_chars characters or more that has an
earlier line of as many within one edit. Shorter lines are compared for
equality only: one edit in a few characters makes another line (``A1``, ``A2``).

Defined results: null texts stay null, empty texts empty; blank lines stay;
rows equal in id and text count as one document and keep the same lines; null
ids come first; a document that loses all lines keeps an empty text; further
columns pass through, whatever their names; an empty table gives no rows; a
text must fit into a task. Everything runs in DataFrame functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Steps, fresh, named

#: Shorter lines go as exact repeats only.
NEAR_CHARS = 24
FINE_BLOCKS = 32
KEYS = ("d", "t", "l")
#: A line with a character that is no separator of words.
NOT_BLANK = r"[^\x20\x09-\x0D]"


def _without(line: Column, n: Column, m: Column, start: Column, width: Column) -> tuple[Column, Column]:
    """The line's parts left of a block of its base length m, and right of it, aligned at the end."""
    rest = F.greatest(m - start - width, F.lit(0))
    return F.substring(line, F.lit(1), start), F.when(rest > 0, F.substring(line, n - rest + 1, rest)).otherwise("")


def _block_key(level: int, line: Column, n: Column, m: Column, c: Column, width: Column) -> Column:
    left, right = _without(line, n, m, c * width, width)
    return F.xxhash64(F.lit(level), m, c, left, right)


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").alias("d"), F.xxhash64("text").alias("t"), "text")


def lines_of(docs: DataFrame, near_chars: int = NEAR_CHARS) -> DataFrame:
    """(d, t, l, h1, h2, n, k): lines that are not blank, without their text; k are the level 1 keys, null for short lines."""
    rows = _texts(docs).select("d", "t", F.posexplode(F.split("text", "\n")).alias("l", "line")).where(F.col("line").rlike(NOT_BLANK))
    rows = rows.withColumn("n", F.length("line"))
    keys = []
    for less in (0, 1):
        m = F.col("n") - less
        width = F.ceil(m / 2).cast("int")
        keys += [_block_key(1, F.col("line"), F.col("n"), m, F.lit(c), width) for c in (0, 1)]
    return rows.select(*KEYS, F.xxhash64(F.lit(1), "line").alias("h1"), F.xxhash64(F.lit(2), "line").alias("h2"), "n", F.when(F.col("n") >= near_chars, F.array(*keys)).alias("k"))


def _on(left: tuple, right: str) -> Column:
    """Columns left equal (d, t, l) with a prefix; ids may be null."""
    d, t, *rest = left
    out = F.col(d).eqNullSafe(F.col(right + "d")) & (F.col(t) == F.col(right + "t"))
    for name in rest:
        out = out & (F.col(name) == F.col(right + "l"))
    return out


def _prefixed(df: DataFrame, prefix: str, *more: str) -> DataFrame:
    return df.select(*[F.col(c).alias(prefix + c) for c in KEYS], *more)


def _with_company(steps: Steps, rows: DataFrame, label: str) -> DataFrame:
    """The rows whose key occurs again."""
    again = steps.stored(rows.groupBy("key").agg(F.count("*").alias("c")).where("c > 1").select(F.col("key").alias("again")), label)
    return rows.join(again.hint("merge"), F.col("key") == F.col("again")).drop("again")


def near_lines(steps: Steps, docs: DataFrame, first: DataFrame) -> DataFrame:
    """(d, t, l) of first occurrences that have an earlier line within one edit.

    first: (d, t, l, n, k) of distinct lines.
    """
    tagged = F.transform("k", lambda key, i: F.struct(key.alias("key"), (F.col("n") - (i > 1).cast("int")).alias("m"), (i % 2).alias("c")))
    one = first.where(F.col("k").isNotNull()).select(*KEYS, F.explode(tagged).alias("x")).select(*KEYS, "x.key", "x.m", "x.c")
    one = _with_company(steps, one, "company-1")
    # as many entries as the document has lines, times four
    wanted = one.groupBy(*KEYS).agg(F.collect_set(F.struct("m", "c")).alias("blocks")).groupBy("d", "t").agg(F.collect_list(F.struct("l", "blocks")).alias("wanted"))
    wanted = steps.stored(wanted.select(F.col("d").alias("w_d"), F.col("t").alias("w_t"), "wanted"), "wanted")
    found = _texts(docs).join(wanted.hint("merge"), _on(("d", "t"), "w_")).select("d", "t", F.split("text", "\n").alias("lines"), F.explode("wanted").alias("w"))
    found = found.select("d", "t", "w.l", F.col("lines")[F.col("w.l")].alias("line"), "w.blocks").dropDuplicates(list(KEYS))
    found = steps.stored(found, "lines")
    steps.drop(wanted)

    def fine_blocks(b: Column) -> Column:
        width, half = F.ceil(b["m"] / FINE_BLOCKS).cast("int"), F.ceil(b["m"] / 2).cast("int")
        low = F.floor(b["c"] * half / width).cast("int")
        high = F.floor((F.least(b["m"], (b["c"] + 1) * half) - 1) / width).cast("int")
        return F.transform(F.sequence(low, high), lambda c: F.struct(b["m"].alias("m"), c.alias("c"), width.alias("width")))

    # a middle block may come from both halves
    fine = found.select(*KEYS, "line", F.length("line").alias("n"), F.explode(F.array_distinct(F.flatten(F.transform("blocks", fine_blocks)))).alias("b"))
    fine = fine.select(*KEYS, "b.m", "b.c", "b.width", _block_key(2, F.col("line"), F.col("n"), F.col("b.m"), F.col("b.c"), F.col("b.width")).alias("key"))
    two = _with_company(steps, fine, "company-2").groupBy(*KEYS).agg(F.collect_set(F.struct("m", "c", "width")).alias("fine"))

    again = found.select(*KEYS, "line").join(_prefixed(two, "w_", "fine").hint("merge"), _on(KEYS, "w_")).select(*KEYS, "line", F.explode("fine").alias("b"))
    spots = again.select(*KEYS, "line", F.length("line").alias("n"), "b.m", (F.col("b.c") * F.col("b.width")).alias("start"), "b.width")
    same_length = F.col("n") == F.col("m")
    stop = F.least(F.col("start") + F.col("width"), F.col("m")) - same_length.cast("int")

    def cut(p: Column) -> Column:
        line = F.col("line")
        return F.concat(F.substring(line, F.lit(1), p), F.substring(line, p + 2, F.col("n")))

    deleted = F.transform(
        F.sequence(F.col("start"), stop),
        lambda p: F.struct(F.when(same_length, F.xxhash64(F.lit(3), F.col("n"), p, cut(p))).otherwise(F.xxhash64(F.lit(4), F.col("m"), cut(p))).alias("key"), F.when(same_length, "s").otherwise("long").alias("kind")),
    )
    own = F.when(same_length, F.array(F.struct(F.xxhash64(F.lit(4), F.col("n"), F.col("line")).alias("key"), F.lit("short").alias("kind")))).otherwise(F.array().cast("array<struct<key:bigint,kind:string>>"))
    variants = spots.select(*KEYS, F.explode(F.concat(deleted, own)).alias("v")).select("v.key", "v.kind", F.struct(*KEYS).alias("p"))
    variants = steps.stored(variants, "variants")

    def of(kind: str) -> Column:
        return F.when(F.col("kind") == kind, F.col("p"))

    least = variants.groupBy("key").agg(*[F.min(of(k)).alias(f"min_{k}") for k in ("s", "short", "long")], F.max(of("s")).alias("max_s"))
    least = steps.stored(least.where("min_s < max_s OR (min_short IS NOT NULL AND min_long IS NOT NULL)").withColumnRenamed("key", "least_key"), "least")
    other = F.when(F.col("kind") == "s", F.col("min_s")).when(F.col("kind") == "short", F.col("min_long")).otherwise(F.col("min_short"))
    hits = variants.join(least, F.col("key") == F.col("least_key")).withColumn("o", other).where(F.col("o") < F.col("p"))
    hits = hits.select("p.*", F.col("o.d").alias("o_d"), F.col("o.t").alias("o_t"), F.col("o.l").alias("o_l")).distinct()
    hits = hits.join(_prefixed(found, "w_", F.col("line").alias("mine")), _on(KEYS, "w_")).select(*KEYS, "o_d", "o_t", "o_l", "mine")
    hits = hits.join(_prefixed(found, "w_", F.col("line").alias("theirs")), _on(("o_d", "o_t", "o_l"), "w_"))
    near = steps.stored(hits.where(F.levenshtein("mine", "theirs", 1) >= 0).select(*KEYS).distinct(), "near-lines")
    steps.drop(found, variants, least)
    return near


def removed_lines(docs: DataFrame, near_chars: int = NEAR_CHARS) -> DataFrame:
    """(d, t, gone): for documents that lose lines, the indexes of those lines."""
    steps = Steps(docs.sparkSession)
    lines = steps.stored(lines_of(docs, near_chars), "line-hashes")
    place = F.struct(*KEYS)
    # equal lines have equal length and keys, so any of the values will do
    firsts = lines.groupBy("h1", "h2").agg(F.min(place).alias("p"), F.count("*").alias("c"), F.first("n").alias("n"), F.first("k").alias("k"))
    firsts = steps.stored(firsts.select("h1", "h2", "p.*", "c", "n", "k"), "distinct-lines")
    near = near_lines(steps, docs, firsts.select(*KEYS, "n", "k"))
    judged = firsts.join(_prefixed(near, "w_", F.lit(True).alias("near")), _on(KEYS, "w_"), "left")
    # lines that occur once and have no near line are no concern
    concern = judged.where("c > 1 OR near").select(F.col("h1").alias("g1"), F.col("h2").alias("g2"), F.struct(*KEYS).alias("first"), F.coalesce("near", F.lit(False)).alias("near"))
    hit = lines.join(concern.hint("merge"), (F.col("h1") == F.col("g1")) & (F.col("h2") == F.col("g2"))).where(F.col("near") | ~place.eqNullSafe(F.col("first")))
    gone = steps.stored(hit.groupBy("d", "t").agg(F.collect_set("l").alias("gone")), "gone-lines")
    steps.drop(lines, firsts, near)
    return gone


def _joined(docs: DataFrame, near_chars: int) -> tuple[DataFrame, Column, Column]:
    """docs joined with its lost lines, the column of their indexes, the text that is kept."""
    d, t, k, gone = fresh(docs.columns, "gone_d", "gone_t", "text_key", "gone")
    lost = removed_lines(docs.select("doc_id", "text"), near_chars).select(F.col("d").alias(d), F.col("t").alias(t), F.col("gone").alias(gone))
    joined = docs.withColumn(k, F.xxhash64("text")).join(lost.hint("merge"), F.col("doc_id").eqNullSafe(F.col(d)) & (F.col(k) == F.col(t)), "left")
    kept = F.filter(F.split("text", "\n"), lambda line, i: ~F.array_contains(gone, i))
    return joined, F.col(gone), F.when(F.col(gone).isNull(), F.col("text")).otherwise(F.array_join(kept, "\n"))


def dedup_lines(docs: DataFrame, near_chars: int = NEAR_CHARS) -> DataFrame:
    """The documents with repeated and nearly repeated lines taken out of text."""
    joined, _, kept = _joined(docs, near_chars)
    return joined.select(*[kept.alias(c) if c == "text" else named(c) for c in docs.columns])


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    joined, gone, kept = _joined(docs, NEAR_CHARS)
    n_lines = F.when(F.col("text").isNull(), 0).otherwise(F.size(F.split("text", "\n")))
    return joined.select("doc_id", n_lines.cast("long").alias("n_lines"), F.coalesce(F.size(gone), F.lit(0)).cast("long").alias("n_removed"), F.sha2(F.coalesce(kept, F.lit("")), 256).alias("kept_sha256"))


ORACLE = r"""
WITH l AS (SELECT doc_id, text, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS i FROM documents WHERE text IS NOT NULL),
e AS (SELECT doc_id, i, line, length(line) AS n FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
f AS (SELECT line, n, min({'d': doc_id, 'i': i}) AS p FROM e GROUP BY line, n),
k AS (SELECT line, n, p, m, left(line, CAST(ceil(m / 2) AS BIGINT)) AS a, right(line, m - CAST(ceil(m / 2) AS BIGINT)) AS b
      FROM (SELECT *, unnest([n, n - 1]) AS m FROM f WHERE n >= 24)),
c AS (SELECT x.line, x.p AS xp, y.line AS other, y.p AS yp FROM k x JOIN k y ON x.m = y.m AND x.a = y.a WHERE y.p < x.p
      UNION SELECT x.line, x.p, y.line, y.p FROM k x JOIN k y ON x.m = y.m AND x.b = y.b WHERE y.p < x.p),
near AS (SELECT DISTINCT line FROM c WHERE levenshtein(line, other) <= 1),
g AS (SELECT e.doc_id, e.i FROM e JOIN f USING (line) WHERE f.p <> {'d': e.doc_id, 'i': e.i} OR e.line IN (SELECT line FROM near)),
t AS (SELECT l.doc_id, count(*) AS n_lines, count(g.i) AS n_removed, string_agg(CASE WHEN g.i IS NULL THEN line END, chr(10) ORDER BY l.i) AS kept
      FROM l LEFT JOIN g ON l.doc_id = g.doc_id AND l.i = g.i GROUP BY l.doc_id)
SELECT d.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM documents d LEFT JOIN t USING (doc_id)
"""
