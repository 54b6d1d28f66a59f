"""Benchmark decontamination with a broadcast hash set of normalised test n-grams.

Documents are cut into words, the hash of every window is looked up in the set
of the benchmark's window hashes, and each hit is verified on the words
themselves. Windows have n words; items of fewer words count as one window of
their own length. All lengths are hashed in one pass over the texts.

Texts are taken in pieces of PIECE_WORDS words, which rows of (hash, place)
carry along, so time is in proportion to the words, however long a text is. The
hash set is broadcast while it measures MAX_BROADCAST_BYTES or less (about 1.6
million windows). Beyond that the rows go without words, are joined with the
hashes by shuffle, and only documents with a hit are read again for their words.

Defined results: null and empty texts have no words and no hits; items without
words have no window; equal windows of several items hit all of them; repeated
rows (equal id and text) each get their own full result; an empty benchmark
hits nothing; an empty table gives no rows; further columns pass through
untouched, whatever their names; a text of any length is judged whole and must
fit into a task. Everything runs in DataFrame functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Steps, ascii_lower, fresh, named

#: What separates words, before A-Z are lower-cased.
GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"
#: Words of a text that its windows' rows carry.
PIECE_WORDS = 256
#: The largest broadcast set of window hashes, and what a hash takes in it.
MAX_BROADCAST_BYTES, HASH_BYTES = 64 << 20, 40


def raw_words(text: Column) -> Column:
    """The words as they stand; letters A-Z not yet lower-cased."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), GAP + "+"), "")


def _window_text(words: Column, start: Column, length) -> Column:
    return ascii_lower(F.array_join(F.slice(words, start + 1, length), " "))


def benchmark_windows(benchmark: DataFrame, n: int) -> DataFrame:
    """(len, hash, window, items): every distinct window and the items it is in."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item"), raw_words(F.col("text")).alias("w")).where(F.size("w") > 0)
    size = F.least(F.size("w"), F.lit(n))
    starts = items.select("item", "w", size.alias("len"), F.explode(F.sequence(F.lit(0), F.size("w") - size)).alias("at"))
    seen = starts.select("item", "len", _window_text(F.col("w"), F.col("at"), F.col("len")).alias("window"))
    return seen.groupBy("len", "window").agg(F.collect_set("item").alias("items")).withColumn("hash", F.xxhash64(_word_hashes(F.split("window", " "))))


def _word_hashes(words: Column) -> Column:
    """Case is folded for all letters here: faster, and equal under A-Z alone implies equal."""
    return F.transform(words, lambda w: F.xxhash64(F.lower(w)))


def _hash_windows(words: Column, lengths: list[int]) -> Column:
    """Hashes of all windows of the first length, then of the next, and so on."""
    n = F.size(words)

    def of(h: Column, length: int) -> Column:
        starts = F.when(n >= length, F.sequence(F.lit(1), n - (length - 1))).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.xxhash64(F.slice(h, i, length)))

    # an array of one element binds the word hashes, so they are made once per text
    return F.transform(F.array(_word_hashes(words)), lambda h: F.concat(*[of(h, x) for x in lengths]))[0]


def _place(p: Column, n: Column, lengths: list[int]) -> Column:
    """struct(at, len) of the p-th hash of a text of n words."""
    out, before = None, F.lit(0)
    for length in lengths:
        spot = F.struct((p - before).alias("at"), F.lit(length).alias("len"))
        before = before + F.greatest(n - (length - 1), F.lit(0))
        out = F.when(p < before, spot) if out is None else out.when(p < before, spot)
    return out


def window_rows(docs: DataFrame, lengths: list[int], keep_words: bool) -> DataFrame:
    """(doc_id, text_key, begin, n, p, hash[, w]): a row for each window of the documents, text by text in pieces of
    PIECE_WORDS: n words (and w, these) from word begin on, the p-th window of the piece.

    Rows that carried all words of their text would take time by the square of its length. Pieces overlap, so that no
    window is cut; a short window may come from two pieces, at one place.
    """
    base = docs.select("doc_id", F.xxhash64("text").alias("text_key"), raw_words(F.col("text")).alias("w"))
    reach = PIECE_WORDS + max(lengths) - 1
    begins = F.sequence(F.lit(0), F.greatest(F.size("w") - 1, F.lit(0)), F.lit(PIECE_WORDS))
    pieces = base.select("doc_id", "text_key", F.explode(F.transform(begins, lambda i: F.struct(i.alias("begin"), F.slice("w", i + 1, reach).alias("w")))).alias("x")).select("doc_id", "text_key", "x.*")
    return pieces.select("doc_id", "text_key", "begin", F.size("w").alias("n"), *["w"] * keep_words, F.posexplode(_hash_windows(F.col("w"), lengths)).alias("p", "hash"))


def hits(docs: DataFrame, benchmark: DataFrame, n: int = 10) -> DataFrame:
    """(doc_id, text_key, at, len, items): verified occurrences in the documents, some of them twice."""
    steps = Steps(docs.sparkSession)
    windows = steps.stored(benchmark_windows(benchmark, n), "windows")
    counted = windows.groupBy("len").agg(F.count("*").alias("c")).collect()  # n rows at most
    lengths = sorted(r["len"] for r in counted) or [n]
    hashes = windows.select("hash").distinct()
    if sum(r["c"] for r in counted) * HASH_BYTES <= MAX_BROADCAST_BYTES:
        # what is joined here carries its piece's words as far as the text of the few hits, and is not shuffled
        found = window_rows(docs, lengths, True).join(F.broadcast(hashes), "hash", "left_semi")
        found = found.withColumn("place", _place(F.col("p"), F.col("n"), lengths)).withColumn("from", F.col("place.at"))
    else:
        # without the hint the planner may take the exploded documents for the small side
        found = window_rows(docs, lengths, False).join(hashes.hint("merge"), "hash", "left_semi")
        found = found.withColumn("place", _place(F.col("p"), F.col("n"), lengths))
        # as many entries as the document has windows
        spots = found.groupBy("doc_id", "text_key").agg(F.collect_set(F.struct("begin", "place", "hash")).alias("spots")).select(F.col("doc_id").alias("spot_d"), F.col("text_key").alias("spot_t"), "spots")
        texts = docs.select("doc_id", F.xxhash64("text").alias("text_key"), "text")
        again = texts.join(spots, F.col("doc_id").eqNullSafe(F.col("spot_d")) & (F.col("text_key") == F.col("spot_t")))
        words = again.select("doc_id", "text_key", "spots", raw_words(F.col("text")).alias("w"))
        # each spot with its own words only
        own = F.transform("spots", lambda s: F.struct(s["begin"].alias("begin"), s["place"].alias("place"), s["hash"].alias("hash"), F.slice(F.col("w"), s["begin"] + s["place"]["at"] + 1, s["place"]["len"]).alias("w")))
        found = words.select("doc_id", "text_key", F.explode(own).alias("s")).select("doc_id", "text_key", "s.*").withColumn("from", F.lit(0))
    # never null, so that no test for null is pushed down, which would make the text of every window
    text = F.coalesce(_window_text(F.col("w"), F.col("from"), F.col("place.len")), F.lit(""))
    found = found.select("doc_id", "text_key", (F.col("begin") + F.col("place.at")).alias("at"), "place.len", "hash", text.alias("text"))
    known = windows.select(F.col("hash").alias("known"), "window", "items")
    return found.join(known, (F.col("hash") == F.col("known")) & (F.col("text") == F.col("window"))).select("doc_id", "text_key", "at", "len", "items")


def covered(found: DataFrame) -> DataFrame:
    """(doc_id, text_key, n_hit, items): words under any occurrence, and items, per document."""
    one = found.dropDuplicates(["doc_id", "text_key", "at", "len"])
    w = Window.partitionBy("doc_id", "text_key").orderBy("at", "len").rowsBetween(Window.unboundedPreceding, -1)
    end = F.col("at") + F.col("len")
    new = F.greatest(F.lit(0), end - F.greatest(F.col("at"), F.coalesce(F.max(end).over(w), F.lit(0))))
    return (
        one.withColumn("new", new)
        .groupBy("doc_id", "text_key")
        .agg(F.sum("new").alias("n_hit"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"))
    )


def report(docs: DataFrame, benchmark: DataFrame, n: int = 10) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items, contaminated for every row."""
    per_doc = covered(hits(docs, benchmark, n)).select(F.col("doc_id").alias("_d"), F.col("text_key").alias("_k"), "n_hit", "items")
    base = docs.select("doc_id", F.xxhash64("text").alias("text_key"), F.size(raw_words(F.col("text"))).cast("long").alias("n_words"))
    joined = base.join(per_doc, base["doc_id"].eqNullSafe(F.col("_d")) & (F.col("text_key") == F.col("_k")), "left")
    hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    items = F.coalesce("items", F.array().cast("array<string>"))
    return joined.select("doc_id", "n_words", hit.alias("n_hit"), F.size(items).cast("long").alias("n_items"), items.alias("items"), (hit > 0).alias("contaminated"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, n: int = 10, mode: str = "document") -> DataFrame:
    """The documents without contamination, all columns kept.

    mode "document" drops documents with a hit; "span" keeps every document and
    takes hit words, with the separators after them, out of its text.
    """
    if mode not in ("document", "span"):
        raise ValueError("mode is 'document' or 'span'")
    d, t, k, p = fresh(docs.columns, "hit_d", "hit_t", "text_key", "hit_words")
    found = hits(docs.select("doc_id", "text"), benchmark, n).select(F.col("doc_id").alias(d), F.col("text_key").alias(t), "at", "len")
    keyed = docs.withColumn(k, F.xxhash64("text"))
    same = F.col("doc_id").eqNullSafe(F.col(d)) & (F.col(k) == F.col(t))
    if mode == "document":
        return keyed.join(found.select(d, t).distinct(), same, "left_anti").drop(k)
    spots = found.select(d, t, F.explode(F.sequence("at", F.expr("at + len - 1"))).alias("word")).groupBy(d, t).agg(F.collect_set("word").alias(p))
    lead = F.regexp_extract("text", f"^{GAP}*", 0)
    tokens = F.expr(f"regexp_extract_all(text, r'{WORD}+{GAP}*', 0)")
    kept = F.concat(lead, F.array_join(F.filter(tokens, lambda token, i: ~F.array_contains(p, i)), ""))
    text = F.when(F.col(p).isNull(), F.col("text")).otherwise(kept)
    return keyed.join(spots, same, "left").select(*[text.alias(c) if c == "text" else named(c) for c in docs.columns])


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = report(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return out.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


ORACLE = r"""
WITH iw AS (
  SELECT item_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark),
ig AS (SELECT DISTINCT CAST(item_id AS VARCHAR) AS item, least(len(w), 10) AS l,
         array_to_string(list_slice(w, p, p + least(len(w), 10) - 1), ' ') AS g
       FROM (SELECT item_id, w, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS p FROM iw WHERE len(w) > 0)),
dw AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
dg AS (SELECT doc_id, l, p, array_to_string(list_slice(w, p, p + l - 1), ' ') AS g
       FROM (SELECT doc_id, w, l, unnest(range(1, len(w) - l + 2)) AS p FROM dw, (SELECT DISTINCT l FROM ig) WHERE len(w) >= l)),
h AS (SELECT DISTINCT doc_id, p, l, item FROM dg JOIN ig USING (l, g)),
c AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + l)) AS q FROM h) GROUP BY doc_id),
i AS (SELECT doc_id, count(*) AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS s FROM (SELECT DISTINCT doc_id, item FROM h) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       coalesce(s, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN c USING (doc_id) LEFT JOIN i USING (doc_id)
"""
