r"""Quality rules: counts of words, symbols, repeated lines and windows, then the
divergence of a document's histograms from language references.

References are learned over all documents with a language: shares of character
classes and of each language's most common words, case folded. A document is compared with
every language by Jensen-Shannon distance (base 2, 0 to 1); it is kept if the
nearest language is near enough in both histograms. Documents too short for a
histogram are not judged by it.

Defined results: null and empty texts have no words, fail the base rule and are
not kept; without any labelled document there is no reference and the base rule
decides alone; rows with a null or clashing language are judged like others;
repeated rows get equal results; an empty table gives no rows; texts of any
length are judged whole and must fit into a task; further columns are ignored,
whatever their names.

The texts are read three times: for the counts of the base rule and of the
character classes, which are written; for the word counts of each language; and,
with the common words known, for the word histograms. Only row keys and numbers
are joined.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Steps

GAP = r"[\x20\x09-\x0D]"
LETTERS = "[a-z]+"
CLASSES = {
    "upper": "[A-Z]+",
    "digit": "[0-9]+",
    "space": r"[\x00-\x20]+",
    "point": r"[.,;:!?'\"()\-]+",
    "mark": r"[#$%&*+/<=>@\[\\\]^_`{|}~\x7F]+",
}
#: Common words per language.
COMMON = 24
#: Shorter documents are not judged by the histogram.
MIN_CHARS, MIN_WORDS = 200, 50
#: Largest distance in classes of a kept document; of 3,267 labelled clean texts of sf0.1 the farthest is 0.296 away.
MAX_CLASS_DISTANCE = 0.30
#: Largest distance in words, as a share of the distance of a text with none of a language's common words. That one
#: follows from the references (0.352 on sf0.001, 0.363 on sf0.01, 0.365 on sf0.1); the farthest clean text has 0.962 of it.
MAX_WORD_SHARE = 0.985


def let(value: Column, body) -> Column:
    """body(value) with the value computed once per row."""
    return F.transform(F.array(value), body)[0]


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), GAP + "+"), "")


def _removed(text: Column, pattern: str) -> Column:
    return F.length(text) - F.length(F.regexp_replace(text, pattern, ""))


def repeated_words(words: Column, width: int = 5) -> Column:
    """Words inside windows that occur twice or more in the list."""
    n = F.size(words)
    hashes = let(F.transform(words, lambda w: F.xxhash64(w)), lambda h: F.transform(F.sequence(F.lit(1), n - (width - 1)), lambda i: F.xxhash64(F.slice(h, i, width))))

    def spread(starts: Column) -> Column:
        gaps = F.transform(starts, lambda p, k: F.coalesce(F.least(F.lit(width), F.get(starts, k + 1) - p), F.lit(width)))
        return F.aggregate(gaps, F.lit(0), lambda a, g: a + g)

    def counted(h: Column) -> Column:
        pairs = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

        def of(s: Column) -> Column:
            again = F.filter(s, lambda x, k: F.coalesce(F.get(s, k - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get(s, k + 1)["h"] == x["h"], F.lit(False)))
            return let(F.sort_array(F.transform(again, lambda x: x["i"])), spread)

        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(let(pairs, of))

    return F.when(n <= width, F.lit(0)).otherwise(let(hashes, counted))


def base_counts(docs: DataFrame) -> DataFrame:
    """(doc_id, text_key, lang, n_chars, the counts of the base rule, classes) of docs(doc_id, text, lang)."""
    text = F.coalesce("text", F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    out = docs.select("doc_id", "text", "lang", F.xxhash64("text").alias("text_key"), words_of(F.col("text")).alias("w"), F.regexp_replace(text, LETTERS, "").alias("rest"), lines.alias("lines"))
    return out.select(
        "doc_id",
        "text_key",
        "lang",
        F.length(text).alias("n_chars"),
        F.size("w").cast("long").alias("n_words"),
        (F.length(text) - _removed(F.col("rest"), GAP + "+")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace("rest", "[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        repeated_words(F.col("w")).cast("long").alias("n_repeat_words"),
        F.array(*class_counts(text, F.col("rest"))).alias("classes"),
    )


def class_counts(text: Column, rest: Column) -> list[Column]:
    """a-z, one count per class of CLASSES, then all other characters; rest is the text without a-z."""
    counts = [F.length(text) - F.length(rest), *[_removed(rest, p) for p in CLASSES.values()]]
    beyond = F.length(F.regexp_replace(rest, r"[\x00-\x7F]+", ""))
    return [c.cast("double") for c in (*counts, beyond)]


def class_references(counted: DataFrame) -> dict[str, list[float]]:
    """Per language the shares of the character classes, over all counted documents."""
    names = range(len(CLASSES) + 2)
    sums = counted.where(F.col("lang").isNotNull()).groupBy("lang").agg(*[F.sum(F.col("classes")[i]).alias(f"c{i}") for i in names])
    out = {}
    for r in sums.collect():
        total = sum(r[f"c{i}"] for i in names)
        if total:
            out[r["lang"]] = [r[f"c{i}"] / total for i in names]
    return out


def folded_words(text: Column) -> Column:
    return words_of(F.lower(text))


def word_references(steps: Steps, docs: DataFrame) -> dict[str, dict[str, float]]:
    """Per language the shares of its most common words, counted over all documents with a language;
    what reaches the driver is languages x COMMON rows."""
    words = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("lang", F.explode(folded_words(F.col("text"))).alias("w"))
    # both uses below read the written counts, so the texts are split once
    counts = steps.stored(words.groupBy("lang", "w").agg(F.count("*").alias("n")), "word-counts")
    total = {r["lang"]: r["n"] for r in counts.groupBy("lang").agg(F.sum("n").alias("n")).collect()}
    common: dict[str, dict[str, float]] = {}
    top = counts.withColumn("k", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "w"))).where(F.col("k") <= COMMON)
    for r in top.orderBy("lang", "k").collect():
        common.setdefault(r["lang"], {})[r["w"]] = r["n"] / total[r["lang"]]
    steps.drop(counts)
    return common


def divergence(p: Column, q: list[float]) -> Column:
    """Jensen-Shannon distance (square root of the divergence) of two share lists."""

    def term(a: Column, b: Column) -> Column:
        m = (a + b) / 2
        return F.when(a > 0, a * F.log2(a / m)).otherwise(0.0) + F.when(b > 0, b * F.log2(b / m)).otherwise(0.0)

    parts = F.zip_with(p, F.array(*[F.lit(float(x)) for x in q]), term)
    return F.sqrt(F.greatest(F.lit(0.0), F.aggregate(parts, F.lit(0.0), lambda a, t: a + t) / 2))


def empty_distance(shares: list[float]) -> float:
    """The distance from these shares (of common words, the rest left out) of a text with none of the words."""
    rest = max(0.0, 1 - sum(shares))
    middle = (1 + rest) / 2
    # half of every share is its own mean; what is left meets a share of one
    parts = sum(shares) + math.log2(1 / middle) + (rest * math.log2(rest / middle) if rest else 0.0)
    return math.sqrt(parts / 2)


def class_distance(classes: dict) -> Column:
    """Of a counted document to the nearest language, null if it is too short."""
    shares = let(F.col("n_chars"), lambda n: F.transform("classes", lambda x: x / n))
    near = let(shares, lambda p: F.least(*[divergence(p, q) for q in classes.values()], F.lit(1.0))) if classes else F.lit(0.0)
    return F.when(F.col("n_chars") >= MIN_CHARS, near)


def vocabulary_counts(words: Column, vocabulary: list[str]) -> Column:
    """How often each word of a sorted vocabulary is in the list, in its order: the list's own and one of each are
    sorted, so that each has one run; the time of a sort, whatever the number of languages."""

    def runs(s: Column) -> Column:
        ends = F.filter(F.sequence(F.lit(1), F.size(s)), lambda e: F.coalesce(F.get(s, e) != F.get(s, e - 1), F.lit(True)))
        return let(ends, lambda r: F.transform(r, lambda e, k: e - F.coalesce(F.get(r, k - 1), F.lit(0)) - 1))

    return let(F.sort_array(F.concat(F.filter(words, lambda w: w.isin(vocabulary)), F.array(*[F.lit(w) for w in vocabulary]))), runs)


def word_distances(docs: DataFrame, common: dict) -> DataFrame:
    """(doc_id, text_key, word_distance, word_share): to the nearest language, as it is and as a share of the distance
    of a text with none of its words, for texts that are long enough."""
    out = docs.select("doc_id", F.xxhash64("text").alias("text_key"), folded_words(F.col("text")).alias("w")).where(F.size("w") >= MIN_WORDS)
    vocabulary = sorted({w for words in common.values() for w in words})
    if not vocabulary:
        return out.select("doc_id", "text_key", *[F.lit(None).cast("double").alias(c) for c in ("word_distance", "word_share")])
    shares_of = let(F.size("w"), lambda n: F.transform(vocabulary_counts(F.col("w"), vocabulary), lambda k: k / n))
    out = out.select("doc_id", "text_key", shares_of.alias("k"))
    per_language, shares = [], []
    for words in common.values():
        own = [F.col("k")[vocabulary.index(w)] for w in words]
        p = let(F.array(*own), lambda v: F.concat(v, F.array(F.greatest(F.lit(0.0), 1 - F.aggregate(v, F.lit(0.0), lambda a, x: a + x)))))
        q = [*words.values()]
        per_language.append(divergence(p, [*q, max(0.0, 1 - sum(q))]))
        shares.append(1 / empty_distance(q))
    # an array, so that each distance is computed once
    out = out.select("doc_id", "text_key", F.array(*per_language).alias("far"))
    relative = [F.col("far")[i] * s for i, s in enumerate(shares)]
    return out.select("doc_id", "text_key", F.array_min("far").alias("word_distance"), F.least(*relative, F.lit(float("inf"))).alias("word_share"))


def judge(docs: DataFrame) -> DataFrame:
    """doc_id, the base counts, both distances, base_failed and kept for every row."""
    docs = docs.select("doc_id", "text", "lang")
    steps = Steps(docs.sparkSession)
    counted = steps.stored(base_counts(docs), "counts")
    far = word_distances(docs, word_references(steps, docs))
    # rows equal in id and text have equal distances
    far = far.groupBy(F.col("doc_id").alias("far_d"), F.col("text_key").alias("far_t")).agg(*[F.max(c).alias(c) for c in ("word_distance", "word_share")])
    out = counted.join(far, F.col("doc_id").eqNullSafe(F.col("far_d")) & (F.col("text_key") == F.col("far_t")), "left")
    out = out.withColumn("class_distance", class_distance(class_references(counted)))
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    near = F.coalesce(F.col("class_distance") <= MAX_CLASS_DISTANCE, F.lit(True)) & F.coalesce(F.col("word_share") <= MAX_WORD_SHARE, F.lit(True))
    names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    return out.select(*names, failed.alias("base_failed"), (~failed & near).alias("kept"), "class_distance", "word_distance", "word_share")


def query(spark, sf_dir: str) -> DataFrame:
    return judge(spark.read.parquet(f"{sf_dir}/documents.parquet"))
