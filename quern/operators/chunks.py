"""Chunks that end where the content of a text changes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.text import let

#: Stands for the space between two sentences while patterns are tried over their join; patterns say \s.
JOIN = "\x0b"


def sentence_items(sentence: Column, dims: int) -> Column:
    """The direction of a sentence: the coordinates, of so many, that its tokens hash to, once each."""
    return F.array_distinct(F.transform(T.tokens(sentence), lambda w: F.pmod(F.crc32(F.encode(w, "UTF-8")), F.lit(dims)).cast("int")))


def _cosine(a: Column, b: Column) -> Column:
    both = F.sqrt((F.size(a) * F.size(b)).cast("double"))
    return F.when(both > 0, F.size(F.array_intersect(a, b)) / both).otherwise(0.0)


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, x: s + x)


def _drops(items: Column) -> Column:
    """For each sentence: is the next one less like it than the mean less half a deviation of the text?"""
    after = F.slice(items, F.lit(2), F.size(items))
    near = F.zip_with(F.slice(items, F.lit(1), F.greatest(F.size(items) - 1, F.lit(0))), after, _cosine)

    def marked(s: Column) -> Column:
        n = F.greatest(F.size(s), F.lit(1))
        limit = let(_total(s) / n, lambda m: m - 0.5 * F.sqrt(_total(F.transform(s, lambda x: (x - m) * (x - m))) / n) - 1e-9)
        return let(limit, lambda t: F.transform(s, lambda x: x < t))

    return let(near, marked)


def _ends(sentences: Column, items: Column, low: int, target: int, high: int, entity: str | None) -> Column:
    """Numbers of sentences at which chunks end, in order."""
    facts = F.zip_with(F.transform(sentences, lambda s: F.size(T.words(s))), _drops(items), lambda n, d: F.struct(n.alias("n"), F.coalesce(d, F.lit(False)).alias("drop")))
    start = F.struct(F.array().cast("array<int>").alias("ends"), F.lit(0).alias("at"), F.lit(0).alias("size"))

    def step(state: Column, fact: Column) -> Column:
        size, at = state["size"] + fact["n"], state["at"] + 1
        wanted = (size >= high) | ((size >= target) & fact["drop"]) | (size >= 1.5 * target)
        end = (wanted & (size >= low)) | (at == F.size(sentences))
        ends = F.when(end, F.concat(state["ends"], F.array(at))).otherwise(state["ends"])
        return F.struct(ends.alias("ends"), at.alias("at"), F.when(end, 0).otherwise(size).alias("size"))

    ends = F.aggregate(facts, start, step, lambda s: s["ends"])
    if not entity:
        return ends
    across = F.zip_with(sentences, F.slice(sentences, F.lit(2), F.size(sentences)), lambda a, b: ~F.contains(F.regexp_replace(F.concat(a, F.lit(JOIN), b), entity, ""), F.lit(JOIN)))
    return let(across, lambda cut: F.filter(ends, lambda e: ~F.coalesce(F.get(cut, e - 1), F.lit(False))))


def _square(items: Column) -> Column:
    """Squared length of the sum of the sentences' unit vectors, in the time of a sort."""
    flat = F.array_sort(F.flatten(F.transform(items, lambda v: F.transform(v, lambda x: F.struct(x.alias("x"), (1 / F.sqrt(F.size(v).cast("double"))).alias("w"))))))
    start = F.struct(F.lit(-1).alias("x"), F.lit(0.0).alias("run"), F.lit(0.0).alias("sum"))

    def step(s: Column, p: Column) -> Column:
        same = s["x"] == p["x"]
        run = F.when(same, s["run"] + p["w"]).otherwise(p["w"])
        done = F.when(same, s["sum"]).otherwise(s["sum"] + s["run"] * s["run"])
        return F.struct(p["x"].alias("x"), run.alias("run"), done.alias("sum"))

    return F.aggregate(flat, start, step, lambda s: s["sum"] + s["run"] * s["run"])


def chunk_adaptive(docs: DataFrame, key: str, text: str, low: int = 300, target: int = 600, high: int = 800, entity: str | None = None, dims: int = 512) -> DataFrame:
    """(key, chunk, first, n_sentences, n_words, coherence, density, text): whole sentences, cut where content changes.

    A sentence is a direction in dims coordinates. From target words on, a
    chunk ends where the next sentence is less like the last than the text's
    mean less half a deviation; at high words, or half as many again as the
    target, it ends anyhow, but never under low words. The last sentence ends
    the last chunk. Two chunks stay one where a match of entity lies across
    their border (it may span one sentence end; spaces are written as \\s).

    coherence is the mean cosine of a chunk's pairs of sentences, density the
    mean variance of the coordinates times ten, 1 at most; both follow from
    the length of the sum of directions, so no pairs are made. A chunk with
    fewer than two sentences with tokens has 1 and 0.5.

    All is done within the row of a text: nothing is shuffled, and time goes
    with the words. Null, empty and blank texts have no chunk; repeated keys
    give the chunks of each row.
    """
    sentences = T.sentences(F.translate(F.col(text), JOIN, " "))

    def chunk(s: Column, v: Column, first: Column, end: Column) -> Column:
        part = F.filter(F.slice(v, first + 1, end - first), lambda x: F.size(x) > 0)
        said = F.slice(s, first + 1, end - first)

        def measured(p: Column) -> Column:
            k = F.size(p)
            return let(_square(p), lambda q: F.struct(
                F.when(k < 2, 1.0).otherwise((q - k) / (k * (k - 1))).alias("coherence"),
                F.when(k < 2, 0.5).otherwise(F.least(F.lit(1.0), 10 * (1 - q / (k * k)) / dims)).alias("density"),
            ))

        words = F.aggregate(said, F.lit(0), lambda n, x: n + F.size(T.words(x)))
        return F.struct(first.alias("first"), (end - first).alias("n_sentences"), words.alias("n_words"), let(part, measured).alias("m"), F.array_join(said, " ").alias("text"))

    def chunks(s: Column, v: Column) -> Column:
        return let(_ends(s, v, low, target, high, entity), lambda ends: F.transform(ends, lambda e, i: let(F.coalesce(F.get(ends, i - 1), F.lit(0)), lambda b: chunk(s, v, b, e))))

    made = let(sentences, lambda s: let(F.transform(s, lambda x: sentence_items(x, dims)), lambda v: chunks(s, v)))
    rows = docs.select(F.col(key).alias("_key"), F.posexplode(made).alias("chunk", "_c"))
    return rows.select(F.col("_key").alias(key), "chunk", "_c.first", "_c.n_sentences", "_c.n_words", "_c.m.coherence", "_c.m.density", "_c.text")
