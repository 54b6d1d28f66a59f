"""Document operators: keywords, entities, chunking, deduplication."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T
from ..shared import cut, stored

#: Classes of hashes in which tokens are counted, a power of two.
SKETCH = 1 << 16
#: Parts of equal tokens that near sets have in common at least.
AGREE = 4
#: Bits of the map by which few other keys are told from those sought, a power of two.
BITS = 1 << 24
#: Pairs that are compared at once besides one for each part.
ROOM = 1_000_000


def keywords(docs: DataFrame, key: str, text: str, top: int, min_chars: int = 3) -> DataFrame:
    """(key, word, n, rank) of each document's most frequent tokens; ties by first place."""
    t = docs.select(key, F.posexplode(T.tokens(F.col(text))).alias("at", "word")).where(F.length("word") >= min_chars)
    got = t.groupBy(key, "word").agg(F.count("*").alias("n"), F.min("at").alias("first"))
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("n"), "first"))
    return got.withColumn("rank", rank).where(F.col("rank") <= top).drop("first")


def spans(docs: DataFrame, key: str, text: str, patterns: dict[str, str]) -> DataFrame:
    """(key, category, value): all matches of named patterns."""
    found = F.array(*[F.struct(F.lit(name).alias("category"), F.regexp_extract_all(text, F.lit(p), F.lit(0)).alias("values")) for name, p in patterns.items()])
    return docs.select(key, F.explode(found).alias("f")).select(key, "f.category", F.explode("f.values").alias("value"))


def merge_entities(entities: DataFrame, text: str, label: str, score: str, source: str) -> DataFrame:
    """By normalised text and label: the best score, the sources, the count."""
    e = entities.withColumn("name", F.lower(T.squeeze_space(F.col(text))))
    return e.groupBy("name", label).agg(F.max(score).alias("score"), F.array_join(F.array_sort(F.collect_set(source)), "+").alias("sources"), F.count("*").alias("n"))


def relations(docs: DataFrame, key: str, text: str, pattern: str) -> DataFrame:
    """(key, sentence, a, b): ordered pairs of distinct entities of one sentence."""
    s = docs.select(key, F.posexplode(T.sentences(F.col(text))).alias("sentence", "s"))
    e = s.select(key, "sentence", F.array_distinct(F.regexp_extract_all("s", F.lit(pattern), F.lit(0))).alias("e"))
    pairs = F.flatten(F.transform("e", lambda a, i: F.transform(F.filter("e", lambda b, j: j > i), lambda b: F.struct(a.alias("a"), b.alias("b")))))
    return e.select(key, "sentence", F.explode(pairs).alias("p")).select(key, "sentence", "p.a", "p.b")


def first_of(rows: DataFrame, by: list[Column], order: list) -> DataFrame:
    """The first row of each group, by the order."""
    names = [f"_g{i}" for i in range(len(by))]
    rows = rows.withColumns(dict(zip(names, by)))
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy(*names).orderBy(*order))).where("_r = 1").drop("_r", *names)


def hash_dedup(docs: DataFrame, text: str, key: str) -> DataFrame:
    """The first document of each normalised, redacted content."""
    return first_of(docs, [F.md5(T.redact(F.lower(T.squeeze_space(F.col(text)))))], [F.asc(key)])


def mixed(x: np.ndarray) -> np.ndarray:
    """64-bit numbers in place of others, spread evenly."""
    x = x * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def hashes(w: Column) -> Column:
    """32 bits of each token; tokens that share them only make sets look nearer."""
    return F.transform(w, lambda x: F.hash(x))


def near_classes(sets: DataFrame, threshold: float) -> DataFrame:
    """(k, s): hashes s of parts of sets; sets whose Jaccard is above the threshold have at least AGREE of them in common.

    sets: (k, n, h), the hashes h of n > 0 tokens. Tokens are dealt into classes, by their hash and a size that doubles.
    Two sets that link differ in d tokens at most, so in d classes at most, and as there are d + AGREE or more, AGREE
    are equal. In an order common to all, only d others can be before these, so each set sends its first d + AGREE.
    First are classes of many and rare tokens, by counts in SKETCH classes of hashes: few other sets have the same.
    """
    counted = sets.select(F.explode("h").alias("x")).groupBy(F.col("x").bitwiseAND(F.lit(SKETCH - 1)).alias("x")).agg(F.count("*").alias("n")).toArrow()  # of fixed size
    counts = np.zeros(SKETCH, np.int64)
    counts[counted["x"].to_numpy()] = counted["n"].to_numpy()
    weight, mask = np.rint(16 * np.log2((counts.sum() + 1) / (counts + 1))), SKETCH - 1  # whole numbers, so that sums are exact
    sent, differ = sets.sparkSession.sparkContext.broadcast(weight), (1 - threshold) / threshold

    def dealt(n: np.ndarray, size: np.ndarray, flat: np.ndarray, down: int) -> tuple[np.ndarray, np.ndarray]:
        """Rows and their parts, among sets of down doublings less."""
        level = np.ceil(np.log2(n)).astype(np.int64) - down
        rows = np.flatnonzero((level >= 0) & ((down == 0) | (threshold * n < 2.0**level)))
        mine, level = np.zeros(len(n), bool), level[rows]
        mine[rows] = True
        flat = flat[np.repeat(mine, size)]
        classes = np.ceil(1.2 * (differ * 2.0**level + 2) + AGREE).astype(np.int64)
        start, row = np.cumsum(classes) - classes, np.repeat(np.arange(len(rows)), classes)
        x = flat.astype(np.uint32).astype(np.uint64)
        of = np.repeat(np.arange(len(rows)), size[rows])
        at = start[of] + (mixed(x + np.uint64(1)) % classes[of].astype(np.uint64)).astype(np.int64)
        both = mixed(x + np.uint64(1 << 32))
        low, high = (np.bincount(at, half.astype(float), len(row)).astype(np.uint64) for half in (both & np.uint64(0xFFFFFFFF), both >> np.uint64(32)))
        place = np.arange(len(row)) - start[row]
        part = mixed(low ^ mixed(high ^ mixed((place * 64 + level[row]).astype(np.uint64)))).view(np.int64)
        first = np.lexsort((part, -np.bincount(at, sent.value[flat & mask], len(row)), row))
        keep = place < np.floor(differ * n[rows] + 1e-9)[row] + AGREE
        return rows[row[keep]], part[first[keep]]

    def parts(batches):
        for batch in batches:
            cuts = np.cumsum(batch["h"].value_lengths().to_numpy()) // (1 << 20)  # of as many tokens
            for one in np.unique(cuts):
                b = batch.slice(*(lambda at: (at[0], len(at)))(np.flatnonzero(cuts == one)))
                n, size, flat = b["n"].to_numpy(), b["h"].value_lengths().to_numpy(), b["h"].flatten().to_numpy()
                for down in range(2 + int(np.log2(1 / threshold))):
                    rows, part = dealt(n, size, flat, down)
                    yield pa.RecordBatch.from_arrays([b["k"].take(pa.array(rows)), pa.array(part)], ["k", "s"])

    return sets.mapInArrow(parts, f"k {sets.schema['k'].dataType.simpleString()}, s long")


def near_pairs(classes: DataFrame) -> DataFrame:
    """(a, b), a < b: rows that have AGREE parts in common."""
    both = classes.select(F.col("k").alias("a"), "s").join(classes.select(F.col("k").alias("b"), "s"), "s").where("a < b")
    return both.groupBy("a", "b").count().where(F.col("count") >= AGREE).select("a", "b")


def near_candidates(sets: DataFrame, threshold: float) -> DataFrame:
    """(a, b), a < b: pairs of (k, w) among which are all whose sets w have a Jaccard above the threshold."""
    return near_pairs(near_classes(sets.select("k", F.size("w").alias("n"), hashes(F.col("w")).alias("h")).where("n > 0"), threshold))


def with_mates(classes: DataFrame) -> DataFrame:
    """(k, s, a, c): of parts that several rows have, those rows, with the least k of them and how many they are."""
    w = Window.partitionBy("s")
    return classes.select("k", "s", F.min("k").over(w).alias("a"), F.count("*").over(w).alias("c")).where("c > 1")


def maybe_in(keys: DataFrame, key: str) -> Column:
    """True where a key is one of keys (k), and for few others: by a map of bits of fixed size, so that joins move little."""
    x = F.xxhash64("k").bitwiseAND(F.lit(BITS - 1))
    got = keys.select(x.alias("x")).groupBy(F.shiftright("x", 6).alias("at")).agg(F.bit_or(F.expr("shiftleft(1L, CAST(x & 63 AS INT))")).alias("word")).toArrow()
    words = np.zeros(BITS // 64, np.int64)
    words[got["at"].to_numpy()] = got["word"].to_numpy()
    sent = keys.sparkSession.sparkContext.broadcast(words)

    @F.pandas_udf("boolean")
    def there(x: pd.Series) -> pd.Series:
        return (np.take(sent.value, x // 64) >> x % 64) % 2 == 1

    return there(F.xxhash64(key).bitwiseAND(F.lit(BITS - 1)))


def linked(pairs: DataFrame, whole: DataFrame, threshold: float) -> DataFrame:
    """Those pairs (a, b) whose sets, of whole (k, w), have a Jaccard above the threshold."""
    there = {x: maybe_in(pairs.select(F.col(x).alias("k")), "k") for x in "ab"}
    sets = stored(whole.where(there["a"] | there["b"]))
    wa, wb = (sets.where(there[x]).toDF(x, f"w{x}") for x in "ab")
    both = pairs.join(wa, "a").join(wb, "b").withColumn("c", F.size(F.array_intersect("wa", "wb")))
    return both.where(F.col("c") / (F.size("wa") + F.size("wb") - F.col("c")) > threshold).select("a", "b")


def greedy_dedup(docs: DataFrame, key: str, tokens: Column, threshold: float) -> DataFrame:
    """(key): rows kept when each is compared, in key order, with the rows kept before.

    Of rows with equal token sets only the first can be kept, so the others go
    at once. The rest meet in their `near_classes`, and pairs are decided by
    whole sets, which are made again for these only. Of the open rows, those
    are kept that follow others in at most half of AGREE parts, as nothing
    before links with them. Each leads the rest of its parts, so the pairs of a
    row and the first of its part, no more than there are rows and parts, have
    all that these link with, and this goes: groups of near copies need no pair
    for each two of them. Once no more pairs are left
    than there were parts, twice that after another round, so that rounds stay
    few, the rest is decided by all its links: a row is settled as soon as all
    earlier rows it links with are, and kept if none of those is. All this gives
    the sequential result exactly. Rows without tokens link with nothing.
    """
    whole = docs.where(F.col(key).isNotNull()).select(F.col(key).alias("k"), F.sort_array(F.array_distinct(F.coalesce(tokens, F.array().cast("array<string>")))).alias("w"))
    told = stored(whole.select("k", F.size("w").alias("n"), F.xxhash64("w").alias("h1"), F.xxhash64(F.lit(1), "w").alias("h2"), hashes(F.col("w")).alias("h")))
    first = stored(told.where("n > 0").groupBy("h1", "h2").agg(F.min("k").alias("k")).select("k").unionByName(told.where("n = 0").select("k")))
    gone = [stored(told.select("k").join(first, "k", "left_anti"))]
    met = stored(with_mates(near_classes(told.where("n > 0").select("k", "n", "h"), threshold)))
    room = met.count() + ROOM
    while len(gone) == 1 or met.agg(F.coalesce(F.sum(F.col("c") - 1), F.lit(0))).first()[0] > room * 2 ** (len(gone) - 1):
        behind = stored(met.where("a < k").groupBy("k").agg(F.count("*").alias("m")))
        led = met.where("a < k").groupBy("a", F.col("k").alias("b")).agg(F.count("*").alias("common")).where(F.col("common") >= AGREE - AGREE // 2)
        led = led.join(behind.toDF("a", "m"), "a", "left").fillna(0, "m").where((F.col("m") <= AGREE // 2) & (F.col("m") + F.col("common") >= AGREE))
        led = led.join(gone[-1].toDF("b"), "b", "left_anti").select("a", "b")
        gone.append(stored(linked(stored(led), whole, threshold).select(F.col("b").alias("k")).distinct()))
        wait = behind.where(F.col("m") > AGREE // 2).join(gone[-2].unionByName(gone[-1]), "k", "left_anti")
        met = stored(with_mates(met.join(wait, "k", "left_semi")))
    links = cut(linked(stored(near_pairs(met)), whole, threshold))
    state = links.select(F.explode(F.array("a", "b")).alias("k")).distinct().withColumn("kept", F.lit(None).cast("boolean"))
    while True:
        earlier = links.join(state.withColumnRenamed("k", "a"), "a").groupBy("b").agg(F.max(F.coalesce("kept", F.lit(False))).alias("hit"), F.max(F.col("kept").isNull()).alias("open"))
        new = state.join(earlier, F.col("k") == F.col("b"), "left")
        decided = F.coalesce("kept", F.when(F.coalesce("hit", F.lit(False)), F.lit(False)).when(~F.coalesce("open", F.lit(False)), F.lit(True)))
        state = cut(new.select("k", decided.alias("kept")))
        if state.where("kept IS NULL").isEmpty():
            break
    for some in [*gone[1:], state.where("NOT kept")]:
        first = first.join(some, "k", "left_anti")
    return first.select(F.col("k").alias(key))


# Chunking: every function returns (key, chunk, text), chunks from 0.


def _numbered(df: DataFrame, key: str, chunks: Column) -> DataFrame:
    return df.select(key, F.posexplode(chunks).alias("chunk", "text"))


def chunk_fixed(docs: DataFrame, key: str, text: str, size: int, overlap: int) -> DataFrame:
    """Windows of size characters, size - overlap apart, to the end of the text."""
    step = size - overlap
    n = F.length(text)
    last = F.greatest(F.ceil((n - size) / step), F.lit(0)).cast("int")
    starts = F.when(n > 0, F.transform(F.sequence(F.lit(0), last), lambda i: i * step)).otherwise(F.array().cast("array<int>"))
    return _numbered(docs, key, F.transform(starts, lambda s: F.substring(F.col(text), s + 1, F.lit(size))))


def _fold(parts: Column, size: Column | None, full, joiner: str) -> Column:
    """Packs parts in order: full(current, part) says that the part starts a new chunk."""
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("now"))

    def step(state: Column, part: Column) -> Column:
        empty = F.length(state["now"]) == 0
        begin = ~empty & full(state["now"], part)
        now = F.when(empty | begin, part).otherwise(F.concat(state["now"], F.lit(joiner), part))
        done = F.when(begin, F.concat(state["done"], F.array(state["now"]))).otherwise(state["done"])
        return F.struct(done.alias("done"), now.alias("now"))

    return F.aggregate(parts, start, step, lambda s: F.when(F.length(s["now"]) > 0, F.concat(s["done"], F.array(s["now"]))).otherwise(s["done"]))


def chunk_words(docs: DataFrame, key: str, text: str, target: int = 600) -> DataFrame:
    """Whole sentences until a chunk has target words."""
    return _numbered(docs, key, _fold(T.sentences(F.col(text)), None, lambda now, s: F.size(T.words(now)) >= target, " "))


def chunk_sentences(docs: DataFrame, key: str, text: str, size: int) -> DataFrame:
    """Whole sentences up to size characters; a longer sentence stands alone."""
    return _numbered(docs, key, _fold(T.sentences(F.col(text)), None, lambda now, s: F.length(now) + 1 + F.length(s) > size, " "))


def chunk_paragraphs(docs: DataFrame, key: str, text: str, size: int) -> DataFrame:
    """A chunk per paragraph; longer ones are cut at size characters."""
    paragraphs = F.filter(F.transform(F.split(F.col(text), r"\n+"), lambda p: F.trim(p)), lambda p: F.length(p) > 0)
    cut = F.transform(paragraphs, lambda p: F.transform(F.sequence(F.lit(0), F.floor((F.length(p) - 1) / size).cast("int")), lambda i: F.substring(p, i * size + 1, F.lit(size))))
    return _numbered(docs, key, F.flatten(cut))


def chunk_headings(docs: DataFrame, key: str, text: str, heading: str, size: int) -> DataFrame:
    """Parts that begin at a heading; longer parts are packed by sentence."""
    parts = F.filter(F.split(F.col(text), f"(?=(?:{heading}))"), lambda p: F.length(F.trim(p)) > 0)
    rows = docs.select(key, F.posexplode(parts).alias("part", "p"))
    packed = F.when(F.length("p") <= size, F.array("p")).otherwise(_fold(T.sentences(F.col("p")), None, lambda now, s: F.length(now) + 1 + F.length(s) > size, " "))
    flat = rows.select(key, "part", F.posexplode(packed).alias("piece", "text"))
    return flat.select(key, (F.row_number().over(Window.partitionBy(key).orderBy("part", "piece")) - 1).alias("chunk"), "text")


def chunk_by_similarity(docs: DataFrame, key: str, text: str, hard: float, size: int) -> DataFrame:
    """Sentences are packed until size characters or a break: token overlap with the sentence before under hard."""
    s = docs.select(key, F.posexplode(T.sentences(F.col(text))).alias("at", "s"))
    w = Window.partitionBy(key).orderBy("at")
    near = T.jaccard(T.tokens(F.col("s")), T.tokens(F.coalesce(F.lag("s").over(w), F.lit(""))))
    s = s.withColumn("brk", (F.col("at") > 0) & (near < hard))
    part = F.sum(F.col("brk").cast("int")).over(w)
    rows = s.withColumn("part", part).groupBy(key, "part").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "s"))), lambda x: x["s"]).alias("ss"))
    flat = rows.select(key, "part", F.posexplode(_fold(F.col("ss"), None, lambda now, x: F.length(now) + 1 + F.length(x) > size, " ")).alias("piece", "text"))
    return flat.select(key, (F.row_number().over(Window.partitionBy(key).orderBy("part", "piece")) - 1).alias("chunk"), "text")


def chunk_score(text: Column, low: int, high: int) -> Column:
    """Mean of length fit, sentence end, and 1.5 times distinct share (at most 1)."""
    w = T.words(text)
    n = F.size(w)
    fit = F.when(n.between(low, high), 1.0).when(n < low, n / low).otherwise(high / F.when(n > 0, n))
    end = F.when(F.trim(text).rlike("[.!?؟]$"), 1.0).otherwise(0.7)
    distinct = F.when(n > 0, F.least(F.lit(1.0), 1.5 * F.size(F.array_distinct(w)) / n)).otherwise(0.0)
    return (fit + end + distinct) / 3


def expand_terms(queries: DataFrame, key: str, text: str, synonyms: DataFrame, most: int) -> DataFrame:
    """(key, variant): one term replaced by one synonym at a time. synonyms: (term, synonym)."""
    t = queries.select(key, text, F.posexplode(T.words(F.lower(F.col(text)))).alias("at", "term"))
    hit = t.join(synonyms, "term")
    w = F.transform(T.words(F.lower(F.col(text))), lambda x, i: F.when(i == F.col("at"), F.col("synonym")).otherwise(x))
    out = hit.select(key, "at", "synonym", F.array_join(w, " ").alias("variant"))
    return out.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy("at", "synonym"))).where(F.col("rank") <= most).select(key, "rank", "variant")


def corpus_hash(files: DataFrame, group: str, path: str, content: str) -> DataFrame:
    """One hash per group over its files in path order, as they stream by."""
    import hashlib

    from ..shared import streamed

    def step(state, file: tuple):
        line = f"{file[0]}:{file[1]}".encode()
        if state is None:
            return hashlib.sha256(line)
        state.update(b"\n" + line)
        return state

    files = files.select(group, F.coalesce(F.col(path).cast("string"), F.lit("")).alias("p"), F.sha2(F.col(content), 256).alias("h"))
    return streamed(files, group, ["p", "h"], ["p", "h"], step, lambda state: state.hexdigest(), "hash string")
