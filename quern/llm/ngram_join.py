"""N-gram Jaccard join: groups of documents whose shingle sets are near equal.

1. Rows with equal sets collapse to one representative (the smallest id).
2. A set's prefix under one global order of shingles (rare first, by a count
   sketch of fixed size; then by hash) must meet the prefix of every set it
   links with. Prefix shingles that two representatives share make tiles,
   banded by set size: linked sizes differ by one band at most.
3. First round: in each tile a leader (least random priority) is paired with
   the rest. Second round: tiles that still hold several components are cut
   into blocks, and pairs of different components are tested.
4. Each pair must pass its hashed bitmap signatures: the bits that differ bound
   the difference of the sets from below, hence the overlap from above. What
   passes is decided by intersecting the sorted sets.

No link between different sets is lost: a pair is skipped only if its sizes,
prefixes or bitmaps rule it out, or if both are in one component already.

Every count, leader and minimum is a group-by that combines before the shuffle,
written, and joined back, so that a shingle, set or leader that a third of the
rows share is split over tasks.

Defined results: null or wordless texts have an empty set, no links, and are
their own component; fewer words than k give one shingle of all words; repeated
rows and equal sets share a component; rows that share an id are one document:
it links by the set whose key sorts first, and all its rows get its component;
rows without an id link with nothing and have no component; further columns are
ignored, whatever their names; an empty table gives no rows; a text of any
length is one set, which must fit into a task.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import MIX_1, SPACE_BYTES, Steps, WordHasher, byte_values, checkpointed, fresh, mix, text_slices

SKETCH_BITS = 19
#: Longs of a bitmap signature.
BITMAP_LONGS = 32
#: Rows of a tile tested in one block.
BLOCK = 2048
CHUNK_BYTES = 1 << 20
#: Pairs of a tile looked at at once.
CHUNK_PAIRS = 1 << 19


@dataclass(frozen=True)
class Rule:
    """k words to a shingle; a link needs den * |A n B| >= num * |A u B|."""

    k: int = 5
    num: int = 80
    den: int = 100

    def prefix(self, n: int) -> int:
        return n - -(-self.num * n // self.den) + 1

    def band(self, n: np.ndarray) -> np.ndarray:
        width = math.log(self.den / self.num) * (1 + 1e-9)
        return np.floor(np.log(np.maximum(n, 1)) / width).astype(np.int32)

    def most_apart(self, total):
        """Largest |A| + |B| - 2 |A n B| of a link, from |A| + |B|."""
        need = -(-self.num * total // (self.num + self.den))
        return total - 2 * need


class Shingler:
    """Sorted distinct shingle hashes of whole texts."""

    def __init__(self, k: int):
        self.k = k
        self.hash = WordHasher(byte_values(SPACE_BYTES, lower=True), seed=29)

    def __call__(self, texts: list[str | None]) -> list[np.ndarray]:
        blobs = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
        data = np.frombuffer(b"\n".join(blobs) + b"\n", np.uint8)
        starts = np.cumsum([0, *[len(b) + 1 for b in blobs]])
        words, at = self.hash(data)
        edges = np.searchsorted(at, starts)
        n = len(words)
        grams = np.zeros(n, np.uint64)
        for j in range(self.k):
            grams[: max(n - j, 0)] += mix(words[j:] + np.uint64((j + 1) * int(MIX_1) % (1 << 64)))
        grams = mix(grams + np.uint64(self.k))
        out = []
        for a, b in zip(edges[:-1], edges[1:]):
            if b - a >= self.k:
                out.append(np.unique(grams[a : b - self.k + 1]))
            elif b > a:
                own = words[a:b]
                own = mix(own + np.arange(1, b - a + 1, dtype=np.uint64) * MIX_1).sum(dtype=np.uint64)
                out.append(np.array([mix(np.array([own + np.uint64(b - a)]))[0]], np.uint64))
            else:
                out.append(np.empty(0, np.uint64))
        return out


def key_of(s: np.ndarray) -> str:
    """Names a set: its size and two sums of mixed hashes."""
    one, two = mix(s).sum(dtype=np.uint64), mix(s ^ MIX_1).sum(dtype=np.uint64)
    return f"{len(s):x}-{int(one):016x}{int(two):016x}"


def chunked(batches, fn):
    """Calls fn(ids, texts) on slices of bounded size of each batch."""
    for part, texts in text_slices(batches, CHUNK_BYTES):
        yield from fn(part.column(0), texts)


def _slot(hashes: np.ndarray) -> np.ndarray:
    return (mix(hashes ^ MIX_1) >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)


SKETCH_PARTS = 16


def sketch(docs: DataFrame, rule: Rule) -> np.ndarray:
    """Approximate document counts by hashed shingle, in a table of fixed size."""
    width = (1 << SKETCH_BITS) // SKETCH_PARTS

    def count(batches):
        table, shingler = np.zeros(1 << SKETCH_BITS, np.int64), Shingler(rule.k)

        def add(_, texts):
            sets = shingler(texts)
            slots = _slot(np.concatenate([np.empty(0, np.uint64), *sets]))
            table[:] += np.bincount(slots, minlength=len(table))
            return ()

        for _ in chunked(batches, add):
            pass
        yield pa.RecordBatch.from_arrays([pa.array(range(SKETCH_PARTS), pa.int32()), pa.array([p.tobytes() for p in table.reshape(SKETCH_PARTS, width)], pa.binary())], ["part", "counts"])

    def add_up(batches):
        totals: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, raw in zip(batch.column(0).to_pylist(), batch.column(1)):
                got = np.frombuffer(raw.as_buffer(), np.int64)
                totals[part] = totals[part] + got if part in totals else got
        yield pa.RecordBatch.from_arrays([pa.array([*totals], pa.int32()), pa.array([v.tobytes() for v in totals.values()], pa.binary())], ["part", "counts"])

    schema = "part int, counts binary"
    parts = docs.select("doc_id", "text").mapInArrow(count, schema).repartition(SKETCH_PARTS, "part").mapInArrow(add_up, schema).collect()
    out = np.zeros((SKETCH_PARTS, width), np.int64)
    for r in parts:
        out[r["part"]] += np.frombuffer(r["counts"], np.int64)
    return np.minimum(out.ravel(), 2**31 - 1).astype(np.int32)


SIGNATURE_SCHEMA = "doc_id long, n long, set_key string, band int, prefix array<long>, bits array<long>"


def signatures(docs: DataFrame, rule: Rule, counts: np.ndarray) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(counts)

    def run(batches):
        shingler, seen = Shingler(rule.k), shared.value
        size = BITMAP_LONGS * 64

        def sign(ids, texts):
            sets = shingler(texts)
            n = np.array([len(s) for s in sets], np.int64)
            keys, prefixes, bits = [], [], []
            for s in sets:
                keys.append(key_of(s))
                p = rule.prefix(len(s)) if len(s) else 0
                prefixes.append(s[np.lexsort((s, seen[_slot(s)]))[:p]].view(np.int64))
                spots = (mix(s + MIX_1) & np.uint64(size - 1)).astype(np.int64)
                odd = (np.bincount(spots, minlength=size) & 1).astype(np.uint8)
                bits.append(np.packbits(odd).view(np.int64))
            lens = pa.array(np.cumsum([0, *[len(p) for p in prefixes]]).astype(np.int32))
            prefix = pa.ListArray.from_arrays(lens, pa.array(np.concatenate(prefixes)))
            grid = pa.ListArray.from_arrays(pa.array((np.arange(len(sets) + 1) * BITMAP_LONGS).astype(np.int32)), pa.array(np.concatenate(bits)))
            yield pa.RecordBatch.from_arrays([ids.cast(pa.int64()), pa.array(n), pa.array(keys), pa.array(rule.band(n)), prefix, grid], ["doc_id", "n", "set_key", "band", "prefix", "bits"])

        yield from chunked(batches, sign)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, SIGNATURE_SCHEMA)


def apart(a, b):
    """Bits that differ between two bitmaps."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)


def _could_link(rule: Rule, n_a, n_b):
    """|A| and |B| alone allow a link."""
    return (n_a * rule.den >= n_b * rule.num) & (n_b * rule.den >= n_a * rule.num)


def _most_apart(rule: Rule, n_a, n_b):
    total = n_a + n_b
    return total - 2 * F.ceil(total * rule.num / F.lit(rule.num + rule.den) - 1e-9)


def verified(steps: Steps, pairs: DataFrame, docs: DataFrame, keys: DataFrame, rule: Rule) -> DataFrame:
    """Pairs (a, b) whose sets link, by exact intersection of the sorted sets.

    keys: (rep, set_key), the set that stands for an id. Sets travel as binary;
    only documents in a pair are shingled again. The joins are plain sort-merge
    joins, so a document in very many pairs is split over tasks when the join
    is skewed.
    """
    involved = pairs.select(F.col("a").alias("rep")).union(pairs.select(F.col("b").alias("rep"))).distinct().join(keys, "rep")
    texts = docs.select(F.col("doc_id").cast("long"), "text", F.xxhash64("text").alias("text_key")).join(involved.withColumnRenamed("rep", "doc_id"), "doc_id")
    texts = texts.dropDuplicates(["doc_id", "text_key"]).select("doc_id", "text", "set_key")

    def shingle(batches):
        shingler = Shingler(rule.k)
        for part, texts in text_slices(batches, CHUNK_BYTES):
            sets = shingler(texts)
            mine = np.array([key_of(s) == k for s, k in zip(sets, part.column(2).to_pylist())], bool)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([s.tobytes() for s in sets], pa.binary())], ["doc_id", "items"]).filter(pa.array(mine))

    sets = steps.stored(texts.mapInArrow(shingle, "doc_id long, items binary"), "sets")

    def intersect(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3)):
                p, q = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                at = np.searchsorted(q, p)
                at[at == len(q)] = 0
                both = int((q[at] == p).sum()) if len(q) else 0
                keep.append(rule.den * both >= rule.num * (len(p) + len(q) - both))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    left = sets.select(F.col("doc_id").alias("b"), F.col("items").alias("items_b"))
    right = sets.select(F.col("doc_id").alias("a"), F.col("items").alias("items_a"))
    joined = pairs.select("a", "b").join(left, "b").join(right, "a").select("a", "b", "items_a", "items_b")
    out = steps.stored(joined.mapInArrow(intersect, "a long, b long"), "links")
    steps.drop(sets)
    return out


def components(steps: Steps, links: DataFrame) -> DataFrame:
    """(node, component): smallest id reachable over links (a, b), for all nodes in a link.

    Alternates large-star and small-star steps, each a written group minimum
    and a join; no node's neighbours are ever gathered.
    """

    def least_of(edges: DataFrame) -> DataFrame:
        return steps.stored(edges.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), F.least("u", "m").alias("m")), "least")

    edges = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    edges = checkpointed(edges)
    before = None
    while True:
        both = edges.union(edges.select("v", "u"))
        least = least_of(both)
        big = both.where("v > u").join(least, F.col("u") == F.col("w")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        big = steps.stored(big.where("u <> v").distinct(), "big")
        low = least_of(big)
        small = big.join(low, F.col("u") == F.col("w")).select(F.explode(F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v")
        edges = checkpointed(small.where("u <> v").distinct())
        steps.drop(least, big, low)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(now) == before:
            break
        before = tuple(now)
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def _blocks_of_tiles(steps: Steps, rows: DataFrame) -> DataFrame:
    """Second round: pairs of different components from banded tiles, cut into blocks."""
    own = rows.withColumn("tile", F.col("band")).withColumn("low", F.lit(True))
    guest = rows.withColumn("tile", F.col("band") - 1).withColumn("low", F.lit(False))
    both = own.unionByName(guest)
    per = both.groupBy("token", "tile").agg(F.count("*").alias("c"), F.min("comp").alias("c0"), F.max("comp").alias("c1"), F.max("low").alias("any_low"))
    per = per.where("c0 < c1 AND any_low").select(F.col("token").alias("t_token"), F.col("tile").alias("t_tile"), F.ceil(F.col("c") / BLOCK).cast("int").alias("nb"))
    part = both.join(steps.stored(per, "open-tiles"), (F.col("token") == F.col("t_token")) & (F.col("tile") == F.col("t_tile")))
    part = part.withColumn("mine", F.pmod(F.xxhash64("doc_id"), F.col("nb")).cast("int"))
    part = part.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
    return part.select("token", "tile", F.least("mine", "other").alias("x"), F.greatest("mine", "other").alias("y"), "mine", "doc_id", "n", "comp", "low")


def pairs_within(starts: np.ndarray, total: int):
    """(i, j), i < j, of the rows of each run that begins at starts, in chunks."""
    ends = np.repeat(np.append(starts[1:], total), np.diff(np.append(starts, total)))
    after = ends - np.arange(total) - 1
    bounds = np.concatenate([[0], np.cumsum(after)])
    row = 0
    while row < total:
        stop = max(row + 1, int(np.searchsorted(bounds, bounds[row] + CHUNK_PAIRS, side="right")) - 1)
        own = after[row:stop]
        i = np.repeat(np.arange(row, stop), own)
        yield i, i + 1 + np.arange(len(i)) - np.repeat(bounds[row:stop] - bounds[row], own)
        row = stop


def second_round(steps: Steps, rows: DataFrame, bits: DataFrame, rule: Rule) -> DataFrame:
    """(a, b): candidate pairs across components that sizes and bitmaps allow.

    A tile's blocks are consecutive rows of a sorted partition; only one block
    is held back from a batch to the next.
    """
    key = ["token", "tile", "x", "y"]
    placed = _blocks_of_tiles(steps, rows).join(bits, "doc_id").repartition(*key).sortWithinPartitions(*key)
    columns = ["mine", "doc_id", "n", "comp", "low", "bits"]

    def test(table: pa.Table, starts: np.ndarray):
        mine, ids, n, comp, low = (table[c].to_numpy() for c in columns[:-1])
        grid = table["bits"].combine_chunks().flatten().to_numpy().view(np.uint64).reshape(len(ids), BITMAP_LONGS)
        halves = (table["x"].to_numpy() != table["y"].to_numpy())
        for i, j in pairs_within(starts, len(ids)):
            ok = (comp[i] != comp[j]) & (low[i] | low[j]) & ~(halves[i] & (mine[i] == mine[j]))
            i, j = i[ok], j[ok]
            ok = (n[j] * rule.den >= n[i] * rule.num) & (n[i] * rule.den >= n[j] * rule.num)
            i, j = i[ok], j[ok]
            for at in range(0, len(i), 1 << 15):
                p, q = i[at : at + (1 << 15)], j[at : at + (1 << 15)]
                far = np.bitwise_count(grid[p] ^ grid[q]).sum(axis=1, dtype=np.int64)
                ok = far <= rule.most_apart(n[p] + n[q])
                a, b = ids[p[ok]], ids[q[ok]]
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])

    def run(batches):
        held = None
        for batch in batches:
            table = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
            new = np.zeros(len(table), bool)
            new[:1] = True
            for c in key:
                values = table[c].to_numpy()
                new[1:] |= values[1:] != values[:-1]
            starts = np.flatnonzero(new)
            last = int(starts[-1]) if len(starts) else 0
            if last:
                yield from test(table.slice(0, last), starts[:-1])
            held = table.slice(last)
        if held is not None and len(held):
            yield from test(held, np.zeros(1, np.int64))

    return placed.select(*key, *columns).mapInArrow(run, "a long, b long").distinct()


def near_groups(docs: DataFrame, rule: Rule = Rule()) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of docs(doc_id, text)."""
    spark: SparkSession = docs.sparkSession
    steps = Steps(spark)
    signed = steps.stored(signatures(docs, rule, sketch(docs, rule)), "signatures")
    slim = steps.stored(signed.select("doc_id", "n", "set_key"), "sizes")
    own = slim.where("n > 0 AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("set_key").alias("set_key"))
    own = steps.stored(own, "own")
    reps = steps.stored(own.groupBy("set_key").agg(F.min("doc_id").alias("rep")), "reps")
    # rows of one id and set are alike
    chosen = signed.join(reps, (signed["doc_id"] == reps["rep"]) & (signed["set_key"] == reps["set_key"]), "left_semi").dropDuplicates(["doc_id", "set_key"])
    chosen = steps.stored(chosen.select("doc_id", "n", "band", "prefix", "bits"), "chosen")
    steps.drop(signed)
    tokens = chosen.select("doc_id", "n", "band", F.explode("prefix").alias("token"))
    common = steps.stored(tokens.groupBy("token").agg(F.count("*").alias("c")).where("c > 1").select(F.col("token").alias("t_token")), "common")
    shared = steps.stored(tokens.join(common, F.col("token") == F.col("t_token")).select("token", "band", "doc_id", "n"), "tiles")
    leaders = shared.groupBy("token", "band").agg(F.min(F.struct(F.xxhash64("doc_id").alias("h"), "doc_id", "n")).alias("leader"))
    leaders = steps.stored(leaders.select(F.col("token").alias("t_token"), F.col("band").alias("t_band"), F.col("leader.doc_id").alias("a"), F.col("leader.n").alias("n_a")), "leaders")
    bits = chosen.select("doc_id", "bits")

    stars = shared.join(leaders, (F.col("token") == F.col("t_token")) & (F.col("band") == F.col("t_band"))).where(F.col("a") != F.col("doc_id"))
    stars = stars.where(_could_link(rule, F.col("n"), F.col("n_a"))).select("a", F.col("doc_id").alias("b"), "n_a", F.col("n").alias("n_b")).distinct()
    stars = stars.join(bits.select(F.col("doc_id").alias("b"), F.col("bits").alias("bits_b")), "b").join(bits.select(F.col("doc_id").alias("a"), F.col("bits").alias("bits_a")), "a")
    stars = stars.where(apart(F.col("bits_a"), F.col("bits_b")) <= _most_apart(rule, F.col("n_a"), F.col("n_b")))
    first = verified(steps, steps.stored(stars.select("a", "b"), "stars"), docs, reps, rule)

    label = components(steps, first)
    rows = shared.join(label, shared["doc_id"] == label["node"], "left").select("token", "band", "doc_id", "n", F.coalesce("component", "doc_id").alias("comp"))
    rows = steps.stored(rows, "labelled-tiles")
    pairs = steps.stored(second_round(steps, rows, bits, rule), "pairs")
    if not pairs.isEmpty():
        label = components(steps, first.union(verified(steps, pairs, docs, reps, rule)))
    steps.drop(common, shared, leaders, rows, chosen)

    final = reps.join(label.select(F.col("node").alias("rep"), "component"), "rep", "left").select(F.col("set_key").alias("key"), F.coalesce("component", "rep").alias("component_id"))
    final = steps.stored(final, "components")
    of_doc = own.join(final, F.col("set_key") == F.col("key")).select(F.col("doc_id").alias("own_id"), "component_id")
    out = slim.join(of_doc, F.col("doc_id") == F.col("own_id"), "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def one_of_each(docs: DataFrame, rule: Rule = Rule()) -> DataFrame:
    """The documents without those that link, directly or over others, with one
    of a smaller id; all columns kept. Rows equal in id and text count once;
    rows without an id stay."""
    d, k = fresh(docs.columns, "kept_id", "text_key")
    keep = near_groups(docs.select("doc_id", "text"), rule).where("doc_id = component_id").select(F.col("doc_id").alias(d)).distinct()
    known = docs.where(F.col("doc_id").isNotNull()).join(keep, F.col("doc_id") == F.col(d), "left_semi")
    known = known.withColumn(k, F.xxhash64("text")).dropDuplicates(["doc_id", k]).drop(k)
    return known.unionByName(docs.where(F.col("doc_id").isNull()))


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return near_groups(docs, Rule(k=3, num=90, den=100))


ORACLE = r"""
WITH RECURSIVE d AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' '))) END AS s FROM d),
f AS (SELECT doc_id, len(s) AS n, hash(unnest(s)) AS g FROM s),
p AS MATERIALIZED (SELECT x.doc_id AS a, y.doc_id AS b FROM f x JOIN f y ON x.g = y.g AND x.doc_id <> y.doc_id AND 10 * least(x.n, y.n) >= 9 * greatest(x.n, y.n)
  GROUP BY 1, 2, x.n, y.n HAVING 100 * count(*) >= 90 * (x.n + y.n - count(*))),
c AS (SELECT doc_id AS node, doc_id AS root FROM documents UNION SELECT p.b, c.root FROM c JOIN p ON p.a = c.node)
SELECT s.doc_id, len(s.s) AS n_shingles, min(c.root) AS component_id FROM s JOIN c ON c.node = s.doc_id GROUP BY s.doc_id, len(s.s)
"""
