"""Interval joins by buckets of fitting size, in place of all pairs of a group.

An interval of length n belongs to the level whose buckets are the least power
of two above n, so it lies in two buckets at most. Two intervals that share a
point meet in a bucket of the longer one's level. Every interval is kept at its
own level and looks up the buckets it touches at levels above, of which only
those that occur are tried; so rows are few for each interval, and what meets in
a bucket but does not touch is at most a few times what touches.

`in_force_summary` needs no pairs: bounds of rules and events are one sorted
list, dealt into cells of equal length, in which positions stand for times.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..shared import cut, stored
from .logic import allen

#: Bounds that stand for open ends; beyond them values are cut.
FAR = 1 << 60
#: Bounds and events of one cell, about, and the order of those of one time.
CELL = 200_000
START, EVENT, END = 0, 1, 2
NONE = np.iinfo(np.int64).max


def _ends(df: DataFrame, start: str, end: str) -> tuple[Column, Column]:
    """Whole-number ends; null is unbounded."""
    low, high = (F.coalesce(F.col(c).cast("long"), F.lit(x)) for c, x in ((start, -FAR), (end, FAR)))
    return F.greatest(low, F.lit(-FAR)), F.least(high, F.lit(FAR))


def _level(start: Column, end: Column) -> Column:
    """Bits of the length: 0 for a point."""
    gap = end - start
    return F.when(gap > 0, F.length(F.bin(gap))).otherwise(0)


def _prepared(df: DataFrame, on: list[str], key: str, start: str, end: str, side: str) -> DataFrame:
    s, e = _ends(df, start, end)
    rows = df.select(*on, F.col(key).alias(f"{side}_key"), s.alias(f"{side}_s"), e.alias(f"{side}_e")).where(f"{side}_s <= {side}_e")
    return rows.withColumn(f"{side}_level", _level(F.col(f"{side}_s"), F.col(f"{side}_e")))


def _levels(rows: DataFrame, side: str) -> list[int]:
    return sorted(r[0] for r in rows.select(f"{side}_level").distinct().collect())  # 62 at most


def _buckets(rows: DataFrame, side: str, level: Column) -> DataFrame:
    """A row for each bucket of the level that the interval touches."""
    shifted = lambda c: F.call_function("shiftright", F.col(c), level)
    return rows.select("*", level.alias("level"), F.explode(F.sequence(shifted(f"{side}_s"), shifted(f"{side}_e"))).alias("bucket"))


def touching(left: DataFrame, right: DataFrame, on: list[str], left_key: str, right_key: str, start: str = "start", end: str = "end") -> DataFrame:
    """(on, left_key, left_s, left_e, right_key, right_s, right_e) of intervals that share a point.

    Ends are closed whole numbers (cast times to microseconds first), null ends
    unbounded, intervals that end before they start touch nothing. Null groups
    match nothing.
    """
    a, b = _prepared(left, on, left_key, start, end, "left"), _prepared(right, on, right_key, start, end, "right")
    out = None
    for short, long_, strict in (("left", "right", False), ("right", "left", True)):
        x, y = (a, b) if short == "left" else (b, a)
        levels = F.array(*[F.lit(v) for v in _levels(y, long_)]).cast("array<int>")
        own = F.col(f"{short}_level")
        above = F.filter(levels, (lambda v: v > own) if strict else (lambda v: v >= own))
        asked = _buckets(x.select("*", F.explode(above).alias("at")), short, F.col("at")).drop("at")
        kept = _buckets(y, long_, F.col(f"{long_}_level"))
        pairs = asked.join(kept, [*on, "level", "bucket"]).where("left_s <= right_e AND right_s <= left_e")
        # both may touch two buckets together: the first of them counts
        first = F.greatest(*[F.call_function("shiftright", F.col(f"{s}_s"), F.col("level")) for s in ("left", "right")])
        part = pairs.where(F.col("bucket") == first).select(*on, "left_key", "left_s", "left_e", "right_key", "right_s", "right_e")
        out = part if out is None else out.unionByName(part)
    return out


def touching_pairs(intervals: DataFrame, key: str, group: str, start: str, end: str) -> DataFrame:
    """(group, a, b, relation): Allen's relation of the pairs a < b of a group that share a point."""
    got = touching(intervals, intervals, [group], key, key, start, end).where("left_key < right_key")
    relation = allen(F.col("left_s"), F.col("left_e"), F.col("right_s"), F.col("right_e"))
    return got.select(group, F.col("left_key").alias("a"), F.col("right_key").alias("b"), relation.alias("relation"))


def in_force(events: DataFrame, rules: DataFrame, on: list[str], event: str, at: str, rule: str, start: str, end: str) -> DataFrame:
    """(event, rule): rules in force when an event of their group happens; a null bound is open, an event without a time meets none."""
    points = events.where(F.col(at).isNotNull()).select(*on, F.col(event), F.col(at).alias("start"), F.col(at).alias("end"))
    spans = rules.select(*on, F.col(rule), F.col(start).alias("start"), F.col(end).alias("end"))
    return touching(points, spans, on, event, rule).select(F.col("left_key").alias("event"), F.col("right_key").alias("rule"))


def _least_over(low: np.ndarray, high: np.ndarray, value: np.ndarray, n: int) -> np.ndarray:
    """The least value of the ranges [low, high) over each of n places; NONE where there is none.

    A range is put on the nodes of a binary tree that it fills, then nodes pass their values down.
    """
    tree = np.full(2 * n, NONE)
    a, b = low + n, high + n
    while len(a):
        for odd, node in ((a & 1 == 1, a), (b & 1 == 1, b - 1)):
            use = odd & (a < b)
            np.minimum.at(tree, node[use], value[use])
        a, b = (a + 1) >> 1, b >> 1
        more = a < b
        a, b, value = a[more], b[more], value[more]
    for i in range(1, (2 * n).bit_length()):
        nodes = np.arange(1 << i, min(1 << (i + 1), 2 * n))
        tree[nodes] = np.minimum(tree[nodes], tree[nodes >> 1])
    return tree[n:]


def _swept(batches):
    """(event, n, first) of the events of one cell, from its rows in order."""
    batches = list(batches)
    if not batches:
        return
    rows = pa.Table.from_batches(batches)
    kind, span, count, value, before, over = (rows[c].to_numpy() for c in ("kind", "span", "count", "first", "before", "over"))
    event = kind == EVENT
    n = before[0] + np.cumsum(np.where(kind == START, count, np.where(kind == END, -count, 0)))
    place = np.cumsum(event)  # events up to here
    starts, ends = np.flatnonzero(kind == START), np.flatnonzero(kind == END)
    _, s, e = np.intersect1d(span[starts], span[ends], assume_unique=True, return_indices=True)
    loose_s, loose_e = np.delete(starts, s), np.delete(ends, e)  # the other bound lies in another cell
    events = int(event.sum())
    low = np.concatenate([place[starts[s]], place[loose_s], np.zeros(len(loose_e), int)])
    high = np.concatenate([place[ends[e]], np.full(len(loose_s), events), place[loose_e]])
    least = np.minimum(_least_over(low, high, value[np.concatenate([starts[s], loose_s, loose_e])], events), over[0])
    hit = n[event] > 0
    yield from pa.table({"event": rows["event"].filter(pa.array(event)).filter(pa.array(hit)), "n": n[event][hit], "first": least[hit]}).to_batches(10_000)


def in_force_summary(events: DataFrame, rules: DataFrame, on: list[str], event: str, at: str, rule: str, start: str, end: str) -> DataFrame:
    """(event, n, first): how many rules (whole numbers) are in force when an event of their group happens, and the least.

    The same as counting `in_force`, but no pair is made: rules of equal bounds
    are one row first; bounds and events are sorted together and cut into cells
    of about CELL rows wherever these end, also within a group or a time. Within
    a cell the running sum of bounds counts the rules and a tree over its events
    has the least. What a cell has to know of others is one row: the rules begun
    before, and the least of those that hold all through it.
    """
    spark = events.sparkSession
    low, high = _ends(rules, start, end)
    known = F.lit(True)
    for c in on:
        known &= F.col(c).isNotNull()
    spans = rules.where(known).select(*on, low.alias("s"), high.alias("e"), F.col(rule).cast("long").alias("rule")).where("s <= e")
    spans = stored(spans.groupBy(*on, "s", "e").agg(F.count("*").alias("count"), F.coalesce(F.min("rule"), F.lit(int(NONE))).alias("first")).withColumn("span", F.monotonically_increasing_id()))
    kind = events.schema[event].dataType
    bounds = spans.select(*on, F.explode(F.array(*[F.struct(F.col(c).alias("x"), F.lit(k).alias("kind")) for c, k in (("s", START), ("e", END))])).alias("b"), "span", "count", "first")
    bounds = bounds.select(*on, "b.x", "b.kind", "span", "count", "first", F.lit(None).cast(kind).alias("event"))
    x = F.least(F.greatest(F.col(at).cast("long"), F.lit(-FAR)), F.lit(FAR))
    zero = F.lit(0).cast("long")
    points = events.where(known & F.col(at).isNotNull()).select(*on, x.alias("x"), F.lit(EVENT).alias("kind"), zero.alias("span"), zero.alias("count"), zero.alias("first"), F.col(event).alias("event"))
    order = [*on, "x", "kind", "span", "event"]
    n = points.count() + 2 * spans.count()
    cells = max(1, -(-n // CELL))
    rows = bounds.unionByName(points).repartitionByRange(cells, *order).sortWithinPartitions(*order)
    rows = cut(rows.select("kind", "span", "count", "first", "event", F.spark_partition_id().alias("cell")))
    ends = rows.where(F.col("kind") != EVENT)
    sums = ends.groupBy("cell").agg(F.sum(F.when(F.col("kind") == START, F.col("count")).otherwise(-F.col("count"))).alias("sum"))
    every = spark.range(cells).select(F.col("id").cast("int").alias("cell"))
    earlier = Window.orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)  # a row a cell
    before = every.join(sums, "cell", "left").select("cell", F.coalesce(F.sum("sum").over(earlier), zero).alias("before"))
    # cells that lie between those of a rule's bounds, as the nodes of a binary tree that they fill
    through = ends.groupBy("span").agg(F.min("cell").alias("a"), F.max("cell").alias("b"), F.min("first").alias("first")).where("b - a > 1").selectExpr("a + 1 AS a", "b", "first")
    nodes = []
    for level in range(cells.bit_length()):
        a, b = (F.call_function("shiftright", c, F.lit(level)) for c in (F.col("a") + (1 << level) - 1, F.col("b")))
        nodes += [F.when((a < b) & (odd % 2 == 1), F.struct(F.lit(level).alias("level"), node.alias("node"))) for odd, node in ((a, a), (b, b - 1))]
    filled = through.select(F.explode(F.array_compact(F.array(*nodes))).alias("v"), "first").groupBy("v.level", "v.node").agg(F.min("first").alias("first"))
    asked = every.select("cell", F.explode(F.sequence(F.lit(0), F.lit(cells.bit_length() - 1))).alias("level")).withColumn("node", F.expr("shiftright(cell, level)"))
    over = asked.join(filled, ["level", "node"]).groupBy("cell").agg(F.min("first").alias("over"))
    told = before.join(over, "cell", "left").withColumn("over", F.coalesce("over", F.lit(int(NONE))))
    out = rows.join(F.broadcast(told), "cell").select("kind", "span", "count", "first", "event", "before", "over")  # a row a cell
    found = out.mapInArrow(_swept, f"event {kind.simpleString()}, n long, first long")
    return found.groupBy("event").agg(F.sum("n").alias("n"), F.nullif(F.min("first"), F.lit(int(NONE))).alias("first"))
