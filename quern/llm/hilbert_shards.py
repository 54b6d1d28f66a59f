"""Shards cut from a Hilbert curve through several metadata dimensions.

Every dimension is quantised to levels that hold about equal shares of the
rows: values fall into a bounded number of ordered cells, the cells are counted
over all rows, and a cell's level is the share of the rows before it. The
levels of a row are its place on a lattice, the place on the lattice its index
on a Hilbert curve. Rows are dealt by ranges of that index, sorted, numbered,
and the order is cut into runs of equal rows or of nearly equal bytes. Rows
near each other in all dimensions so share a file, and the least and greatest
values of a shard let a reader skip it (`bounds`).

The curve is walked by a small machine: its states are the orientations of a
cell, and a table made from the Gray code says for each state and corner which
step of the curve that corner is and how the curve turns inside it (C. Hamilton
and A. Rau-Chaplin, Compact Hilbert indices, 2008). A fold over the bits of the
levels runs it, so all of it stays in built-in expressions.

At size: one pass counts the cells (at most CELLS a dimension, combined on the
map side), one shuffle by ranges sorts the rows, which may be narrow; there is
one row per range in what is broadcast to number them. Equal values, sources or
texts of any number only make a run of the order, which ranges cut anywhere.

Defined results: null values come before all others of their dimension, NaN
after; a null text has no bytes; ties on the curve are ordered by the columns
given as tie-breakers, and rows equal in these, too, in any order; repeated
rows each get a slot; an empty table gives no rows; fewer rows than shards
leave shards empty; further columns pass through, whatever their names; a text
of any length counts whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import Steps, fresh, named, table

SHARDS = 40
#: Levels of a dimension are 2**BITS; a shard then covers few levels in each of three dimensions.
BITS = 8
#: What a dimension can be cut into before it is quantised: the first two bytes that differ between strings,
#: equal steps of time, or steps of 1/64 of the logarithm of a number.
CELLS = 1 << 17
ROW_BYTES = 16
_STATE_BITS = 16


def gray(i: int) -> int:
    return i ^ (i >> 1)


def curve_machine(dims: int) -> list[int]:
    """next[state << dims | corner] = step << 16 | state of the curve inside that corner.

    A state is (entry corner, direction of the curve), packed as entry * dims + direction.
    """
    size = 1 << dims

    def turn(x: int, by: int) -> int:
        by %= dims
        return ((x << by) | (x >> (dims - by))) & (size - 1)

    step_of = {gray(i): i for i in range(size)}
    out = []
    for state in range(size * dims):
        entry, way = divmod(state, dims)
        for corner in range(size):
            step = step_of[turn(corner ^ entry, dims - (way + 1))]
            inner = 0 if step == 0 else gray(2 * ((step - 1) // 2))
            ones = 0
            bits = step if step % 2 else step - 1
            while step and bits >> ones & 1:
                ones += 1
            into = entry ^ turn(inner, way + 1)
            out.append(step << _STATE_BITS | (into * dims + (way + ones + 1) % dims))
    return out


def curve_index(levels: list[Column], bits: int) -> Column:
    """Index of a lattice point on the Hilbert curve; levels are integers from 0 to 2**bits - 1."""
    dims = len(levels)
    if dims * bits + _STATE_BITS > 62 or dims << dims >= 1 << _STATE_BITS:
        raise ValueError("too many dimensions or bits for an index of 46 bits")
    machine = F.array(*[F.lit(x).cast("long") for x in curve_machine(dims)])
    packed = F.array(*[sum((F.shiftright(x, bit).bitwiseAND(1) * (1 << i) for i, x in enumerate(levels)), F.lit(0)).cast("int") for bit in range(bits - 1, -1, -1)])
    low = (1 << _STATE_BITS) - 1
    walked = F.aggregate(
        packed,
        F.lit(0).cast("long"),
        lambda at, corner: F.shiftleft(F.shiftright(at, _STATE_BITS), _STATE_BITS + dims) + F.get(machine, (at.bitwiseAND(low) * (1 << dims) + corner).cast("int")),
    )
    return F.shiftright(walked, _STATE_BITS)


def _cells(df: DataFrame, dims: list[str]) -> list[Column]:
    """For each dimension a column of ordered cells from 0 (null) on."""
    kinds = {f.name: f.dataType for f in df.schema}
    text = [d for d in dims if isinstance(kinds[d], T.StringType)]
    clock = [d for d in dims if isinstance(kinds[d], (T.DateType, T.TimestampType, T.TimestampNTZType))]
    ends = [f(named(d)).alias(f"{f.__name__}{i}") for i, d in enumerate(dims) if d in text + clock for f in (F.min, F.max)]
    seen = df.agg(*ends).first() if ends else None  # one row
    out = []
    for i, d in enumerate(dims):
        c = named(d)
        if d in text:
            low, high = ((seen[f"{f}{i}"] or "").encode() for f in ("min", "max"))
            same = 0
            while same < min(len(low), len(high)) and low[same] == high[same]:
                same += 1
            # two bytes after what all values begin with; a value that ends before counts as zero bytes
            pair = F.rpad(F.hex(F.substring(c.cast("binary"), same + 1, 2)), 4, "0")
            cell = F.conv(pair, 16, 10).cast("int") + 1
        elif d in clock:
            moment = F.unix_micros(c.cast("timestamp"))
            first, last = (F.unix_micros(F.lit(seen[f"{f}{i}"]).cast("timestamp")) for f in ("min", "max"))
            span = F.greatest((last - first).cast("double"), F.lit(1.0))
            cell = F.floor((moment - first).cast("double") / span * 65535).cast("int") + 1
        else:
            x = c.cast("double")
            size = F.floor(F.log1p(F.abs(x)) * 64)
            cell = F.when(F.isnan(x), CELLS).otherwise((F.signum(x) * size).cast("int") + CELLS // 2)
        out.append(F.coalesce(cell, F.lit(0)))
    return out


def _div(a: Column, b: Column) -> Column:
    """Whole quotient, exact."""
    return F.call_function("div", a.cast("decimal(38,0)"), b.cast("decimal(38,0)"))


def with_curve(df: DataFrame, dims: list[str], name: str, bits: int = BITS) -> DataFrame:
    """df with its index on the curve through dims.

    Cells are counted over all rows; what is joined back are at most CELLS + 1
    small rows a dimension, so it is broadcast.
    """
    cells = fresh(df.columns, *[f"cell{i}" for i in range(len(dims))])
    rows = df.select("*", *[c.alias(n) for c, n in zip(_cells(df, dims), cells)])
    counted = rows.select(F.explode(F.array(*[F.struct(F.lit(i).alias("dim"), named(c).alias("cell")) for i, c in enumerate(cells)])).alias("x")).groupBy("x.dim", "x.cell").agg(F.count("*").alias("n"))
    before = Window.partitionBy("dim").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("dim")
    share = F.coalesce(F.sum("n").over(before), F.lit(0))
    # the middle of the cell's rows, so that one value of most rows does not fall into the first level
    level = _div((2 * share + F.col("n")) * (1 << bits), 2 * F.sum("n").over(whole))
    steps = Steps(df.sparkSession)
    levels = steps.stored(counted.select("dim", "cell", level.cast("int").alias("level")), "levels")
    found = fresh([*df.columns, *cells], *[f"level{i}" for i in range(len(dims))])
    for i, (c, n) in enumerate(zip(cells, found)):
        mine = levels.where(F.col("dim") == i).select(F.col("cell").alias(c), F.col("level").alias(n))
        rows = rows.join(F.broadcast(mine), c)
    return rows.select(*[named(c) for c in df.columns], curve_index([named(n) for n in found], bits).alias(name))


def assign(df: DataFrame, dims: list[str], ties: list[str], shards: int = SHARDS, law: str = "rows", size: str | None = None, bits: int = BITS) -> DataFrame:
    """df with curve, shard and slot (or these names with _ behind, where df has them).

    law "rows": shards hold counts at most one apart. law "bytes": shards are
    cut where the sum of the column size passes their equal shares, so they
    differ by one row's size at most. Slots count from 0 in every shard, in
    the order of the curve. ties: columns that order rows of one index.
    """
    if law not in ("rows", "bytes") or (law == "bytes" and not size):
        raise ValueError("law is 'rows', or 'bytes' with a column of sizes")
    names = ("curve", "pos", "spread", "part", "n", "ahead", "all_n", "held", "ahead_bytes", "all_bytes", "rank", "shard", "slot", "first")
    curve, pos, spread, part, n, ahead, all_n, held, ahead_b, all_b, rank, to, slot, first = fresh(df.columns, *names)
    steps = Steps(df.sparkSession)
    keys = [curve, *ties, spread]
    # rows equal in everything are interchangeable: where they stood in the input lets ranges cut between them
    dealt = with_curve(df, dims, curve, bits).withColumn(spread, F.monotonically_increasing_id()).repartitionByRange(*[named(k) for k in keys]).sortWithinPartitions(*[named(k) for k in keys])
    rows = steps.stored(dealt.drop(spread).withColumn(pos, F.monotonically_increasing_id()), "ordered")
    at = F.shiftright(named(pos), 33)
    weight = named(size).cast("long") if law == "bytes" else F.lit(0).cast("long")
    ranges = rows.groupBy(at.alias(part)).agg(F.count("*").alias(n), F.sum(weight).alias(held))
    # a row for each range from here on
    so_far = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    offsets = ranges.select(
        part,
        F.coalesce(F.sum(n).over(so_far), F.lit(0)).alias(ahead),
        F.sum(n).over(everything).alias(all_n),
        F.coalesce(F.sum(held).over(so_far), F.lit(0)).alias(ahead_b),
        F.sum(held).over(everything).alias(all_b),
    )
    numbered = rows.withColumn(part, at).join(F.broadcast(offsets), part)
    numbered = numbered.withColumn(rank, named(ahead) + named(pos).bitwiseAND((1 << 33) - 1))
    if law == "rows":
        # shard s begins at the first rank r with r * shards >= s * all
        begin = _div(named(to) * named(all_n) + (shards - 1), F.lit(shards))
        out = numbered.withColumn(to, _div(named(rank) * shards, named(all_n)).cast("int")).withColumn(first, begin)
    else:
        in_range = Window.partitionBy(part).orderBy(pos).rowsBetween(Window.unboundedPreceding, -1)
        start = named(ahead_b) + F.coalesce(F.sum(weight).over(in_range), F.lit(0))
        shard = F.least(_div(start * shards, F.greatest(named(all_b), F.lit(1))).cast("int"), F.lit(shards - 1))
        numbered = steps.stored(numbered.withColumn(to, shard), "cut")
        begins = numbered.groupBy(to).agg(F.min(rank).alias(first))  # a row for each shard
        out = numbered.join(F.broadcast(begins), to)
    return out.select(*[named(c) for c in df.columns], curve, to, (named(rank) - named(first)).cast("long").alias(slot))


def bounds(assigned: DataFrame, dims: list[str], shard: str = "shard") -> DataFrame:
    """A row for each shard: its rows, and the least and greatest value of each dimension, to skip files by."""
    return assigned.groupBy(named(shard).alias("shard")).agg(F.count("*").alias("n_rows"), *[f(named(d)).alias(f"{f.__name__}_{d}") for d in dims for f in (F.min, F.max)])


def write_shards(assigned: DataFrame, path: str, shard: str = "shard", slot: str = "slot") -> None:
    """One sorted folder per shard; a shard is written by as many tasks as adaptive execution cuts it into."""
    assigned.repartitionByRange(named(shard), named(slot)).sortWithinPartitions(named(shard), named(slot)).write.partitionBy(shard).parquet(path)


def document_sizes(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source, size, text_crc32: what the shards are cut by, without texts."""
    raw = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")
    return docs.select("doc_id", "lang", "source", (F.length(raw) + ROW_BYTES).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"))


def query(spark, sf_dir: str) -> DataFrame:
    rows = assign(document_sizes(table(spark, sf_dir, "documents")), ["lang", "source", "size"], ["text_crc32", "doc_id"])
    return rows.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "curve")
