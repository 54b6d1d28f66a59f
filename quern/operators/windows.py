"""Rolling statistics, anomalies, trends and timelines over partitioned windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def micros(ts: str) -> Column:
    """Microseconds since the epoch, of times with or without a zone."""
    return F.unix_micros(F.col(ts).cast("timestamp"))


def _stats(value: str, w) -> dict[str, Column]:
    out = {"mean": F.avg(value).over(w), "std": F.stddev_pop(value).over(w), "min": F.min(value).over(w), "max": F.max(value).over(w), "n": F.count(value).over(w)}
    return out | {f"p{round(100 * p)}": F.percentile(value, p).over(w) for p in (0.25, 0.5, 0.75, 0.95, 0.99)}


def rolling_count(df: DataFrame, key: str, order: list[str], value: str, last: int, prefix: str = "") -> DataFrame:
    """Statistics of the last rows up to each row; population deviation, linear quantiles."""
    w = Window.partitionBy(key).orderBy(*order).rowsBetween(-(last - 1), 0)
    return df.withColumns({prefix + k: c for k, c in _stats(value, w).items()})


def rolling_time(df: DataFrame, key: str, ts: str, value: str, seconds: int) -> DataFrame:
    """Statistics of the rows at most so many seconds older than each row.

    Time is cut into spans of that length. A row's window is the end of the span
    before its own and the beginning of its own: both are running aggregates,
    computed once a row, and met at the row's time; work does not grow with the
    rows of a window, and a key is as many tasks as it has spans.
    """
    step = seconds * 1_000_000
    rows = df.withColumn("_t", micros(ts)).withColumn("_span", F.floor(F.col("_t") / step))
    by = Window.partitionBy(key, "_span")
    upto, from_ = (by.orderBy(o).rangeBetween(Window.unboundedPreceding, Window.currentRow) for o in (F.asc("_t"), F.desc("_t")))

    def running(w) -> Column:
        return F.struct(F.count(value).over(w).alias("n"), F.avg(value).over(w).alias("mean"), F.var_pop(value).over(w).alias("var"), F.min(value).over(w).alias("min"), F.max(value).over(w).alias("max"))

    own = rows.withColumn("_a", running(upto))
    # the rest of the span before, from each of its times on, moved to where the window leaves it
    ends = rows.where("_t IS NOT NULL").withColumn("_b", running(from_)).groupBy(key, "_span", "_t").agg(F.first("_b").alias("_b"))
    ends = ends.select(key, (F.col("_span") + 1).alias("_span"), (F.col("_t") + step).alias("_t"), "_b")
    met = own.unionByName(ends.withColumn("_end", F.lit(True)), allowMissingColumns=True)
    met = met.withColumn("_b", F.last("_b", ignorenulls=True).over(from_)).where("_end IS NULL")
    a, b = F.col("_a"), F.when(F.col("_t").isNotNull(), F.col("_b"))
    na, nb = a["n"], F.coalesce(b["n"], F.lit(0))
    n = na + nb
    ma, mb = F.coalesce(a["mean"], F.lit(0.0)), F.coalesce(b["mean"], F.lit(0.0))
    spread = na * F.coalesce(a["var"], F.lit(0.0)) + nb * F.coalesce(b["var"], F.lit(0.0)) + na * nb / n * (ma - mb) * (ma - mb)
    out = {"mean": F.when(n > 0, (na * ma + nb * mb) / n), "std": F.when(n > 0, F.sqrt(spread / n)), "min": F.least(a["min"], b["min"]), "max": F.greatest(a["max"], b["max"]), "n": n}
    return met.select(*df.columns, *[c.alias(k) for k, c in out.items()])


def several_windows(df: DataFrame, key: str, order: list[str], value: str, sizes) -> DataFrame:
    cols = {}
    for n in sizes:
        w = Window.partitionBy(key).orderBy(*order).rowsBetween(-(n - 1), 0)
        cols |= {f"mean_{n}": F.avg(value).over(w), f"max_{n}": F.max(value).over(w)}
    return df.withColumns(cols)


def trend(df: DataFrame, key: str, ts: str, value: str) -> DataFrame:
    """Least-squares slope per second since the first point; null under two points."""
    first = F.min(micros(ts)).over(Window.partitionBy(key))
    sec = (micros(ts) - first) / 1e6
    got = df.withColumn("_s", sec).groupBy(key).agg(F.regr_slope(value, "_s").alias("slope"), F.count("*").alias("n"))
    return got.select(key, F.when(F.col("n") >= 2, F.col("slope")).alias("slope"))


def rate_of_change(df: DataFrame, key: str, ts: str, value: str, tie: str) -> DataFrame:
    """Percent change per second between first and last row; null from zero or without time."""
    place = F.struct(ts, tie)
    got = df.groupBy(key).agg(F.min_by(value, place).alias("a"), F.max_by(value, place).alias("b"), F.min(micros(ts)).alias("s"), F.max(micros(ts)).alias("e"))
    seconds = (F.col("e") - F.col("s")) / 1e6
    ok = (F.col("a") != 0) & (seconds > 0)
    return got.select(key, F.when(ok, 100 * (F.col("b") - F.col("a")) / F.when(ok, F.col("a")) / F.when(ok, seconds)).alias("percent_per_second"))


def zscore_anomalies(df: DataFrame, key: str, order: list[str], value: str, last: int, threshold: float, least: int) -> DataFrame:
    """Rows far from the mean of the rows before them (population deviation)."""
    w = Window.partitionBy(key).orderBy(*order).rowsBetween(-last, -1)
    out = df.withColumns({"_m": F.avg(value).over(w), "_s": F.stddev_pop(value).over(w), "_n": F.count(value).over(w)})
    out = out.where((F.col("_n") >= least) & (F.col("_s") > 0)).withColumn("z", F.abs(F.col(value) - F.col("_m")) / F.col("_s"))
    severity = F.when(F.col("z") > 5, "critical").when(F.col("z") > 4, "high").when(F.col("z") > 3.5, "medium").otherwise("low")
    return out.where(F.col("z") > threshold).withColumn("severity", severity).drop("_m", "_s", "_n")


def iqr_anomalies(df: DataFrame, key: str, value: str, k: float = 1.5) -> DataFrame:
    """Rows outside [q1 - k iqr, q3 + k iqr] of their key, with the robust z-score."""
    q = df.groupBy(key).agg(*[F.percentile(value, p).alias(n) for p, n in ((0.25, "q1"), (0.5, "med"), (0.75, "q3"))])
    out = df.join(q, key)
    mad = out.groupBy(key).agg(F.percentile(F.abs(F.col(value) - F.col("med")), 0.5).alias("mad"))
    out = out.join(mad, key).withColumn("iqr", F.col("q3") - F.col("q1"))
    far = F.greatest(F.col("q1") - F.col(value), F.col(value) - F.col("q3")) / F.when(F.col("iqr") > 0, F.col("iqr"))
    out = out.withColumns({"far": far, "robust_z": F.abs(F.col(value) - F.col("med")) / F.when(F.col("mad") > 0, 1.4826 * F.col("mad"))})
    severity = F.when(F.col("far") > 3, "critical").when(F.col("far") > 2, "high").when(F.col("far") > 1, "medium").otherwise("low")
    return out.where(F.col("far") > k).withColumn("severity", severity)


def degradation(df: DataFrame, key: str, order: list[str], value: str, higher_is_better: bool = True) -> DataFrame:
    """Relative fall of the mean from the first half of the history to the second."""
    w = Window.partitionBy(key)
    half = F.row_number().over(w.orderBy(*order)) <= F.floor(F.count("*").over(w) / 2)
    got = df.withColumn("_first", half).groupBy(key).agg(F.avg(F.when(F.col("_first"), F.col(value))).alias("a"), F.avg(F.when(~F.col("_first"), F.col(value))).alias("b"))
    fall = (F.col("a") - F.col("b")) / F.when(F.col("a") != 0, F.col("a")) * (1 if higher_is_better else -1)
    severity = F.when(F.col("fall") >= 0.3, "critical").when(F.col("fall") >= 0.2, "high").when(F.col("fall") >= 0.15, "medium").otherwise("none")
    return got.select(key, fall.alias("fall")).withColumn("severity", severity)


def statistical_outliers(df: DataFrame, key: str, value: str, limit: float = 3.0, least: int = 10) -> DataFrame:
    """Rows whose sample z-score within their key exceeds the limit."""
    w = Window.partitionBy(key)
    out = df.withColumns({"_n": F.count(value).over(w), "_m": F.avg(value).over(w), "_s": F.stddev_samp(value).over(w)})
    out = out.where((F.col("_n") >= least) & (F.col("_s") > 0)).withColumn("z", (F.col(value) - F.col("_m")) / F.col("_s"))
    return out.where(F.abs("z") > limit).drop("_n", "_m", "_s")


def ranked(df: DataFrame, by: list, order: list, name: str = "rank") -> DataFrame:
    """1..n by the order within each partition."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order)))


def top_per(df: DataFrame, by: list, order: list, n: int, name: str = "rank") -> DataFrame:
    return ranked(df, by, order, name).where(F.col(name) <= n)


def timeline_conflicts(df: DataFrame, date: str, text: str) -> DataFrame:
    """Dates with several events that say different things."""
    got = df.groupBy(date).agg(F.count("*").alias("n"), F.count_distinct(text).alias("n_distinct"))
    return got.where((F.col("n") > 1) & (F.col("n_distinct") > 1))


def density(df: DataFrame, by: str, date: str) -> DataFrame:
    """Events per distinct date."""
    return df.groupBy(by).agg((F.count("*") / F.count_distinct(date)).alias("density"))


def interval_events(df: DataFrame, key: str, start: str, end: str) -> DataFrame:
    """Start and end of every interval as events."""
    a = df.select(key, F.lit("start").alias("kind"), F.col(start).alias("at"))
    b = df.where(F.col(end).isNotNull()).select(key, F.lit("end").alias("kind"), F.col(end).alias("at"))
    return a.unionByName(b)


def suppress_repeats(df: DataFrame, key: str, seconds: Column, id_column: str, window: float) -> DataFrame:
    """Drops an alert less than a window after the last one sent with its key.

    Whether one is sent depends on the one sent before, so each key's rows,
    sorted within a partition, are judged while they stream by; one time is held.
    """
    rows = df.withColumn("seconds_", seconds.cast("double"))
    at = df.columns.index(key)

    def run(batches):
        import pyarrow as pa

        now, last = object(), None
        for batch in batches:
            keep = []
            for k, s in zip(batch.column(at).to_pylist(), batch.column(len(df_columns)).to_pylist()):
                if k != now:
                    now, last = k, None
                send = s is not None and (last is None or s - last >= window)
                last = s if send else last
                keep.append(send)
            yield batch.select(range(len(df_columns))).filter(pa.array(keep, pa.bool_()))

    df_columns = df.columns
    # rows without a time are not sent
    return rows.repartition(key).sortWithinPartitions(key, "seconds_", id_column).mapInArrow(run, df.schema)


def running_total(df: DataFrame, order: str, value: str, name: str) -> DataFrame:
    """Adds the sum of value up to each row, in ascending order, rows with equal order together.

    The frame is dealt into ranges of the order; each range sums its own rows,
    and the totals of the ranges before it, one number each, are added.
    """
    from ..shared import cut

    dealt = df.repartitionByRange(order).withColumn("range_", F.spark_partition_id())
    dealt = cut(dealt)
    totals = dealt.groupBy("range_").agg(F.sum(value).alias("total_"))
    before = totals.withColumn("before_", F.coalesce(F.sum("total_").over(Window.orderBy("range_").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("range_", "before_")
    own = F.sum(value).over(Window.partitionBy("range_").orderBy(order).rangeBetween(Window.unboundedPreceding, Window.currentRow))
    return dealt.withColumn("own_", own).join(F.broadcast(before), "range_").withColumn(name, F.col("own_") + F.col("before_")).drop("range_", "own_", "before_")


def numbered(df: DataFrame, order: str, name: str) -> DataFrame:
    """Adds each row's position from 0, in ascending order: numbers within ranges of the order plus the rows of the ranges before."""
    from ..shared import cut

    dealt = cut(df.repartitionByRange(order).withColumn("range_", F.spark_partition_id()))
    counts = dealt.groupBy("range_").agg(F.count("*").alias("total_"))
    before = counts.withColumn("before_", F.coalesce(F.sum("total_").over(Window.orderBy("range_").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("range_", "before_")
    own = F.row_number().over(Window.partitionBy("range_").orderBy(order)) - 1
    return dealt.withColumn("own_", own).join(F.broadcast(before), "range_").withColumn(name, (F.col("own_") + F.col("before_")).cast("long")).drop("range_", "own_", "before_")
