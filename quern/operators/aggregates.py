"""Group-bys of the analytics layer. All are map-side combined; exact quantiles
are used where the contract is exact."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def share(part: Column, whole: Column, digits: int = 2) -> Column:
    """Percentage, null when the whole is zero."""
    return F.round(100.0 * part / F.when(whole != 0, whole), digits)


def hourly_performance(df: DataFrame, ts: str, value: str, ok: Column) -> DataFrame:
    """Per hour: count, mean, continuous p50/p95/p99, max, successes, failures, rate."""
    out = df.groupBy(F.date_trunc("hour", ts).alias("hour")).agg(
        F.count("*").alias("n"),
        F.avg(value).alias("mean"),
        *[F.percentile(value, p).alias(f"p{round(p * 100)}") for p in (0.5, 0.95, 0.99)],
        F.max(value).alias("max"),
        F.count_if(ok).alias("n_ok"),
        F.count_if(~ok).alias("n_failed"),
    )
    return out.withColumn("ok_percent", share(F.col("n_ok"), F.col("n")))


def performance_anomalies(df: DataFrame, ts: str, value: str, k: float) -> DataFrame:
    """Hours whose mean lies k sample deviations over the whole mean, or whose
    count is k times the mean count."""
    whole = df.agg(F.avg(value).alias("m"), F.stddev_samp(value).alias("s"))
    hours = df.groupBy(F.date_trunc("hour", ts).alias("hour")).agg(F.avg(value).alias("mean"), F.count("*").alias("n"))
    typical = hours.agg(F.avg("n").alias("typical"))
    rows = hours.join(F.broadcast(whole), how="cross").join(F.broadcast(typical), how="cross")  # one row each
    slow, busy = F.col("mean") > F.col("m") + k * F.col("s"), F.col("n") > k * F.col("typical")
    grave = F.when(slow, F.col("mean") > F.col("m") + 2 * k * F.col("s")).otherwise(F.col("n") > 2 * k * F.col("typical"))
    return rows.where(slow | busy).select("hour", "mean", "n", F.when(slow, "SLOW").otherwise("HIGH_VOLUME").alias("kind"), F.when(grave, "HIGH").otherwise("MEDIUM").alias("severity"))


def popular(df: DataFrame, key: str, value: str, since: Column, least: int, limit: int) -> DataFrame:
    """Keys used often since a time, with the mean of positive values."""
    got = df.where(since).groupBy(key).agg(F.count("*").alias("n"), F.avg(F.when(F.col(value) > 0, F.col(value))).alias("mean_value"), F.max(value).alias("max_value"))
    return got.where(F.col("n") >= least).orderBy(F.desc("n"), key).limit(limit)


def h_index(counts: DataFrame, by: str, n: str, key: str) -> DataFrame:
    """Largest r such that r items have at least r citations, per group."""
    rank = F.row_number().over(Window.partitionBy(by).orderBy(F.desc(n), key))
    return counts.withColumn("r", rank).groupBy(by).agg(F.coalesce(F.max(F.when(F.col(n) >= F.col("r"), F.col("r"))), F.lit(0)).alias("h_index"))


def nearest_rank(df: DataFrame, key: str, order: list, value: str, last: int, percents=(50, 95, 99)) -> DataFrame:
    """Statistics of the last rows per key; percentile p is element floor(n*p/100) of the sorted values."""
    recent = df.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col("_r") <= last)
    out = recent.groupBy(key).agg(F.array_sort(F.collect_list(value)).alias("v"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("stdev"), F.percentile(value, 0.5).alias("median"))
    n = F.size("v")
    cols = {f"p{p}": F.element_at("v", F.least(F.floor(n * p / 100).cast("int"), n - 1) + 1) for p in percents}
    return out.withColumns(cols | {"n": n, "min": F.col("v")[0], "max": F.element_at("v", -1)}).drop("v")


def bottlenecks(df: DataFrame, key: str, value: str, factor: float = 1.5) -> DataFrame:
    got = df.groupBy(key).agg(F.count("*").alias("n"), F.avg(value).alias("mean"), F.percentile(value, 0.95).alias("p95"))
    return got.where((F.col("n") >= 2) & (F.col("p95") > factor * F.col("mean")))


def compliance(df: DataFrame, key: str, ok: Column) -> DataFrame:
    got = df.groupBy(key).agg(F.count("*").alias("total"), F.count_if(~ok).alias("violations"))
    return got.withColumn("rate", 1 - F.col("violations") / F.col("total"))


def histogram_percentiles(df: DataFrame, key: str, value: str) -> DataFrame:
    """p50 is the lower median; p95 and p99 lie at p*(n-1): exact positions as
    they stand, others interpolated and rounded half to even.

    Values are numbered over the whole table in ranges of (key, value), so a key
    of any number of rows is spread; only the five values asked for are gathered.
    """
    from .windows import numbered

    rows = numbered(df.where(F.col(value).isNotNull()).select(F.struct(F.col(key).alias("k"), F.col(value).alias("v")).alias("o")), "o", "at")
    whole = rows.groupBy(F.col("o.k").alias("k")).agg(F.count("*").alias("n"), F.min("at").alias("first"))
    mine = rows.select(F.col("o.k").alias("k_"), F.col("o.v").alias("v"), "at")
    placed = mine.join(whole, F.col("k_").eqNullSafe(F.col("k"))).select("k", "n", "v", (F.col("at") - F.col("first")).alias("at"))
    n = F.col("n")
    low = lambda p: F.floor(p * (n - 1)).cast("long")
    asked = [F.floor((n + 1) / 2).cast("long") - 1, *[x for p in (0.95, 0.99) for x in (low(p), F.least(low(p) + 1, n - 1))]]
    got = placed.where(F.array_contains(F.array(*asked), F.col("at"))).groupBy("k", "n").agg(F.map_from_entries(F.collect_list(F.struct("at", "v"))).alias("m"))

    def at(p: float) -> Column:
        place = p * (n - 1)
        a, b = F.element_at("m", low(p)), F.element_at("m", F.least(low(p) + 1, n - 1))
        return F.when(place == low(p), a).otherwise(F.bround(a + (b - a) * (place - low(p)), 0))

    return got.select(F.col("k").alias(key), F.element_at("m", asked[0]).alias("p50"), at(0.95).alias("p95"), at(0.99).alias("p99"))



def buckets(df: DataFrame, key: str, value: str, edges) -> DataFrame:
    """Cumulative counts up to each edge, sum and count."""
    cols = [F.count_if(F.col(value) <= e).alias(f"le_{e}") for e in edges]
    return df.groupBy(key).agg(*cols, F.sum(value).alias("sum"), F.count("*").alias("count"))


def mean_and_deviation(df: DataFrame, *metrics: str) -> DataFrame:
    return df.agg(*[f(m).alias(f"{n}_{m}") for m in metrics for n, f in (("mean", F.avg), ("std", F.stddev_pop))], F.count("*").alias("n"))


def blame(df: DataFrame, parties: str, days: str) -> DataFrame:
    """Per party: delays, days, mean. One delay may count for several parties."""
    return df.select(F.explode(parties).alias("party"), days).groupBy("party").agg(F.count("*").alias("n"), F.sum(days).alias("total"), F.avg(days).alias("mean"))


def evidence_confidence(df: DataFrame, key: str, confidence: str) -> DataFrame:
    """Mean confidence times .7 + .3 * min(n/5, 1), at most 1."""
    got = df.groupBy(key).agg(F.avg(confidence).alias("m"), F.count("*").alias("n"))
    return got.select(key, "n", F.least(F.lit(1.0), F.col("m") * (0.7 + 0.3 * F.least(F.col("n") / 5, F.lit(1.0)))).alias("confidence"))


def best(df: DataFrame, key: str, metric: str, minimize: bool = False) -> DataFrame:
    order = F.asc(metric) if minimize else F.desc(metric)
    return df.where(F.col(metric).isNotNull()).orderBy(order, key).limit(1)
