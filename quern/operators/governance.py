"""Data quality, drift, fairness, lineage, ledgers, causal effects, bandits, uncertainty."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .graph import cut

# Quality


def is_missing(df: DataFrame, name: str) -> Column:
    """Null, empty text, or not a number."""
    kind = dict(df.dtypes)[name]
    out = F.col(name).isNull()
    if kind == "string":
        return out | (F.col(name) == "")
    return out | F.isnan(name) if kind in ("double", "float") else out


def completeness(df: DataFrame, columns: list[str]) -> DataFrame:
    """(feature, missing, severity): share missing, none up to 5 %, high over 20 %."""
    one = df.agg(F.count("*").alias("n"), *[F.count_if(is_missing(df, c)).alias(c) for c in columns])
    rows = one.select(F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), (F.col(c) / F.col("n")).alias("missing")) for c in columns])).alias("r")).select("r.*")
    return rows.withColumn("severity", F.when(F.col("missing") > 0.2, "high").when(F.col("missing") > 0.05, "medium").otherwise("none"))


def outlier_share(df: DataFrame, value: str) -> DataFrame:
    """One row: share outside 1.5 interquartile ranges of the linear quartiles."""
    q = df.agg(F.percentile(value, 0.25).alias("q1"), F.percentile(value, 0.75).alias("q3"))
    r = 1.5 * (F.col("q3") - F.col("q1"))
    rows = df.where(F.col(value).isNotNull()).join(F.broadcast(q), how="cross")  # one row
    return rows.agg(F.avg(((F.col(value) < F.col("q1") - r) | (F.col(value) > F.col("q3") + r)).cast("int")).alias("outliers"))


def valid_share(df: DataFrame, ranges: dict[str, tuple]) -> DataFrame:
    return df.agg(*[F.avg(F.col(c).between(lo, hi).cast("int")).alias(c) for c, (lo, hi) in ranges.items()])


def quality_report(df: DataFrame, columns: list[str], numeric: list[str], ranges: dict[str, tuple]) -> DataFrame:
    """completeness, consistency, validity and their weighted sum (.4, .3, .3)."""
    complete = completeness(df, columns).agg((1 - F.avg("missing")).alias("completeness"))
    parts = [outlier_share(df, c).select((1 - F.col("outliers")).alias("c")) for c in numeric]
    parts += [df.limit(1).select(F.lit(1.0).alias("c")) for c in columns if c not in numeric]
    consistent = reduce(DataFrame.union, parts).agg(F.avg("c").alias("consistency"))
    valid = valid_share(df, ranges).select((reduce(lambda a, b: a + b, [F.col(c) for c in ranges]) / len(ranges)).alias("validity"))
    out = complete.join(consistent, how="cross").join(valid, how="cross")  # one row each
    return out.withColumn("score", 0.4 * F.col("completeness") + 0.3 * F.col("consistency") + 0.3 * F.col("validity"))


# Drift


def ks_statistic(before: DataFrame, after: DataFrame, value: str, by: str | None = None) -> DataFrame:
    """Two-sample Kolmogorov-Smirnov statistic, sizes and asymptotic p-value.

    Counts are summed per value first; running sums are taken in ranges of the values.
    """
    from .windows import running_total

    both = before.select(F.col(value).alias("v"), F.lit(1).alias("a"), F.lit(0).alias("b")).union(after.select(F.col(value).alias("v"), F.lit(0), F.lit(1))).where("v IS NOT NULL")
    per = both.groupBy("v").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    total = per.agg(F.sum("a").alias("na"), F.sum("b").alias("nb"))
    # both sums at once: the first one counts in a unit that the second does not reach
    unit = 1 << 31
    run = running_total(per.select("v", (F.col("a").cast("decimal(38,0)") * unit * unit + F.col("b")).alias("ab")), "v", "ab", "run")
    run = run.select(F.call_function("div", F.col("run"), F.lit(unit).cast("decimal(38,0)") * unit).alias("ca"), (F.col("run") % (F.lit(unit).cast("decimal(38,0)") * unit)).cast("long").alias("cb")).join(F.broadcast(total), how="cross")  # one row
    got = run.agg(F.max(F.abs(F.col("ca") / F.col("na") - F.col("cb") / F.col("nb"))).alias("statistic"), F.first("na").alias("n_before"), F.first("nb").alias("n_after"))
    root = F.sqrt(F.col("n_before") * F.col("n_after") / (F.col("n_before") + F.col("n_after")))
    lam = (root + 0.12 + 0.11 / root) * F.col("statistic")
    terms = F.transform(F.sequence(F.lit(1), F.lit(100)), lambda k: F.pow(F.lit(-1.0), k - 1) * F.exp(-2 * k * k * lam * lam))
    p = 2 * F.aggregate(terms, F.lit(0.0), lambda s, x: s + x)
    return got.withColumn("p_value", F.when(lam < 0.2, 1.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), p))))


def chi_square(before: DataFrame, after: DataFrame, category: str) -> DataFrame:
    """Chi-square of the counts after against the shares before, by category; and over n."""
    a = before.groupBy(category).agg(F.count("*").alias("a"))
    b = after.groupBy(category).agg(F.count("*").alias("b"))
    both = a.join(b, category, "full").fillna(0, ["a", "b"])
    total = both.agg(F.sum("a").alias("na"), F.sum("b").alias("nb"))
    expected = F.col("a") / F.col("na") * F.col("nb")
    rows = both.join(F.broadcast(total), how="cross").where("a > 0")  # one row
    return rows.agg(F.sum(F.pow(F.col("b") - expected, 2) / expected).alias("statistic"), (F.sum(F.pow(F.col("b") - expected, 2) / expected) / F.first("nb")).alias("score"))


# Fairness


def rates(df: DataFrame, group: str, prediction: str, label: str | None = None) -> DataFrame:
    """Per group: size, positive rate and, with a label, true and false positive rates."""
    p = F.col(prediction).cast("double")
    cols = [F.count("*").alias("n"), F.avg(p).alias("positive")]
    if label:
        cols += [F.avg(F.when(F.col(label) == 1, p)).alias("tpr"), F.avg(F.when(F.col(label) == 0, p)).alias("fpr")]
    return df.groupBy(group).agg(*cols)


def fairness(df: DataFrame, group: str, prediction: str, label: str) -> DataFrame:
    """demographic parity, equal opportunity, equalized odds: 1 less the gaps."""
    r = rates(df, group, prediction, label)
    gap = lambda c: F.coalesce(F.max(c) - F.min(c), F.lit(0.0))
    g = r.agg(gap("positive").alias("p"), gap("tpr").alias("t"), gap("fpr").alias("f"))
    return g.select((1 - F.col("p")).alias("demographic_parity"), (1 - F.col("t")).alias("equal_opportunity"), F.greatest(F.lit(0.0), 1 - (F.col("t") + F.col("f")) / 2).alias("equalized_odds"))


def disparate_impact(df: DataFrame, privileged: Column, prediction: str) -> DataFrame:
    """Rate of the unprivileged over that of the privileged; 1 if a side is empty or both are 0, 0 over 0 alone."""
    p = F.col(prediction).cast("double")
    r = df.agg(F.avg(F.when(privileged, p)).alias("a"), F.avg(F.when(~privileged, p)).alias("b"))
    out = F.when(F.col("a").isNull() | F.col("b").isNull(), 1.0).when(F.col("a") == 0, F.when(F.col("b") == 0, 1.0).otherwise(0.0))
    return r.select(out.otherwise(F.col("b") / F.when(F.col("a") != 0, F.col("a"))).alias("disparate_impact"))


# Lineage and versions


def trace(records: DataFrame, start, depth: int = 10, forward: bool = False) -> DataFrame:
    """(node, hops): artefacts an output came from, or went into. records: (output_id, source_ids)."""
    from .graph import distances

    e = records.select(F.col("output_id").alias("src"), F.explode("source_ids").alias("dst"))
    e = e.toDF("dst", "src").select("src", "dst") if forward else e
    return distances(e, records.sparkSession.range(1).select(F.lit(start).alias("node")), depth)


def compare_versions(a: DataFrame, b: DataFrame, metric: str, value: str) -> DataFrame:
    """(metric, before, after, change): missing counts as 0."""
    out = a.select(metric, F.col(value).alias("before")).join(b.select(metric, F.col(value).alias("after")), metric, "full").fillna(0, ["before", "after"])
    return out.withColumn("change", F.col("after") - F.col("before"))


def split(df: DataFrame, key: str, shares: dict[str, float], seed: str = "") -> DataFrame:
    """split: rows in the order of a hash of their key, cut by shares of the count.

    Each row's split depends on a hash threshold alone, so no global sort is needed.
    """
    place = F.pmod(F.xxhash64(F.lit(seed), key), F.lit(1_000_000)) / 1_000_000
    out, bound = None, 0.0
    names = list(shares)
    for name in names[:-1]:
        bound += shares[name]
        out = F.when(place < bound, name) if out is None else out.when(place < bound, name)
    return df.withColumn("split", out.otherwise(names[-1]) if out is not None else F.lit(names[-1]))


# Ledgers


def chained(entries: DataFrame, chain: str, order: str, body: str, head: str | None = None) -> DataFrame:
    """prev_hash and hash of each entry: sha256 over the entry and the hash before.

    A chain is sequential: its entries, sorted within a partition, are hashed
    one after the other while they stream by; one hash is held. head names a
    column with the hash a chain goes on from.
    """
    import hashlib

    import pyarrow as pa

    at = [entries.columns.index(c) for c in (chain, body, *([head] if head else []))]

    def run(batches):
        last_chain, last = object(), ""
        for batch in batches:
            before, own = [], []
            columns = [batch.column(i).to_pylist() for i in at]
            for row in zip(*columns):
                if row[0] != last_chain:
                    last_chain, last = row[0], (row[2] if head else None) or "0" * 64
                before.append(last)
                last = hashlib.sha256(((row[1] or "") + last).encode()).hexdigest()
                own.append(last)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(before, pa.string()), pa.array(own, pa.string())], [*batch.schema.names, "prev_hash", "hash"])

    schema = T.StructType([*entries.schema.fields, T.StructField("prev_hash", T.StringType()), T.StructField("hash", T.StringType())])
    return entries.repartition(chain).sortWithinPartitions(chain, order).mapInArrow(run, schema)


def verify_chain(entries: DataFrame, chain: str, order: str, body: str) -> DataFrame:
    """Entries whose hash or link is wrong; every link is checked in parallel."""
    before = F.coalesce(F.lag("hash").over(Window.partitionBy(chain).orderBy(order)), F.lit("0" * 64))
    out = entries.withColumn("linked", F.col("prev_hash") == before).withColumn("sound", F.col("hash") == F.sha2(F.concat(F.col(body), F.col("prev_hash")), 256))
    return out.where(~(F.col("linked") & F.col("sound")))


def merkle_levels(leaves: DataFrame, leaf: str) -> list[DataFrame]:
    """(i, h) of every level, leaves first: leaves sorted, paired by position, an odd last one with itself.

    Positions come from a range sort once; each level halves the frame, so the
    work is that of one pass.
    """
    from .windows import numbered

    levels = [cut(numbered(leaves.select(F.col(leaf).alias("h")), "h", "i"))]
    while levels[-1].count() > 1:
        pairs = levels[-1].groupBy(F.floor(F.col("i") / 2).alias("i")).agg(F.min_by("h", "i").alias("a"), F.max_by("h", "i").alias("b"))
        levels.append(cut(pairs.select("i", F.sha2(F.concat("a", "b"), 256).alias("h"))))
    return levels


def merkle_root(leaves: DataFrame, leaf: str) -> DataFrame:
    """(root) of the sorted leaves."""
    return merkle_levels(leaves, leaf)[-1].select(F.col("h").alias("root"))


def merkle_proofs(leaves: DataFrame, leaf: str, wanted: DataFrame) -> DataFrame:
    """(h, level, sibling, side): what proves each wanted leaf (h), from the leaves up; side tells where the sibling stands."""
    levels = merkle_levels(leaves, leaf)
    now = levels[0].join(wanted.select("h").distinct(), "h").groupBy("h").agg(F.min("i").alias("i"))
    out = None
    for depth, level in enumerate(levels[:-1]):
        even = F.col("i") % 2 == 0
        near = now.withColumn("other", F.when(even, F.col("i") + 1).otherwise(F.col("i") - 1))
        # the last of an odd level stands beside itself
        beside = level.select(F.col("i").alias("at"), F.col("h").alias("sibling"))
        own = level.select(F.col("i").alias("own_at"), F.col("h").alias("own"))
        got = near.join(beside, F.col("other") == F.col("at"), "left").join(own, F.col("i") == F.col("own_at"))
        step = got.select("h", F.lit(depth).alias("level"), F.coalesce("sibling", "own").alias("sibling"), F.when(even, "right").otherwise("left").alias("side"))
        out = step if out is None else out.unionByName(step)
        now = cut(now.select("h", F.floor(F.col("i") / 2).alias("i")))
    return out if out is not None else wanted.select("h", F.lit(0).alias("level"), F.lit("").alias("sibling"), F.lit("right").alias("side")).limit(0)


def power(effect: float, n: int, alpha: float = 0.05) -> float:
    """Of a two-sided test of two samples of n each, for an effect in standard deviations."""
    from statistics import NormalDist

    z = NormalDist()
    return z.cdf(abs(effect) * math.sqrt(n / 2) - z.inv_cdf(1 - alpha / 2))


def sequential_test(df: DataFrame, arm: str, value: str, order: str, a, b, looks: int, alpha: float = 0.05, least: int = 10) -> DataFrame:
    """(look, n_a, n_b, z, stop): the arms compared after each of so many equal shares of the rows, in order.

    The bound is split evenly over the looks (Bonferroni), so that stopping at
    the first look beyond it keeps the error at alpha. Sums are taken per look
    first and added up over the few looks.
    """
    from statistics import NormalDist

    from .windows import numbered

    rows = numbered(df.where(F.col(arm).isin(a, b)).select(arm, value, order), order, "place_")
    rows = rows.join(F.broadcast(rows.agg(F.count("*").alias("total_"))), how="cross")  # one row
    rows = rows.withColumn("look", F.floor(F.col("place_") * looks / F.col("total_")).cast("int") + 1)
    sums = rows.groupBy("look").agg(*[f for k, x in (("a", a), ("b", b)) for f in (F.count_if(F.col(arm) == x).alias(f"n_{k}"), F.sum(F.when(F.col(arm) == x, F.col(value))).alias(f"s_{k}"), F.sum(F.when(F.col(arm) == x, F.col(value) * F.col(value))).alias(f"q_{k}"))])
    w = Window.orderBy("look").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sums = sums.select("look", *[F.sum(F.coalesce(c, F.lit(0))).over(w).alias(c) for c in ("n_a", "s_a", "q_a", "n_b", "s_b", "q_b")])
    part = lambda k: (F.col(f"q_{k}") - F.col(f"s_{k}") * F.col(f"s_{k}") / F.col(f"n_{k}")) / (F.col(f"n_{k}") - 1) / F.col(f"n_{k}")
    enough = (F.col("n_a") >= least) & (F.col("n_b") >= least)
    spread = F.when(enough, F.sqrt(part("a") + part("b")))
    z = F.when(spread > 0, (F.col("s_b") / F.col("n_b") - F.col("s_a") / F.col("n_a")) / spread)
    bound = NormalDist().inv_cdf(1 - alpha / looks / 2)
    return sums.select("look", "n_a", "n_b", z.alias("z"), F.coalesce(F.abs(z) > bound, F.lit(False)).alias("stop"))


def temperature(df: DataFrame, logit: str, correct: str, low: float = 0.05, high: float = 20.0, steps: int = 40) -> float:
    """The temperature of least log loss, among steps on a log scale; all are scored in one pass."""
    tried = [low * (high / low) ** (i / (steps - 1)) for i in range(steps)]
    x, y = F.col(logit).cast("double"), F.col(correct).cast("double")
    # log(1 + exp(x)) without overflow
    loss = lambda t: F.greatest(x / t, F.lit(0.0)) - y * x / t + F.log1p(F.exp(-F.abs(x / t)))
    row = df.agg(*[F.avg(loss(t)).alias(f"l{i}") for i, t in enumerate(tried)]).first()
    return min(zip(row, tried))[1] if row[0] is not None else 1.0


def tempered(logit: Column, t: float) -> Column:
    return 1 / (1 + F.exp(-logit / t))


# Causal effects


def ipw(df: DataFrame, treated: str, outcome: str, propensity: str, low: float = 0.01, high: float = 0.99) -> DataFrame:
    """Average effect by normalised inverse propensity weights, propensities clipped."""
    e = F.greatest(F.lit(low), F.least(F.lit(high), F.col(propensity)))
    t = F.col(treated).cast("double")
    w1, w0 = t / e, (1 - t) / (1 - e)
    return df.agg((F.sum(w1 * F.col(outcome)) / F.sum(w1) - F.sum(w0 * F.col(outcome)) / F.sum(w0)).alias("ate"))


def propensities(df: DataFrame, treated: str, covariates: list[str]) -> DataFrame:
    """Adds propensity by logistic regression."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    v = VectorAssembler(inputCols=covariates, outputCol="_x").transform(df.withColumn("_t", F.col(treated).cast("double")))
    model = LogisticRegression(featuresCol="_x", labelCol="_t", predictionCol="_p", probabilityCol="_q", rawPredictionCol="_r").fit(v)
    return model.transform(v).withColumn("propensity", vector_to_array("_q")[1]).drop("_x", "_t", "_p", "_q", "_r")


def matched_effect(df: DataFrame, key: str, treated: str, outcome: str, score: str, caliper: float) -> DataFrame:
    """att, se, n over treated rows and their nearest controls within the caliper; 0, 0 without a match."""
    from .joins import nearest_control

    got = nearest_control(df.where(F.col(treated) == 1), df.where(F.col(treated) == 0), key, score, caliper)
    y = df.select(F.col(key).alias("k"), F.col(outcome).alias("y"))
    d = got.join(y.toDF("treated", "yt"), "treated").join(y.toDF("control", "yc"), "control").select((F.col("yt") - F.col("yc")).alias("d"))
    return d.agg(F.coalesce(F.avg("d"), F.lit(0.0)).alias("att"), F.coalesce(F.stddev_pop("d") / F.sqrt(F.count("*")), F.lit(0.0)).alias("se"), F.count("*").alias("n"))


def doubly_robust(df: DataFrame, treated: str, outcome: str, propensity: str, covariates: list[str]) -> DataFrame:
    """ate and se from outcome regressions per arm plus weighted residuals."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import LinearRegression

    v = VectorAssembler(inputCols=covariates, outputCol="_x").transform(df)
    for arm in (0, 1):
        model = LinearRegression(featuresCol="_x", labelCol=outcome, predictionCol=f"_m{arm}").fit(v.where(F.col(treated) == arm))
        v = model.transform(v)
    e = F.greatest(F.lit(0.01), F.least(F.lit(0.99), F.col(propensity)))
    t, y = F.col(treated), F.col(outcome)
    d = F.col("_m1") - F.col("_m0") + t * (y - F.col("_m1")) / e - (1 - t) * (y - F.col("_m0")) / (1 - e)
    return v.select(d.alias("d")).agg(F.avg("d").alias("ate"), (F.stddev_pop("d") / F.sqrt(F.count("*"))).alias("se"))


def bootstrap_interval(df: DataFrame, value: str, rounds: int = 200, level: float = 0.95, seed: int = 0) -> DataFrame:
    """(low, high) of the mean over Poisson(1) reweightings; one pass, rounds sums per row."""
    u = F.expr(f"(pmod(xxhash64({seed}, _id, r), 1000000) + 0.5) / 1000000.0")
    edges, total = [], 0.0
    for k in range(7):
        total += math.exp(-1) / math.factorial(k)
        edges.append(total)
    weight = reduce(lambda a, b: a + b, [F.when(F.col("u") > e, 1).otherwise(0) for e in edges])
    rows = df.select(F.monotonically_increasing_id().alias("_id"), F.col(value).alias("v"), F.explode(F.sequence(F.lit(1), F.lit(rounds))).alias("r")).withColumn("u", u).withColumn("w", weight)
    means = rows.groupBy("r").agg((F.sum(F.col("w") * F.col("v")) / F.sum("w")).alias("m"))
    return means.agg(F.percentile("m", (1 - level) / 2).alias("low"), F.percentile("m", (1 + level) / 2).alias("high"))


def ab_test(df: DataFrame, arm: str, value: str, a, b) -> DataFrame:
    """Welch t, mean difference b - a, and effect size over the pooled deviation."""
    g = df.where(F.col(arm).isin(a, b)).agg(*[f(F.when(F.col(arm) == x, F.col(value))).alias(f"{n}_{s}") for s, x in (("a", a), ("b", b)) for n, f in (("m", F.avg), ("v", F.var_samp), ("n", F.count))])
    d = F.col("m_b") - F.col("m_a")
    se = F.sqrt(F.col("v_a") / F.col("n_a") + F.col("v_b") / F.col("n_b"))
    return g.select(d.alias("difference"), (d / F.when(se > 0, se)).alias("t"), (d / F.sqrt((F.col("v_a") + F.col("v_b")) / 2)).alias("cohen_d"))


def sample_size(effect: float, alpha: float = 0.05, power: float = 0.8) -> int:
    """Per arm, two-sided."""
    from statistics import NormalDist

    z = NormalDist().inv_cdf
    return math.ceil(2 * ((z(1 - alpha / 2) + z(power)) / effect) ** 2)


# Bandits: state after all pulls, from counts


def thompson(df: DataFrame, arm: str, reward: Column) -> DataFrame:
    got = df.groupBy(arm).agg((1 + F.count_if(reward > 0)).alias("alpha"), (1 + F.count_if(~(reward > 0))).alias("beta"))
    return got.withColumn("mean", F.col("alpha") / (F.col("alpha") + F.col("beta")))


def ucb(df: DataFrame, arm: str, reward: Column, c: float = 2.0) -> DataFrame:
    got = df.groupBy(arm).agg(F.count("*").alias("pulls"), F.avg(reward).alias("mean"))
    t = got.agg(F.sum("pulls").alias("t"))
    return got.join(F.broadcast(t), how="cross").withColumn("score", F.col("mean") + c * F.sqrt(F.log("t") / F.col("pulls"))).drop("t")  # one row


def linucb(df: DataFrame, arm: str, features: str, reward: str, context: list[float], alpha: float = 1.0) -> DataFrame:
    """(arm, score): sums of outer products per arm on the cluster, the small inverse on the driver."""
    import numpy as np

    d = len(context)
    cells = [F.sum(F.col(features)[i] * F.col(features)[j]).alias(f"a_{i}_{j}") for i in range(d) for j in range(d)] + [F.sum(F.col(features)[i] * F.col(reward)).alias(f"b_{i}") for i in range(d)]
    x, rows = np.array(context), []
    for r in df.groupBy(arm).agg(*cells).collect():  # one row per arm
        a = np.eye(d) + np.array([[float(r[f"a_{i}_{j}"]) for j in range(d)] for i in range(d)])
        inv, b = np.linalg.inv(a), np.array([float(r[f"b_{i}"]) for i in range(d)])
        rows.append((r[arm], float(x @ inv @ b + alpha * math.sqrt(x @ inv @ x))))
    return df.sparkSession.createDataFrame(rows, df.select(arm).schema.add("score", "double"))


def exp3(df: DataFrame, run: str, order: str, arm: str, reward: str, arms: list, gamma: float = 0.1) -> DataFrame:
    """(run, weights) after each run's pulls in order, one by one as they stream by; pulls of other arms are an
    error, pulls without a reward change nothing."""
    from ..shared import streamed

    n, places = len(arms), {a: i for i, a in enumerate(arms)}

    def step(w: list[float] | None, pull: tuple) -> list[float]:
        w = w or [1.0] * n
        if pull[1] is None:
            return w
        i = places[pull[0]]
        p = (1 - gamma) * w[i] / sum(w) + gamma / n
        w[i] *= math.exp(gamma * pull[1] / p / n)
        return w

    rows = df.select(run, order, F.col(arm).alias("arm"), F.col(reward).cast("double").alias("reward"))
    return streamed(rows, run, [order, "arm", "reward"], ["arm", "reward"], step, lambda w: w, "weights array<double>")


def regret(df: DataFrame, run: str, order: str, reward: Column, optimal: float) -> DataFrame:
    w = Window.partitionBy(run).orderBy(order)
    return df.withColumn("regret", optimal * F.count("*").over(w) - F.sum(reward).over(w))


# Uncertainty


def entropy(p: Column) -> Column:
    return F.aggregate(F.filter(p, lambda x: x > 0), F.lit(0.0), lambda a, x: a - x * F.log(x))


def committee(rows: DataFrame, key: str, p: str, n: int) -> DataFrame:
    """Entropy of the mean prediction of a committee."""
    return rows.groupBy(key).agg(F.array(*[F.avg(F.col(p)[i]) for i in range(n)]).alias("mean")).select(key, entropy(F.col("mean")).alias("entropy"))


def core_set(pool: DataFrame, labelled: DataFrame, key: str, vector: str) -> DataFrame:
    """(query, distance): least Euclidean distance of pool rows to a bounded labelled set."""
    from .retrieval import nearest

    got = nearest(labelled, pool, key, vector, 1, metric="l2")
    return got.select("query", (1 / F.col("score") - 1).alias("distance"))


def calibration_error(df: DataFrame, confidence: str, correct: Column, bins: int = 10) -> DataFrame:
    """Expected calibration error over bins (lo, hi]."""
    b = df.where(F.col(confidence) > 0).groupBy(F.ceil(F.col(confidence) * bins).alias("b")).agg(F.count("*").alias("n"), F.avg(confidence).alias("c"), F.avg(correct.cast("double")).alias("a"))
    total = df.agg(F.count("*").alias("total"))
    return b.join(F.broadcast(total), how="cross").agg(F.sum(F.col("n") / F.col("total") * F.abs(F.col("a") - F.col("c"))).alias("ece"))  # one row


def conformal(df: DataFrame, residual: str, alpha: float) -> DataFrame:
    """Quantile of the absolute residuals at ceil((n+1)(1-alpha))/n; the largest if that exceeds 1."""
    got = df.select(F.abs(residual).alias("r")).groupBy().agg(F.count("*").alias("n"), F.max("r").alias("most"))
    n = got.first()["n"]  # one number
    q = min(1.0, math.ceil((n + 1) * (1 - alpha)) / n) if n else 1.0
    return df.agg(F.percentile(F.abs(residual), q).alias("width"))


def ensemble(rows: DataFrame, key: str, mean: str, variance: str) -> DataFrame:
    """Spread between members, mean inner variance, and both as one deviation."""
    got = rows.groupBy(key).agg(F.avg(mean).alias("mean"), F.var_pop(mean).alias("between"), F.avg(variance).alias("within"))
    return got.withColumn("deviation", F.sqrt(F.col("between") + F.col("within")))


def mahalanobis(df: DataFrame, key: str, vector: str, n: int, threshold: float) -> DataFrame:
    """Diagonal distance of each vector from the mean, over a threshold, at most 1."""
    stats = df.agg(*[F.avg(F.col(vector)[i]).alias(f"m{i}") for i in range(n)], *[F.var_pop(F.col(vector)[i]).alias(f"v{i}") for i in range(n)])
    m, v = F.array(*[F.col(f"m{i}") for i in range(n)]), F.array(*[F.col(f"v{i}") + 1e-8 for i in range(n)])
    one = stats.select(m.alias("_m"), v.alias("_v"))
    gap = F.zip_with(F.zip_with(vector, "_m", lambda x, y: x - y), "_v", lambda d, s: d * d / s)
    dist = F.sqrt(F.aggregate(gap, F.lit(0.0), lambda a, x: a + x))
    return df.join(F.broadcast(one), how="cross").select(key, F.least(dist / threshold, F.lit(1.0)).alias("ood"))  # one row


def pareto(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Rows no other row dominates (at least as good everywhere, better somewhere)."""
    a = df.select(key, *columns).distinct()
    b = a.select(F.col(key).alias("_k"), *[F.col(c).alias(f"_{c}") for c in columns])
    better = reduce(lambda x, y: x & y, [F.col(f"_{c}") >= F.col(c) for c in columns]) & reduce(lambda x, y: x | y, [F.col(f"_{c}") > F.col(c) for c in columns])
    # only the extremes of each first coordinate can dominate: far fewer rows meet
    lead = columns[0]
    few = b.groupBy(f"_{lead}").agg(*[F.max(f"_{c}").alias(f"_{c}") for c in columns[1:]]) if len(columns) == 2 else b
    return df.join(few, better, "left_anti")


def training_weight(kind: Column, rating: Column) -> Column:
    return F.when(kind == "RATING", rating / 5).when(kind == "CORRECTION", 1.5).when(kind == "PREFERENCE", 1.2).otherwise(1.0)


def quality_band(score: Column) -> Column:
    return F.when(score >= 0.9, "excellent").when(score >= 0.7, "good").when(score >= 0.5, "fair").otherwise("poor")
