"""Quality, drift, fairness, lineage, ledgers, effects, bandits, uncertainty; grouping extensions."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import governance as V
from ..operators import graph as G
from .registry import query

R = lambda c, n=6: F.round(c, n)


def judged(t):
    """Documents with a label, a prediction by length, and their language."""
    d = t.documents.join(t.labels, "doc_id")
    return d.select("doc_id", "lang", "quality", "toxic", (F.col("n_chars") > 1500).cast("int").alias("prediction"), "n_chars")


JUDGED = "j AS (SELECT doc_id, lang, quality, toxic, CASE WHEN n_chars > 1500 THEN 1 ELSE 0 END AS prediction, n_chars FROM documents JOIN labels USING (doc_id))"


def rounded(df, *keep, n=6):
    return df.select(*[F.col(c) if c in keep else R(F.col(c), n).alias(c) for c in df.columns])


@query("gov_completeness", "SELECT unnest(['lang', 'source']) AS feature, round(unnest([avg(CASE WHEN lang IS NULL OR lang = '' THEN 1 ELSE 0 END), avg(CASE WHEN source IS NULL OR source = '' THEN 1 ELSE 0 END)]), 6) AS missing, unnest([CASE WHEN avg(CASE WHEN lang IS NULL OR lang = '' THEN 1 ELSE 0 END) > 0.2 THEN 'high' WHEN avg(CASE WHEN lang IS NULL OR lang = '' THEN 1 ELSE 0 END) > 0.05 THEN 'medium' ELSE 'none' END, CASE WHEN avg(CASE WHEN source IS NULL OR source = '' THEN 1 ELSE 0 END) > 0.2 THEN 'high' WHEN avg(CASE WHEN source IS NULL OR source = '' THEN 1 ELSE 0 END) > 0.05 THEN 'medium' ELSE 'none' END]) AS severity FROM documents")
def gov_completeness(t):
    return rounded(V.completeness(t.documents, ["lang", "source"]), "feature", "severity")


@query("gov_outliers", "WITH q AS (SELECT quantile_cont(value, 0.25) AS a, quantile_cont(value, 0.75) AS b FROM events) SELECT round(avg(CASE WHEN value < a - 1.5 * (b - a) OR value > b + 1.5 * (b - a) THEN 1 ELSE 0 END), 6) AS outliers FROM events, q WHERE value IS NOT NULL")
def gov_outliers(t):
    return rounded(V.outlier_share(t.events, "value"))


@query("gov_valid_share", "SELECT round(avg(CASE WHEN l_quantity BETWEEN 1 AND 40 THEN 1 ELSE 0 END), 6) AS l_quantity, round(avg(CASE WHEN l_discount BETWEEN 0 AND 0.05 THEN 1 ELSE 0 END), 6) AS l_discount FROM lineitem")
def gov_valid(t):
    return rounded(V.valid_share(t.lineitem, {"l_quantity": (1, 40), "l_discount": (0, 0.05)}))


@query("gov_quality_report")
def gov_report(t):
    return rounded(V.quality_report(t.lineitem, ["l_quantity", "l_discount", "l_returnflag"], ["l_quantity", "l_discount"], {"l_quantity": (1, 40)}))


@query("gov_ks_drift", """WITH x AS (SELECT value AS v, CASE WHEN event_id % 2 = 0 THEN 1 ELSE 0 END AS a FROM events WHERE value IS NOT NULL), p AS (SELECT v, sum(a) AS a, sum(1 - a) AS b FROM x GROUP BY 1),
  r AS (SELECT sum(a) OVER (ORDER BY v) / (SELECT sum(a) FROM x) AS fa, sum(b) OVER (ORDER BY v) / (SELECT sum(1 - a) FROM x) AS fb FROM p) SELECT round(max(abs(fa - fb)), 6) AS statistic FROM r""")
def gov_ks(t):
    return rounded(V.ks_statistic(t.events.where("event_id % 2 = 0"), t.events.where("event_id % 2 = 1"), "value").select("statistic"))


@query("gov_chi_square", "WITH a AS (SELECT event_type, count(*) FILTER (event_id % 2 = 0) AS a, count(*) FILTER (event_id % 2 = 1) AS b FROM events GROUP BY 1), n AS (SELECT sum(a) AS na, sum(b) AS nb FROM a) SELECT round(sum(pow(b - a / na * nb, 2) / (a / na * nb)), 6) AS statistic, round(sum(pow(b - a / na * nb, 2) / (a / na * nb)) / max(nb), 8) AS score FROM a, n WHERE a > 0")
def gov_chi(t):
    out = V.chi_square(t.events.where("event_id % 2 = 0"), t.events.where("event_id % 2 = 1"), "event_type")
    return out.select(R(F.col("statistic")).alias("statistic"), R(F.col("score"), 8).alias("score"))


@query("gov_fairness", f"WITH {JUDGED}, r AS (SELECT lang, avg(prediction) AS p, avg(CASE WHEN quality = 1 THEN prediction END) AS t, avg(CASE WHEN quality = 0 THEN prediction END) AS f FROM j GROUP BY 1) SELECT round(1 - (max(p) - min(p)), 6) AS demographic_parity, round(1 - (max(t) - min(t)), 6) AS equal_opportunity, round(greatest(0, 1 - (max(t) - min(t) + max(f) - min(f)) / 2), 6) AS equalized_odds FROM r")
def gov_fairness(t):
    return rounded(V.fairness(judged(t), "lang", "prediction", "quality"))


@query("gov_group_rates", f"WITH {JUDGED} SELECT lang, count(*) AS n, round(avg(prediction), 6) AS positive, round(avg(CASE WHEN quality = 1 THEN prediction END), 6) AS tpr, round(avg(CASE WHEN quality = 0 THEN prediction END), 6) AS fpr FROM j GROUP BY 1")
def gov_rates(t):
    return rounded(V.rates(judged(t), "lang", "prediction", "quality"), "lang", "n")


@query("gov_disparate_impact", f"WITH {JUDGED} SELECT round(avg(CASE WHEN lang <> 'en' THEN prediction END) / avg(CASE WHEN lang = 'en' THEN prediction END), 6) AS disparate_impact FROM j")
def gov_impact(t):
    return rounded(V.disparate_impact(judged(t), F.col("lang") == "en", "prediction"))


@query("gov_trace", "WITH RECURSIVE r AS (SELECT o_orderkey AS a, unnest([o_orderkey // 2, o_orderkey // 3]) AS b FROM orders WHERE o_orderkey > 0), p AS (SELECT 444::BIGINT AS node, 0 AS hops UNION SELECT b, hops + 1 FROM p JOIN r ON a = node WHERE hops < 10) SELECT node, min(hops) AS hops FROM p GROUP BY 1")
def gov_trace(t):
    r = t.orders.where("o_orderkey > 0").selectExpr("o_orderkey AS output_id", "array(o_orderkey div 2, o_orderkey div 3) AS source_ids")
    return V.trace(r, 444, 10)


@query("gov_compare_versions", "SELECT coalesce(a.k, b.k) AS metric, coalesce(a.n, 0) AS before, coalesce(b.n, 0) AS after, coalesce(b.n, 0) - coalesce(a.n, 0) AS change FROM (SELECT event_type AS k, count(*) AS n FROM events WHERE value < 50 GROUP BY 1) a FULL JOIN (SELECT event_type AS k, count(*) AS n FROM events WHERE value >= 50 GROUP BY 1) b ON a.k = b.k")
def gov_compare(t):
    part = lambda c: t.events.where(c).groupBy(F.col("event_type").alias("metric")).agg(F.count("*").alias("n"))
    return V.compare_versions(part("value < 50"), part("value >= 50"), "metric", "n")


@query("gov_split")
def gov_split(t):
    return V.split(t.documents.select("doc_id"), "doc_id", {"train": 0.8, "valid": 0.1, "test": 0.1}).groupBy("split").agg(F.count("*").alias("n"))


@query("gov_hash_chain", """WITH RECURSIVE e AS (SELECT user_id, event_id, props AS body, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM events),
  c AS (SELECT user_id, event_id, i, repeat('0', 64) AS prev_hash, sha256(body || repeat('0', 64)) AS hash FROM e WHERE i = 1 UNION ALL SELECT e.user_id, e.event_id, e.i, c.hash, sha256(e.body || c.hash) FROM c JOIN e ON e.user_id = c.user_id AND e.i = c.i + 1)
  SELECT event_id, prev_hash, hash FROM c""")
def gov_chain(t):
    return V.chained(t.events.select("user_id", "event_id", "props"), "user_id", "event_id", "props").select("event_id", "prev_hash", "hash")


@query("gov_verify_chain", "SELECT event_id FROM events WHERE event_id % 97 = 0")
def gov_verify(t):
    """Entries changed after they were chained are found."""
    chain = V.chained(t.events.select("user_id", "event_id", "props"), "user_id", "event_id", "props")
    chain = chain.withColumn("props", F.when(F.col("event_id") % 97 == 0, F.concat("props", F.lit("!"))).otherwise(F.col("props")))
    return V.verify_chain(chain, "user_id", "event_id", "props").select("event_id")


@query("gov_merkle_root", """WITH RECURSIVE l AS (SELECT row_number() OVER (ORDER BY h) - 1 AS i, h, 0 AS lev FROM (SELECT sha256(CAST(c_custkey AS VARCHAR)) AS h FROM customer)),
  t AS (SELECT lev, list(h ORDER BY i) AS hs FROM l GROUP BY lev UNION ALL SELECT lev + 1, list_transform(range(1, (len(hs) + 1) // 2 + 1), lambda k: sha256(hs[2 * k - 1] || coalesce(hs[2 * k], hs[2 * k - 1]))) FROM t WHERE len(hs) > 1)
  SELECT hs[1] AS root FROM t WHERE len(hs) = 1""")
def gov_merkle(t):
    return V.merkle_root(t.customer.select(F.sha2(F.col("c_custkey").cast("string"), 256).alias("h")), "h")


def treated(t):
    return t.customer.select("c_custkey", (F.col("c_mktsegment") == "BUILDING").cast("int").alias("z"), F.col("c_acctbal").alias("y"), (F.lit(0.2) + F.col("c_nationkey") / 50).alias("e"), F.col("c_nationkey").cast("double").alias("x"))


@query("cau_ipw", "WITH d AS (SELECT CASE WHEN c_mktsegment = 'BUILDING' THEN 1.0 ELSE 0 END AS t, c_acctbal AS y, 0.2 + c_nationkey / 50 AS e FROM customer) SELECT round(sum(t / e * y) / sum(t / e) - sum((1 - t) / (1 - e) * y) / sum((1 - t) / (1 - e)), 4) AS ate FROM d")
def cau_ipw(t):
    return rounded(V.ipw(treated(t), "z", "y", "e"), n=4)


@query("cau_matched", """WITH p AS (SELECT x.c_acctbal AS y1, y.c_acctbal AS y0, row_number() OVER (PARTITION BY x.c_custkey ORDER BY abs(x.s - y.s), y.c_custkey) AS r FROM (SELECT *, (c_custkey * 37 % 1000) / 1000 AS s FROM customer WHERE c_mktsegment = 'BUILDING') x
  JOIN (SELECT *, (c_custkey * 37 % 1000) / 1000 AS s FROM customer WHERE c_mktsegment <> 'BUILDING') y ON abs(x.s - y.s) <= 0.05) SELECT round(avg(y1 - y0), 3) AS att, round(stddev_pop(y1 - y0) / sqrt(count(*)), 3) AS se, count(*) AS n FROM p WHERE r = 1""")
def cau_matched(t):
    d = treated(t).withColumn("s", (F.col("c_custkey") * 37 % 1000) / 1000)
    return rounded(V.matched_effect(d, "c_custkey", "z", "y", "s", 0.05), "n", n=3)


@query("cau_doubly_robust")
def cau_dr(t):
    d = V.propensities(treated(t), "z", ["x"])
    return rounded(V.doubly_robust(d, "z", "y", "propensity", ["x"]), n=4)


@query("cau_bootstrap")
def cau_bootstrap(t):
    return rounded(V.bootstrap_interval(t.customer, "c_acctbal", rounds=50), n=3)


@query("ab_test", "WITH g AS (SELECT avg(c_acctbal) FILTER (c_mktsegment = 'BUILDING') AS ma, avg(c_acctbal) FILTER (c_mktsegment = 'MACHINERY') AS mb, var_samp(c_acctbal) FILTER (c_mktsegment = 'BUILDING') AS va, var_samp(c_acctbal) FILTER (c_mktsegment = 'MACHINERY') AS vb, count(*) FILTER (c_mktsegment = 'BUILDING') AS na, count(*) FILTER (c_mktsegment = 'MACHINERY') AS nb FROM customer) SELECT round(mb - ma, 4) AS difference, round((mb - ma) / sqrt(va / na + vb / nb), 5) AS t, round((mb - ma) / sqrt((va + vb) / 2), 5) AS cohen_d FROM g")
def ab(t):
    out = V.ab_test(t.customer, "c_mktsegment", "c_acctbal", "BUILDING", "MACHINERY")
    return out.select(R(F.col("difference"), 4).alias("difference"), R(F.col("t"), 5).alias("t"), R(F.col("cohen_d"), 5).alias("cohen_d"))


@query("ban_thompson", "SELECT event_type, 1 + count(*) FILTER (value > 50) AS alpha, 1 + count(*) FILTER (NOT value > 50) AS beta, round((1 + count(*) FILTER (value > 50)) / (2 + count(*)), 6) AS mean FROM events GROUP BY 1")
def ban_thompson(t):
    return rounded(V.thompson(t.events, "event_type", F.when(F.col("value") > 50, 1).otherwise(0)), "event_type", "alpha", "beta")


@query("ban_ucb", "SELECT event_type, count(*) AS pulls, round(avg(value), 6) AS mean, round(avg(value) + 2 * sqrt(ln((SELECT count(*) FROM events)) / count(*)), 6) AS score FROM events GROUP BY 1")
def ban_ucb(t):
    return rounded(V.ucb(t.events, "event_type", F.col("value")), "event_type", "pulls")


@query("ban_linucb")
def ban_linucb(t):
    e = t.events.withColumn("x", F.array(F.lit(1.0), F.col("value") / 100))
    return rounded(V.linucb(e, "event_type", "x", "value", [1.0, 0.5]), "event_type", n=4)


@query("ban_exp3")
def ban_exp3(t):
    arms = sorted(r[0] for r in t.events.select("event_type").distinct().collect())
    e = t.events.withColumn("reward", F.col("value") / 100)
    return V.exp3(e, "user_id", "event_id", "event_type", "reward", arms)


@query("ban_regret", "SELECT event_id, round(0.8 * count(*) OVER w - sum(value / 100) OVER w, 4) AS regret FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)")
def ban_regret(t):
    return V.regret(t.events, "user_id", "event_id", F.col("value") / 100, 0.8).select("event_id", R(F.col("regret"), 4).alias("regret"))


@query("unc_entropy", "SELECT vec_id, round(list_sum(list_transform(list_filter([label / 20, 1 - label / 20], lambda x: x > 0), lambda x: -x * ln(x))), 6) AS entropy FROM embeddings")
def unc_entropy(t):
    return t.embeddings.select("vec_id", R(V.entropy(F.array(F.col("label") / 20, 1 - F.col("label") / 20))).alias("entropy"))


@query("unc_committee", "WITH m AS (SELECT user_id, avg(value / 200) AS p FROM events GROUP BY 1) SELECT user_id, round(CASE WHEN p > 0 THEN -p * ln(p) ELSE 0 END + CASE WHEN p < 1 THEN -(1 - p) * ln(1 - p) ELSE 0 END, 6) AS entropy FROM m WHERE p >= 0 AND p <= 1")
def unc_committee(t):
    e = t.events.withColumn("p", F.array(F.col("value") / 200, 1 - F.col("value") / 200))
    ok = t.events.groupBy("user_id").agg(F.avg(F.col("value") / 200).alias("m")).where("m >= 0 AND m <= 1").select("user_id")
    return rounded(V.committee(e, "user_id", "p", 2).join(ok, "user_id", "left_semi"), "user_id")


@query("unc_core_set", "SELECT a.vec_id AS query, round(min(list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[])), 4) AS distance FROM embeddings a, embeddings b WHERE a.vec_id % 50 <> 0 AND b.vec_id % 50 = 0 GROUP BY 1")
def unc_core(t):
    return rounded(V.core_set(t.embeddings.where("vec_id % 50 <> 0"), t.embeddings.where("vec_id % 50 = 0"), "vec_id", "embedding"), "query", n=4)


@query("unc_calibration", f"WITH {JUDGED}, x AS (SELECT least(1, n_chars / 4000) AS c, quality AS q FROM j WHERE n_chars > 0), b AS (SELECT ceil(c * 10) AS b, count(*) AS n, avg(c) AS c, avg(q) AS a FROM x GROUP BY 1) SELECT round(sum(n / (SELECT count(*) FROM x) * abs(a - c)), 6) AS ece FROM b")
def unc_calibration(t):
    d = judged(t).where("n_chars > 0").withColumn("c", F.least(F.lit(1.0), F.col("n_chars") / 4000))
    return rounded(V.calibration_error(d, "c", F.col("quality") == 1))


@query("unc_temperature", """WITH x AS (SELECT (l_quantity - 25) / 2 AS z, CASE WHEN l_quantity + (l_orderkey * 7 + l_linenumber * 13) % 40 > 45 THEN 1 ELSE 0 END AS y FROM lineitem),
  t AS (SELECT i, 0.05 * pow(400, i / 39) AS t FROM (SELECT unnest(range(40)) AS i)), l AS (SELECT t.t, avg(greatest(z / t.t, 0) - y * z / t.t + ln(1 + exp(-abs(z / t.t)))) AS loss FROM x, t GROUP BY 1) SELECT round(arg_min(t, loss), 6) AS temperature FROM l""")
def unc_temperature(t):
    """The temperature that fits overconfident scores of lines to what they claim."""
    y = F.when(F.col("l_quantity") + (F.col("l_orderkey") * 7 + F.col("l_linenumber") * 13) % 40 > 45, 1).otherwise(0)
    found = V.temperature(t.lineitem.select(((F.col("l_quantity") - 25) / 2).alias("z"), y.alias("y")), "z", "y")
    return t.spark.createDataFrame([(round(found, 6),)], "temperature double")


@query("unc_conformal", "WITH l AS (SELECT list_sort(list(abs(value - 50))) AS v, count(*) AS n FROM events WHERE value IS NOT NULL), q AS (SELECT v, ceil((n + 1) * 0.9) / n * (n - 1) AS p FROM l) SELECT round(v[CAST(floor(p) AS INT) + 1] + (v[CAST(floor(p) AS INT) + 2] - v[CAST(floor(p) AS INT) + 1]) * (p - floor(p)), 2) AS width FROM q")
def unc_conformal(t):
    return rounded(V.conformal(t.events.withColumn("r", F.col("value") - 50), "r", 0.1), n=2)


@query("unc_ensemble", "SELECT user_id, round(avg(value), 6) AS mean, round(var_pop(value), 4) AS between, round(avg(abs(value) / 10), 4) AS within, round(sqrt(var_pop(value) + avg(abs(value) / 10)), 4) AS deviation FROM events GROUP BY 1")
def unc_ensemble(t):
    out = V.ensemble(t.events.withColumn("v", F.abs("value") / 10), "user_id", "value", "v")
    return out.select("user_id", R(F.col("mean")).alias("mean"), *[R(F.col(c), 4).alias(c) for c in ("between", "within", "deviation")])


@query("unc_mahalanobis", "WITH s AS (SELECT avg(l_quantity) AS m0, avg(l_discount) AS m1, var_pop(l_quantity) + 1e-8 AS v0, var_pop(l_discount) + 1e-8 AS v1 FROM lineitem) SELECT l_orderkey * 10 + l_linenumber AS k, round(least(sqrt(pow(l_quantity - m0, 2) / v0 + pow(l_discount - m1, 2) / v1) / 3, 1), 5) AS ood FROM lineitem, s")
def unc_mahalanobis(t):
    d = t.lineitem.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("k"), F.array("l_quantity", "l_discount").alias("v"))
    return rounded(V.mahalanobis(d, "k", "v", 2, 3.0), "k", n=5)


@query("unc_pareto", "SELECT p_partkey FROM part a WHERE NOT EXISTS (SELECT 1 FROM part b WHERE b.p_size >= a.p_size AND b.p_retailprice >= a.p_retailprice AND (b.p_size > a.p_size OR b.p_retailprice > a.p_retailprice))")
def unc_pareto(t):
    return V.pareto(t.part, "p_partkey", ["p_size", "p_retailprice"]).select("p_partkey")


@query("gov_training_weight", "SELECT event_id, round(CASE event_type WHEN 'click' THEN value / 5 WHEN 'view' THEN 1.5 ELSE 1.0 END, 6)::DOUBLE AS weight, CASE WHEN value / 100 >= 0.9 THEN 'excellent' WHEN value / 100 >= 0.7 THEN 'good' WHEN value / 100 >= 0.5 THEN 'fair' ELSE 'poor' END AS band FROM events")
def gov_weight(t):
    kind = F.when(F.col("event_type") == "click", "RATING").when(F.col("event_type") == "view", "CORRECTION").otherwise("OTHER")
    return t.events.select("event_id", R(V.training_weight(kind, F.col("value"))).alias("weight"), V.quality_band(F.col("value") / 100).alias("band"))


# Grouping and window forms beyond the reference, which analysts of these tables use


@query("ext_rollup", "SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS quantity FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")
def ext_rollup(t):
    return t.lineitem.rollup("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), R(F.sum("l_quantity"), 2).alias("quantity"))


@query("ext_cube", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)")
def ext_cube(t):
    return t.orders.cube("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"))


@query("ext_sessions", "WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER w > INTERVAL 30 MINUTE OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS s FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), h AS (SELECT *, sum(s) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM g) SELECT user_id, k::BIGINT AS session, count(*) AS n FROM h GROUP BY 1, 2")
def ext_sessions(t):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    gap = F.col("ts") - F.lag("ts").over(w) > F.expr("INTERVAL 30 MINUTE")
    e = t.events.withColumn("s", F.when(F.coalesce(gap, F.lit(True)), 1).otherwise(0)).withColumn("session", F.sum("s").over(w))
    return e.groupBy("user_id", "session").agg(F.count("*").alias("n"))


@query("ext_as_of", "SELECT e.event_id, o.o_orderkey FROM (SELECT event_id, user_id, TIMESTAMP '1996-01-01' + INTERVAL (event_id % 700) DAY AS at FROM events) e ASOF LEFT JOIN (SELECT o_custkey, o_orderdate, max(o_orderkey) AS o_orderkey FROM orders GROUP BY 1, 2) o ON e.user_id = o.o_custkey AND e.at >= o.o_orderdate")
def ext_as_of(t):
    """Each event's latest order of the same user: one union, one window, no range join."""
    e = t.events.select(F.col("user_id").alias("k"), (F.to_timestamp(F.lit("1996-01-01")) + F.make_dt_interval(days=(F.col("event_id") % 700).cast("int"))).alias("at"), "event_id", F.lit(None).cast("bigint").alias("o"))
    o = t.orders.select(F.col("o_custkey").alias("k"), F.col("o_orderdate").cast("timestamp").alias("at"), F.lit(None).cast("bigint").alias("event_id"), F.col("o_orderkey").alias("o"))
    w = Window.partitionBy("k").orderBy("at", F.col("event_id").asc_nulls_first(), "o").rowsBetween(Window.unboundedPreceding, 0)
    return e.unionByName(o).withColumn("o_orderkey", F.last("o", ignorenulls=True).over(w)).where("event_id IS NOT NULL").select("event_id", "o_orderkey")
