"""Causal structure: interventions, counterfactuals, the PC skeleton; paired and sequential tests."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import causal as C
from ..operators import governance as V
from ..operators import retrieval as S
from .registry import query
from .retrieval_queries import MEASURE, measured

R = lambda c, n=6: F.round(c, n)
MODEL = {"l_extendedprice": ({"l_quantity": 900.0, "l_discount": -50.0}, 10.0), "l_tax": ({"l_extendedprice": 0.00001, "l_quantity": 0.001}, 0.02)}


@query("cau_do", """SELECT l_orderkey, l_linenumber, 12.0::DOUBLE AS do_l_quantity, round(10 + 900 * 12 - 50 * l_discount, 6) AS do_l_extendedprice, round(0.02 + 0.00001 * (10 + 900 * 12 - 50 * l_discount) + 0.001 * 12, 6) AS do_l_tax FROM lineitem""")
def cau_do(t):
    out = C.predict(t.lineitem, MODEL, {"l_quantity": 12.0})
    return out.select("l_orderkey", "l_linenumber", "do_l_quantity", R(F.col("do_l_extendedprice")).alias("do_l_extendedprice"), R(F.col("do_l_tax")).alias("do_l_tax"))


@query("cau_counterfactual", """SELECT l_orderkey, l_linenumber, round(l_extendedprice + 900 * (12 - l_quantity), 5) AS cf_l_extendedprice, round(l_tax + 0.00001 * 900 * (12 - l_quantity) + 0.001 * (12 - l_quantity), 5) AS cf_l_tax FROM lineitem""")
def cau_counterfactual(t):
    out = C.counterfactual(t.lineitem, MODEL, {"l_quantity": 12.0})
    return out.select("l_orderkey", "l_linenumber", R(F.col("cf_l_extendedprice"), 5).alias("cf_l_extendedprice"), R(F.col("cf_l_tax"), 5).alias("cf_l_tax"))


@query("cau_fitted", "SELECT round(regr_slope(l_extendedprice, l_quantity), 4) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 2) AS intercept FROM lineitem")
def cau_fitted(t):
    weights, intercept = C.fit(t.lineitem, {"l_extendedprice": ["l_quantity"]})["l_extendedprice"]
    return t.spark.createDataFrame([(round(weights["l_quantity"], 4), round(intercept, 2))], "slope double, intercept double")


@query("cau_structure", "SELECT * FROM (VALUES ('demand', 'total', '->'), ('rate', 'total', '->'), ('total', 'price', '->')) v(a, b, mark)")
def cau_structure(t):
    """Two independent causes of a total and an effect of it, each with its own noise, from the lines' own numbers."""
    noise = lambda i: F.pmod(F.xxhash64("l_orderkey", "l_linenumber", F.lit(i)), F.lit(1000)) / 50
    rows = t.lineitem.select(F.col("l_quantity").alias("demand"), noise(1).alias("rate"), noise(2).alias("e1"), noise(3).alias("e2"))
    rows = rows.withColumn("total", F.col("demand") + 2 * F.col("rate") + F.col("e1")).withColumn("price", F.col("total") + F.col("e2"))
    names = ["demand", "rate", "total", "price"]
    return t.spark.createDataFrame(C.oriented(names, C.skeleton(rows, names, critical=4.0)), "a string, b string, mark string")


@query("evl_wilcoxon", f"""WITH {MEASURE}, d AS (SELECT round(ap, 9) - round(ndcg, 9) AS d FROM m WHERE round(ap, 9) <> round(ndcg, 9)), s AS (SELECT round(d, 9) AS d FROM d),
  r AS (SELECT d, rank() OVER (ORDER BY abs(d)) + (count(*) OVER (PARTITION BY abs(d)) - 1) / 2 AS k FROM s) SELECT count(*) AS n, coalesce(sum(k) FILTER (d > 0), 0)::DOUBLE AS w_plus, coalesce(sum(k) FILTER (d < 0), 0)::DOUBLE AS w_minus FROM r""")
def evl_wilcoxon(t):
    m = measured(t).select(F.round(F.round("ap", 9) - F.round("ndcg", 9), 9).alias("d"), F.lit(0.0).alias("none"))
    return S.wilcoxon(m, "d", "none").select("n", "w_plus", "w_minus")


@query("ab_sequential", """WITH r AS (SELECT c_mktsegment AS arm, c_acctbal AS v, ((row_number() OVER (ORDER BY c_custkey) - 1) * 5) // count(*) OVER () + 1 AS look FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')),
  c AS (SELECT l AS look, count(*) FILTER (arm = 'BUILDING') AS n_a, count(*) FILTER (arm = 'MACHINERY') AS n_b, avg(v) FILTER (arm = 'MACHINERY') - avg(v) FILTER (arm = 'BUILDING') AS d,
    sqrt(var_samp(v) FILTER (arm = 'BUILDING') / count(*) FILTER (arm = 'BUILDING') + var_samp(v) FILTER (arm = 'MACHINERY') / count(*) FILTER (arm = 'MACHINERY')) AS s FROM r, (SELECT unnest(range(1, 6)) AS l) WHERE r.look <= l GROUP BY 1)
  SELECT look::INT AS look, n_a, n_b, CASE WHEN n_a >= 10 AND n_b >= 10 THEN round(d / s, 5) END AS z, coalesce(abs(d / s) > 2.5758293 AND n_a >= 10 AND n_b >= 10, false) AS stop FROM c""")
def ab_sequential(t):
    out = V.sequential_test(t.customer, "c_mktsegment", "c_acctbal", "c_custkey", "BUILDING", "MACHINERY", 5)
    return out.withColumn("z", R(F.col("z"), 5))
