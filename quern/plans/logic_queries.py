"""Rules, truth maintenance and intervals."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import logic as L
from .registry import query

R = lambda c, n=6: F.round(c, n)
EDGE = "e AS (SELECT s_suppkey + 10000 AS a, s_nationkey + 1000 AS b FROM supplier UNION ALL SELECT n_nationkey + 1000, n_regionkey + 100 FROM nation UNION ALL SELECT r_regionkey + 100, 1 FROM region)"


def edges(t):
    """The tree of suppliers, nations, regions and one root."""
    parts = (t.supplier, "s_suppkey + 10000L", "s_nationkey + 1000L"), (t.nation, "n_nationkey + 1000L", "n_regionkey + 100L"), (t.region, "r_regionkey + 100L", "1L")
    a, b, c = (f.selectExpr(f"{x} AS a", f"{y} AS b") for f, x, y in parts)
    return a.union(b).union(c)


PATH = [L.parse_rule("path(X, Y) :- edge(X, Y)"), L.parse_rule("path(X, Z) :- path(X, Y), edge(Y, Z)")]


@query("log_transitive_closure", f"WITH RECURSIVE {EDGE}, p AS (SELECT a, b FROM e UNION SELECT p.a, e.b FROM p JOIN e ON p.b = e.a) SELECT a AS a0, b AS a1 FROM p")
def log_closure(t):
    return L.infer({"edge": edges(t)}, PATH)["path"]


@query("log_prove", f'WITH RECURSIVE {EDGE}, p AS (SELECT a, b FROM e UNION SELECT p.a, e.b FROM p JOIN e ON p.b = e.a) SELECT b AS "Y" FROM p WHERE a = 10005')
def log_prove(t):
    return L.prove({"edge": edges(t)}, PATH, L.parse_atom("path(10005, Y)"))


@query("log_two_rules", f"WITH {EDGE}, s AS (SELECT DISTINCT x.a AS a0, y.a AS a1 FROM e x JOIN e y ON x.b = y.b) SELECT DISTINCT s.a0, e.b AS a1 FROM s JOIN e ON s.a1 = e.a")
def log_two(t):
    """Where peers lead, peers being children of one parent. They are told by their parents, as pairs of peers grow with the square of a nation's suppliers."""
    rules = [L.parse_rule("linked(Z, W) :- edge(Y, Z), edge(Y, W)"), L.parse_rule("reach(X, W) :- edge(X, Z), linked(Z, W)")]
    return L.infer({"edge": edges(t)}, rules)["reach"]


@query("log_derived_confidence", "SELECT l_orderkey AS fact, round(max(m), 6) AS confidence FROM (SELECT l_orderkey, l_linenumber % 2 AS j, min(s_acctbal / 10000) AS m FROM lineitem JOIN supplier ON s_suppkey = l_suppkey GROUP BY 1, 2) GROUP BY 1")
def log_confidence(t):
    j = t.lineitem.select(F.col("l_orderkey").alias("fact"), (F.col("l_linenumber") % 2).alias("justification"), F.col("l_suppkey").alias("antecedent"))
    beliefs = t.supplier.select(F.col("s_suppkey").alias("fact"), (F.col("s_acctbal") / 10000).alias("confidence"))
    return L.derived_confidence(j, beliefs).withColumn("confidence", R(F.col("confidence")))


@query("log_contradictions", "SELECT 'flag' AS predicate, CAST(l_orderkey AS VARCHAR) AS key, count(DISTINCT l_returnflag) AS n FROM lineitem GROUP BY 2 HAVING count(DISTINCT l_returnflag) > 1")
def log_contradictions(t):
    f = t.lineitem.select(F.lit("flag").alias("predicate"), F.array(F.col("l_orderkey").cast("string"), "l_returnflag").alias("args"))
    return L.contradictions(f)


@query("log_negated_pairs", "SELECT DISTINCT 'large' AS predicate, CAST(l_partkey AS VARCHAR) AS arg FROM lineitem WHERE l_quantity > 45 AND l_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity < 5)")
def log_negated(t):
    name = F.when(F.col("l_quantity") > 45, "large").when(F.col("l_quantity") < 5, "not_large")
    f = t.lineitem.select(name.alias("predicate"), F.array(F.col("l_partkey").cast("string")).alias("args")).where("predicate IS NOT NULL")
    return L.negated_pairs(f).where("predicate = 'large'").select("predicate", F.col("args")[0].alias("arg"))


@query("log_retract", f"WITH RECURSIVE {EDGE}, b AS (SELECT 102::BIGINT AS node, 0 AS hops UNION SELECT e.a, hops + 1 FROM b JOIN e ON e.b = b.node WHERE hops < 20) SELECT DISTINCT node FROM b")
def log_retract(t):
    return L.retract(edges(t).toDF("fact", "antecedent"), 102, 20).select("node")


@query("log_valid_at", "SELECT o_orderkey FROM orders LEFT JOIN (SELECT l_orderkey, max(l_shipdate) AS e FROM lineitem GROUP BY 1) ON o_orderkey = l_orderkey WHERE o_orderdate <= TIMESTAMP '1996-06-01' AND (e IS NULL OR TIMESTAMP '1996-06-01' <= e)")
def log_valid(t):
    e = t.lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.max("l_shipdate").alias("e"))
    return t.orders.join(e, "o_orderkey", "left").where(L.valid_at(F.col("o_orderdate"), F.col("e"), F.to_timestamp(F.lit("1996-06-01")))).select("o_orderkey")


ALLEN = """CASE WHEN x.e < y.s THEN 'BEFORE' WHEN y.e < x.s THEN 'AFTER' WHEN x.e = y.s THEN 'MEETS' WHEN y.e = x.s THEN 'MET_BY' WHEN x.s = y.s AND x.e = y.e THEN 'EQUALS' WHEN x.s = y.s AND x.e < y.e THEN 'STARTS' WHEN x.s = y.s THEN 'STARTED_BY'
 WHEN x.e = y.e AND x.s > y.s THEN 'FINISHES' WHEN x.e = y.e THEN 'FINISHED_BY' WHEN x.s > y.s AND x.e < y.e THEN 'DURING' WHEN x.s < y.s AND x.e > y.e THEN 'CONTAINS' WHEN x.s < y.s THEN 'OVERLAPS' ELSE 'OVERLAPPED_BY' END"""


@query("log_allen", f"WITH i AS (SELECT o_custkey AS c, o_orderkey AS k, floor(o_totalprice / 1000)::BIGINT AS s, floor(o_totalprice / 1000)::BIGINT + 1 + o_orderkey % 40 AS e FROM orders) SELECT x.c, x.k AS a, y.k AS b, {ALLEN} AS relation FROM i x JOIN i y ON x.c = y.c AND x.k < y.k")
def log_allen(t):
    i = t.orders.selectExpr("o_custkey AS c", "o_orderkey AS k", "floor(o_totalprice / 1000) AS s", "floor(o_totalprice / 1000) + 1 + o_orderkey % 40 AS e")
    return L.interval_pairs(i, "k", "c", "s", "e")


@query("log_noisy_or", "SELECT l_orderkey, round(1 - product(1 - l_discount), 9) AS p FROM lineitem GROUP BY 1")
def log_noisy(t):
    return L.noisy_or(t.lineitem, "l_orderkey", "l_discount").withColumn("p", R(F.col("p"), 9))


@query("log_confidence_interval", "SELECT vec_id, greatest(0, round(label / 10 - 0.025, 6)) AS low, least(1, round(label / 10 + 0.025, 6)) AS high FROM embeddings")
def log_interval(t):
    low, high = L.confidence_interval(F.col("label") / 10, 0.95)
    return t.embeddings.select("vec_id", R(low).alias("low"), R(high).alias("high"))


@query("log_resolve", "SELECT x.o_orderkey AS a, y.o_orderkey AS b, CASE WHEN x.o_totalprice / 300000 - y.o_totalprice / 300000 > 0.01 THEN 'a' WHEN y.o_totalprice / 300000 - x.o_totalprice / 300000 > 0.01 THEN 'b' WHEN x.o_orderdate > y.o_orderdate THEN 'a' WHEN y.o_orderdate > x.o_orderdate THEN 'b' ELSE 'unresolved' END AS winner FROM orders x JOIN orders y ON x.o_custkey = y.o_custkey AND x.o_orderkey < y.o_orderkey")
def log_resolve(t):
    o = t.orders.select("o_custkey", "o_orderkey", (F.col("o_totalprice") / 300000).alias("c"), "o_orderdate")
    x, y = o.toDF("o_custkey", "a", "ca", "da"), o.toDF("o_custkey", "b", "cb", "db")
    one = F.lit(1.0)
    return x.join(y, "o_custkey").where("a < b").select("a", "b", L.resolve(F.col("ca"), F.col("cb"), one, one, F.col("da"), F.col("db")).alias("winner"))


@query("log_applicable_rules", r"WITH f AS (SELECT item_id AS fact, list_distinct(string_split_regex(lower(text), '\s+')) AS w FROM benchmark), r AS (SELECT * FROM (VALUES ('r1', ['the', 'and', 'of']), ('r2', ['la', 'de'])) v(rule, terms)) SELECT rule, fact, round(len(list_intersect(terms, w)) / len(terms), 6) AS score FROM r, f WHERE len(list_intersect(terms, w)) > 0")
def log_applicable(t):
    rules = t.spark.createDataFrame([("r1", ["the", "and", "of"]), ("r2", ["la", "de"])], "rule string, terms array<string>")
    facts = t.benchmark.select(F.col("item_id").alias("fact"), "text")
    return L.applicable_rules(rules, facts, "terms", "text").withColumn("score", R(F.col("score")))
