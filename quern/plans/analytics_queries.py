"""Filters, joins, aggregates, windows over the order and event tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import aggregates as A
from ..operators import filters as P
from ..operators import joins as J
from ..operators import windows as W
from ..sources import readers, writers
from .registry import query

R = lambda c, n=6: F.round(c, n)


# Filters


@query("fil_metadata", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus IN ('F','O') AND o_orderpriority = '1-URGENT' AND o_totalprice >= 1000 AND o_totalprice < 200000")
def fil_metadata(t):
    return t.orders.where(P.metadata_condition({"o_orderstatus": ["F", "O"], "o_orderpriority": "1-URGENT", "o_totalprice": {"$gte": 1000, "$lt": 200000}, "o_custkey": None})).select("o_orderkey", "o_totalprice")


@query("fil_search_by_metadata", "SELECT p_partkey, p_brand, CAST(1 AS DOUBLE) AS score FROM part WHERE p_size = 10 ORDER BY p_partkey LIMIT 20")
def fil_search(t):
    return P.search_by_metadata(t.part.select("p_partkey", "p_brand", "p_size"), {"p_size": 10}, 20, "p_partkey").select("p_partkey", "p_brand", "score")


@query("fil_query_builder", "SELECT c_custkey, c_name, c_acctbal FROM customer WHERE c_nationkey = 3 AND c_mktsegment = 'BUILDING' AND contains(c_name, '1') ORDER BY c_acctbal DESC, c_custkey LIMIT 10 OFFSET 2")
def fil_builder(t):
    q = P.NodeQuery(t.customer).for_tenant("c_nationkey", 3).match("BUILDING", "c_mktsegment").where_contains("c_name", "1")
    return q.order_by("c_acctbal", descending=True).order_by("c_custkey").skip(2).limit(10).return_("c_custkey", "c_name", "c_acctbal").build()


@query(
    "fil_legal",
    """SELECT p_partkey FROM part WHERE NOT (p_size = 50) AND p_brand IN ('Brand#1','Brand#2','Brand#3') AND p_size <= 30
       AND (p_type IS NULL OR p_type IN (SELECT DISTINCT p_type FROM part ORDER BY 1 LIMIT 3)) AND p_retailprice / 2000 >= 0.3""",
)
def fil_legal(t):
    kinds = [r[0] for r in t.part.select("p_type").distinct().orderBy("p_type").limit(3).collect()]
    p = t.part.withColumns({"status": F.col("p_brand"), "repealed": F.col("p_size") == 50, "court_rank": F.col("p_size"), "authority": F.col("p_retailprice") / 2000, "domain": F.col("p_type")})
    return p.where(P.legal_condition(["Brand#1", "Brand#2", "Brand#3"], min_rank=30, min_authority=0.3, domains=kinds)).select("p_partkey")


@query("fil_optional", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority IN ('1-URGENT','2-HIGH')")
def fil_optional(t):
    o = t.orders.withColumn("tags", F.array("o_orderpriority"))
    return o.where(P.optional_filters({"o_orderstatus": "F", "o_custkey": None}, {"tags": ["1-URGENT", "2-HIGH"]})).select("o_orderkey")


@query("fil_active_documents", "SELECT p_partkey AS id FROM part WHERE p_size > 5 AND contains(p_name, 'a') AND p_brand IN ('Brand#1','Brand#2') AND p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 49)")
def fil_active(t):
    docs = t.part.select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("label"), (F.col("p_size") > 5).alias("active"), F.col("p_name").alias("content"))
    gone = t.lineitem.where("l_quantity > 49").select(F.col("l_partkey").alias("id"))
    return P.active_documents(docs, gone, ["Brand#1", "Brand#2"], "a").select("id")


@query(
    "fil_validity",
    """SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN 'repealed' WHEN o_custkey % 7 = 0 THEN 'superseded' WHEN o_custkey % 5 = 0 THEN 'repealed_by'
       WHEN o_orderdate < TIMESTAMP '1996-01-01' THEN 'expired' ELSE 'valid' END AS reason FROM orders""",
)
def fil_validity(t):
    by = lambda n: F.when(F.col("o_custkey") % n == 0, F.col("o_custkey"))
    _, reason = P.validity(F.col("o_orderstatus") == "P", by(7), by(5), F.col("o_orderdate"), F.to_timestamp(F.lit("1996-01-01")))
    return t.orders.select("o_orderkey", reason.alias("reason"))


@query("fil_not_superseded", "SELECT n_nationkey, r_regionkey AS new, r_regionkey IS NULL AS valid FROM nation LEFT JOIN region ON n_nationkey = r_regionkey")
def fil_superseded(t):
    edges = t.region.select(F.col("r_regionkey").alias("old"), F.col("r_regionkey").alias("new"))
    return P.not_superseded(t.nation.select("n_nationkey"), edges, "n_nationkey").select("n_nationkey", "new", "valid")


@query("fil_time_range", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderdate BETWEEN TIMESTAMP '1995-01-01' AND TIMESTAMP '1996-12-31' ORDER BY o_orderdate DESC, o_orderkey LIMIT 50")
def fil_range(t):
    at = lambda s: F.to_timestamp(F.lit(s))
    return P.time_range(t.orders, "o_orderdate", at("1995-01-01"), at("1996-12-31"), 50, "o_orderkey").select("o_orderkey", "o_totalprice")


@query("fil_path_confidence", "SELECT l_orderkey, l_linenumber, round(pow(0.9, l_linenumber) * (1 - l_discount), 6) AS path_confidence FROM lineitem WHERE pow(0.9, l_linenumber) * (1 - l_discount) >= 0.6")
def fil_path(t):
    out = P.by_path_confidence(t.lineitem.withColumn("conf", 1 - F.col("l_discount")), "l_linenumber", "conf", 0.6)
    return out.select("l_orderkey", "l_linenumber", R(F.col("path_confidence"), 6).alias("path_confidence"))


@query("fil_feedback", "SELECT event_id FROM events WHERE NOT (event_type = 'click' AND value IS NOT NULL AND value < 5)")
def fil_feedback(t):
    e = t.events.select("event_id", "ts", F.when(F.col("event_type") == "click", "RATING").otherwise("OTHER").alias("kind"), F.col("value").alias("rating"))
    span = e.agg(F.min("ts").alias("a"), F.max("ts").alias("b")).first()
    return P.feedback(e, F.lit(span["a"]), F.lit(span["b"]), 5).select("event_id")


@query("fil_all_tags", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O' AND o_orderpriority = '5-LOW'")
def fil_tags(t):
    return P.with_all_tags(t.orders.withColumn("tags", F.array("o_orderstatus", "o_orderpriority")), "tags", ["O", "5-LOW"]).select("o_orderkey")


@query("fil_entities", "SELECT p_partkey FROM part WHERE length(trim(p_name)) >= 2 AND p_retailprice >= 905 AND p_brand IN ('Brand#4','Brand#5')")
def fil_entities(t):
    return t.part.where(P.entity_ok(F.col("p_name"), F.col("p_retailprice"), F.col("p_brand"), 905, ["Brand#4", "Brand#5"])).select("p_partkey")


@query(
    "fil_document_quality",
    r"""SELECT doc_id, CASE WHEN length(text) < 50 THEN 'too_short' WHEN length(text) > 1000000 THEN 'too_long'
        WHEN len(list_filter(string_split_regex(trim(text), '\s+'), lambda x: x <> '')) < 10 THEN 'too_few_words'
        WHEN NOT regexp_matches(substr(text, 1, 1000), '[éèêçßüöäñóí]') THEN 'wrong_script' END AS problem FROM documents""",
)
def fil_quality(t):
    return t.documents.select("doc_id", P.document_problem(F.col("text"), "[éèêçßüöäñóí]").alias("problem"))


@query("fil_content_problems", r"""SELECT doc_id, array_to_string(list_filter([CASE WHEN trim(text) = '' THEN 'blank' END, CASE WHEN length(text) < 300 THEN 'short' END, CASE WHEN length(text) > 5000 THEN 'long' END,
   CASE WHEN length(text) > 0 AND (length(text) - length(regexp_replace(text, '[a-z]', '', 'g'))) / length(text) < 0.6 THEN 'script_share' END], lambda x: x IS NOT NULL), ',') AS problems FROM documents WHERE text IS NOT NULL""")
def fil_content(t):
    return t.documents.where("text IS NOT NULL").select("doc_id", F.array_join(P.content_problems(F.col("text"), 300, 5000, "[a-z]", 0.6), ",").alias("problems"))


@query("fil_quality_score", "SELECT doc_id, round(greatest(0, least(1, 1 - 0.1 * (CASE WHEN lang IS NULL THEN 1 ELSE 0 END) - CASE WHEN n_chars = 0 THEN 0.5 WHEN n_chars < 10 THEN 0.2 ELSE 0 END)), 6)::DOUBLE AS score FROM documents")
def fil_score(t):
    return t.documents.select("doc_id", R(P.quality_score(F.col("lang").isNull().cast("int"), F.col("n_chars"))).alias("score"))


@query("fil_schema_problems", "SELECT event_id, CASE WHEN value IS NULL THEN 'missing:value' ELSE '' END AS problems FROM events")
def fil_schema(t):
    return t.events.select("event_id", F.array_join(P.schema_problems(["event_type", "value"], {"user_id": "bigint"}), ",").alias("problems"))


@query("fil_qa", "SELECT conv_id, turn FROM conversations WHERE length(trim(role)) >= 4 AND length(trim(text)) >= 10 AND role IS NOT NULL AND role <> ''")
def fil_qa(t):
    c = t.conversations
    return c.where((F.length(F.trim("role")) >= 4) & P.qa_ok(F.concat(F.lit("ask: "), F.col("text")), F.col("text"), F.col("role"))).select("conv_id", "turn")


@query("fil_row_policy", "SELECT o_orderkey FROM orders WHERE o_custkey = 7")
def fil_policy(t):
    roles = t.nation.select(F.lit(7).alias("user"), F.col("n_name").alias("role"))
    return P.visible_rows(t.orders, "o_custkey", 7, roles, ["admin", "analyst"]).select("o_orderkey")


@query("fil_orphans", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')")
def fil_orphans(t):
    edges = t.orders.where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("src"), F.lit(-1).cast("bigint").alias("dst"))
    return P.orphans(t.customer, edges, "c_custkey").select("c_custkey")


@query("fil_integrity", """SELECT o_orderkey, concat_ws(',', CASE WHEN trim(o_orderpriority) = '' OR o_orderpriority IS NULL THEN 'missing:o_orderpriority' END, CASE WHEN o_orderdate > TIMESTAMP '1997-06-01' THEN 'future:o_orderdate' END) AS problems
    FROM (SELECT o_orderkey, o_orderdate, CASE WHEN o_orderkey % 17 <> 0 THEN o_orderpriority END AS o_orderpriority FROM orders)""")
def fil_integrity(t):
    """Orders that lack their priority (every seventeenth is taken away) or have a date after now."""
    rows = t.orders.withColumn("o_orderpriority", F.when(F.col("o_orderkey") % 17 != 0, F.col("o_orderpriority")))
    found = P.integrity_problems(["o_orderpriority"], ["o_orderdate"], F.to_timestamp(F.lit("1997-06-01")))
    return rows.select("o_orderkey", F.array_join(found, ",").alias("problems"))


@query("fil_sensitive", r"""SELECT doc_id, (len(regexp_extract_all(text, '\b[0-9]{10}\b')) + len(regexp_extract_all(text, '\b[0-9]{16}\b')) + len(regexp_extract_all(text, '\b[0-9]{3}-?[0-9]{2}-?[0-9]{4}\b'))
    + len(regexp_extract_all(text, '\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b')))::INT AS n FROM documents WHERE text IS NOT NULL""")
def fil_sensitive(t):
    return t.documents.where("text IS NOT NULL").select("doc_id", P.sensitive_items(F.col("text")).alias("n"))


@query("fil_structure", r"""SELECT doc_id, len(regexp_extract_all(text, '[A-Z][a-z]+[.]'))::INT AS articles, len(regexp_extract_all(text, '[0-9]{4,}'))::INT AS clauses,
    concat_ws(',', CASE WHEN NOT regexp_matches(text, '[A-Z][a-z]+[.]') THEN 'no_articles' END, CASE WHEN NOT regexp_matches(text, '[0-9]{4,}') THEN 'no_clauses' END) AS warnings FROM documents WHERE text IS NOT NULL""")
def fil_structure(t):
    """The validator of a legal text's parts, with marks that these tables have."""
    found = P.legal_structure(F.col("text"), {"articles": "[A-Z][a-z]+[.]", "clauses": "[0-9]{4,}"})
    return t.documents.where("text IS NOT NULL").select("doc_id", found["articles"].alias("articles"), found["clauses"].alias("clauses"), F.array_join(found["warnings"], ",").alias("warnings"))


@query("fil_substring", "SELECT p_partkey, CAST(1 AS DOUBLE) AS score FROM part WHERE contains(p_name, '12') OR contains(p_brand, '12')")
def fil_sub(t):
    return P.contains_any(t.part, "12", "p_name", "p_brand").select("p_partkey", "score")


# Sources and sinks as frame operations


@query("src_normalize_documents", r"SELECT CAST(doc_id AS VARCHAR) AS id, source || chr(10) || chr(10) || text AS text FROM documents WHERE text IS NOT NULL AND source <> ''")
def src_normalize(t):
    return readers.normalize_documents(t.documents.where("text IS NOT NULL AND source <> ''").withColumn("title", F.col("source")))


@query("src_unprocessed", "SELECT o_orderkey FROM orders WHERE o_orderkey % 3 <> 0 AND NOT (o_orderkey % 5 = 0 AND o_orderstatus = 'F')")
def src_unprocessed(t):
    f = t.orders.select("o_orderkey", F.col("o_orderkey").cast("string").alias("path"), (F.col("o_orderkey") * 10).alias("hash"), F.col("o_orderdate").alias("modified"))
    old = f.where("o_orderkey % 3 = 0").select("path", "hash", "modified")
    same = t.orders.where("o_orderkey % 5 = 0 AND o_orderstatus = 'F'").select(F.col("o_orderkey").cast("string").alias("path"), F.lit(-1).cast("bigint").alias("hash"), F.col("o_orderdate").alias("modified"))
    return readers.unprocessed(f, old.unionByName(same)).select("o_orderkey")


@query("src_first_per_hash", "SELECT md5(coalesce(text, '')) AS hash, min(doc_id) AS path FROM documents GROUP BY 1")
def src_first(t):
    return readers.first_per_hash(t.documents.select(F.md5(F.coalesce("text", F.lit(""))).alias("hash"), F.col("doc_id").alias("path")))


@query("snk_upsert", "SELECT c_custkey, CASE WHEN c_custkey % 10 = 0 THEN 0.0 ELSE c_acctbal END AS c_acctbal FROM customer")
def snk_upsert(t):
    old = t.customer.select("c_custkey", "c_acctbal")
    return J.upsert(old, old.where("c_custkey % 10 = 0").withColumn("c_acctbal", F.lit(0.0)), ["c_custkey"], F.col("c_acctbal"))


@query("snk_delete", "SELECT vec_id FROM embeddings WHERE label <> 0")
def snk_delete(t):
    return writers.without(t.embeddings, t.embeddings.where("label = 0"), "vec_id").select("vec_id")


@query("snk_checked_vectors", "SELECT vec_id FROM embeddings WHERE len(embedding) = (SELECT max(len(embedding)) FROM embeddings)")
def snk_checked(t):
    n = t.embeddings.agg(F.max(F.size("embedding"))).first()[0]
    return writers.checked_vectors(t.embeddings, "embedding", n).select("vec_id")


@query("snk_retention", "SELECT o_orderkey FROM orders WHERE o_orderdate >= TIMESTAMP '1998-01-01' - INTERVAL 90 DAY OR o_orderstatus = 'P'")
def snk_retention(t):
    return writers.retained(t.orders, "o_orderdate", F.to_timestamp(F.lit("1998-01-01")), 90, F.col("o_orderstatus") == "P").select("o_orderkey")


@query("snk_prometheus", "SELECT 'events_total{type=\"' || event_type || '\"} ' || count(*) AS line FROM events GROUP BY event_type")
def snk_prometheus(t):
    g = t.events.groupBy("event_type").agg(F.count("*").alias("n")).withColumns({"name": F.lit("events_total"), "labels": F.create_map(F.lit("type"), F.col("event_type"))})
    return writers.prometheus(g, "name", "labels", "n")


@query("snk_flatten_nested", "SELECT DISTINCT CAST(l_orderkey AS VARCHAR) AS src, CAST(l_partkey AS VARCHAR) AS dst, 'HAS' AS type FROM lineitem")
def snk_flatten(t):
    rows = t.lineitem.groupBy("l_orderkey").agg(F.collect_set("l_partkey").alias("parts"))
    return writers.flatten_nested(rows, "l_orderkey", {"parts": "HAS"})[1]


# Joins


@query(
    "join_citation_network",
    """SELECT p_brand, n_name, count(DISTINCT l_orderkey) AS n_orders, count(CASE WHEN l_returnflag = 'R' THEN 1 END) AS n_returned, round(avg(l_quantity), 6) AS mean_quantity,
       max(l_extendedprice) AS top_price FROM part JOIN lineitem ON p_partkey = l_partkey LEFT JOIN supplier ON s_suppkey = l_suppkey LEFT JOIN nation ON n_nationkey = s_nationkey GROUP BY 1, 2""",
)
def join_network(t):
    j = t.part.join(t.lineitem, F.col("p_partkey") == F.col("l_partkey")).join(t.supplier, F.col("s_suppkey") == F.col("l_suppkey"), "left").join(t.nation, F.col("n_nationkey") == F.col("s_nationkey"), "left")
    return j.groupBy("p_brand", "n_name").agg(F.count_distinct("l_orderkey").alias("n_orders"), F.count_if(F.col("l_returnflag") == "R").alias("n_returned"), R(F.avg("l_quantity")).alias("mean_quantity"), F.max("l_extendedprice").alias("top_price"))


@query("join_searchable", "SELECT o_orderkey, coalesce(array_to_string(list_sort(list(DISTINCT l_returnflag)), ','), '') AS flags FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1")
def join_searchable(t):
    flags = t.lineitem.groupBy("l_orderkey").agg(F.array_join(F.array_sort(F.collect_set("l_returnflag")), ",").alias("flags"))
    return t.orders.join(flags, F.col("o_orderkey") == F.col("l_orderkey"), "left").select("o_orderkey", F.coalesce("flags", F.lit("")).alias("flags"))


@query(
    "join_job_statistics",
    """SELECT c_custkey, coalesce(n_items, 0) AS n_items, coalesce(n_done, 0) AS n_done, coalesce(n_deliveries, 0) AS n_deliveries, coalesce(n_delivered, 0) AS n_delivered,
       CASE WHEN coalesce(n_items, 0) > 0 THEN round(100.0 * n_done / n_items, 2)::DOUBLE ELSE 0 END AS percent FROM customer
       LEFT JOIN (SELECT o_custkey AS k, count(*) AS n_items, count(*) FILTER (o_orderstatus = 'F') AS n_done FROM orders GROUP BY 1) a ON a.k = c_custkey
       LEFT JOIN (SELECT o_custkey AS k, count(*) AS n_deliveries, count(*) FILTER (l_linestatus = 'F') AS n_delivered FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY 1) b ON b.k = c_custkey""",
)
def join_jobs(t):
    items = t.orders.select(F.col("o_custkey").alias("c_custkey"), "o_orderstatus")
    sent = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("o_custkey").alias("c_custkey"), "l_linestatus")
    return J.job_statistics(t.customer.select("c_custkey"), items, sent, "c_custkey", F.col("o_orderstatus") == "F", F.col("l_linestatus") == "F")


@query("join_hierarchy", "SELECT o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN 1 WHEN '2-HIGH' THEN 2 ELSE 3 END AS place FROM orders ORDER BY place, o_orderkey LIMIT 100")
def join_hierarchy(t):
    return J.by_hierarchy(t.orders, "o_orderpriority", ["1-URGENT", "2-HIGH"], "o_orderkey", 100).select("o_orderkey", "place")


@query(
    "join_related",
    """WITH s AS (SELECT DISTINCT l_suppkey FROM lineitem WHERE l_orderkey = 1), p AS (SELECT DISTINCT l_partkey FROM lineitem WHERE l_orderkey = 1),
       u AS (SELECT DISTINCT l_orderkey AS item, 'supplier' AS source, 1.0 AS w FROM lineitem WHERE l_suppkey IN (FROM s) AND l_orderkey <> 1
             UNION ALL SELECT DISTINCT l_orderkey, 'part', 3.0 FROM lineitem WHERE l_partkey IN (FROM p) AND l_orderkey <> 1)
       SELECT item, sum(w)::DOUBLE AS score, string_agg(source, ',' ORDER BY source) AS sources FROM u GROUP BY item ORDER BY score DESC, item LIMIT 50""",
)
def join_related(t):
    part = t.lineitem.select(F.col("l_orderkey").alias("item"), F.col("l_partkey").alias("key"))
    supp = t.lineitem.select(F.col("l_orderkey").alias("item"), F.col("l_suppkey").alias("key"))
    return J.related_by_shared_keys([("part", 3.0, part), ("supplier", 1.0, supp)], "item", "key", 1, 50)


@query(
    "join_entity_overlap",
    """WITH o AS (SELECT DISTINCT l_partkey FROM lineitem WHERE l_orderkey = 1) SELECT l_orderkey AS item, count(DISTINCT l_partkey) AS shared, round(count(DISTINCT l_partkey) / (SELECT count(*) FROM o), 6) AS score
       FROM lineitem WHERE l_orderkey <> 1 AND l_partkey IN (FROM o) GROUP BY 1 HAVING count(DISTINCT l_partkey) / (SELECT count(*) FROM o) > 0.01""",
)
def join_overlap(t):
    f = t.lineitem.select(F.col("l_orderkey").alias("item"), F.col("l_partkey").alias("key"))
    return J.overlap_share(f, "item", "key", 1, 0.01).withColumn("score", R(F.col("score"), 6))


@query(
    "join_co_occurrence",
    """WITH d AS (SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem) SELECT x.l_suppkey AS a, y.l_suppkey AS b, count(*) AS n, round(count(*) / (SELECT count(DISTINCT l_orderkey) FROM lineitem), 8) AS confidence
       FROM d x JOIN d y ON x.l_orderkey = y.l_orderkey AND x.l_suppkey < y.l_suppkey GROUP BY 1, 2 HAVING count(*) >= 3""",
)
def join_co(t):
    return J.co_occurrence(t.lineitem, "l_orderkey", "l_suppkey", 3).withColumn("confidence", R(F.col("confidence"), 8))


@query("join_duplicates", "SELECT DISTINCT x.s_suppkey AS a, y.s_suppkey AS b FROM supplier x JOIN supplier y ON x.s_nationkey = y.s_nationkey AND x.s_suppkey < y.s_suppkey AND floor(x.s_acctbal / 100) = floor(y.s_acctbal / 100)")
def join_duplicates(t):
    s = t.supplier.withColumn("band", F.floor(F.col("s_acctbal") / 100))
    return J.duplicate_entities(s, "s_suppkey", "s_nationkey", "band", "s_name")


@query(
    "join_conflicts",
    """SELECT DISTINCT x.o_orderkey AS a, y.o_orderkey AS b, CASE WHEN x.o_orderdate > y.o_orderdate THEN x.o_orderkey WHEN y.o_orderdate > x.o_orderdate THEN y.o_orderkey END AS prevails,
       CASE WHEN x.o_orderdate = y.o_orderdate THEN 'same_date' ELSE 'newer' END AS reason FROM orders x JOIN orders y ON x.o_custkey = y.o_custkey AND x.o_orderkey < y.o_orderkey""",
)
def join_conflicts(t):
    return J.newer_of_conflicts(t.orders, "o_orderkey", "o_orderdate", "o_custkey")


@query("join_network_degrees", "SELECT coalesce(a.n, b.n) AS node, coalesce(n_out, 0) AS n_out, coalesce(n_in, 0) AS n_in FROM (SELECT l_suppkey AS n, count(DISTINCT l_partkey) AS n_out FROM lineitem GROUP BY 1) a FULL JOIN (SELECT l_partkey AS n, count(DISTINCT l_suppkey) AS n_in FROM lineitem GROUP BY 1) b ON a.n = b.n")
def join_degrees(t):
    return J.citation_network(t.lineitem.select(F.col("l_suppkey").alias("src"), F.col("l_partkey").alias("dst")))


@query("join_authority", "SELECT o_custkey, count(*) AS n, round(sum(CASE o_orderpriority WHEN '1-URGENT' THEN 1.0 WHEN '2-HIGH' THEN 0.7 WHEN '3-MEDIUM' THEN 0.4 ELSE 0 END)::DOUBLE / count(*), 6) AS authority FROM orders GROUP BY 1")
def join_authority(t):
    return J.authority(t.orders, "o_custkey", "o_orderpriority", {"1-URGENT": 1.0, "2-HIGH": 0.7, "3-MEDIUM": 0.4}).withColumn("authority", R(F.col("authority"), 6))


@query(
    "join_anchor_expand",
    """WITH a AS (SELECT s_suppkey AS id, s_acctbal / 10000 AS score FROM supplier WHERE s_acctbal / 10000 > 0.7), n AS (SELECT DISTINCT l_partkey AS id, 0.9 * score AS score FROM a JOIN lineitem ON id = l_suppkey)
       SELECT id, round(max(score), 6) AS score FROM (FROM a UNION ALL FROM n) GROUP BY id""",
)
def join_anchor(t):
    hits = t.supplier.select("s_suppkey", (F.col("s_acctbal") / 10000).alias("score"))
    edges = t.lineitem.select(F.col("l_suppkey").alias("src"), F.col("l_partkey").alias("dst")).distinct()
    return J.anchor_and_expand(hits, edges, "s_suppkey", "score", 0.7).withColumn("score", R(F.col("score"), 6))


@query(
    "join_nearest_control",
    """SELECT treated, control, round(gap, 6) AS gap FROM (SELECT x.c_custkey AS treated, y.c_custkey AS control, abs(x.c_acctbal - y.c_acctbal) AS gap,
       row_number() OVER (PARTITION BY x.c_custkey ORDER BY abs(x.c_acctbal - y.c_acctbal), y.c_custkey) AS r FROM customer x JOIN customer y ON abs(x.c_acctbal - y.c_acctbal) <= 20
       WHERE x.c_mktsegment = 'BUILDING' AND y.c_mktsegment <> 'BUILDING') WHERE r = 1""",
)
def join_control(t):
    c = t.customer
    out = J.nearest_control(c.where("c_mktsegment = 'BUILDING'"), c.where("c_mktsegment <> 'BUILDING'"), "c_custkey", "c_acctbal", 20.0)
    return out.withColumn("gap", R(F.col("gap"), 6))


@query("join_induced", "SELECT DISTINCT l_orderkey AS src, l_partkey AS dst FROM lineitem WHERE l_orderkey IN (SELECT p_partkey FROM part WHERE p_size > 25) AND l_partkey IN (SELECT p_partkey FROM part WHERE p_size > 25)")
def join_induced(t):
    e = t.lineitem.select(F.col("l_orderkey").alias("src"), F.col("l_partkey").alias("dst")).distinct()
    return J.induced(e, t.part.where("p_size > 25"), "p_partkey").select("src", "dst")


# Aggregates


@query("agg_law_statistics", "SELECT o_orderpriority, o_orderstatus, count(*) AS n, count(*) FILTER (o_orderdate >= TIMESTAMP '1997-01-01') AS n_recent, round(avg(year(o_orderdate)), 6) AS mean_year, CAST(min(o_orderdate) AS DATE) AS first_date, CAST(max(o_orderdate) AS DATE) AS last_date FROM orders GROUP BY 1, 2")
def agg_law(t):
    return t.orders.groupBy("o_orderpriority", "o_orderstatus").agg(
        F.count("*").alias("n"), F.count_if(F.col("o_orderdate") >= F.to_timestamp(F.lit("1997-01-01"))).alias("n_recent"), R(F.avg(F.year("o_orderdate"))).alias("mean_year"), F.min("o_orderdate").cast("date").alias("first_date"), F.max("o_orderdate").cast("date").alias("last_date")
    )


@query("agg_popular", "SELECT user_id, count(*) AS n, round(avg(CASE WHEN value > 0 THEN value END), 6) AS mean_value, max(value) AS max_value FROM events WHERE event_type <> 'view' GROUP BY 1 HAVING count(*) >= 5 ORDER BY n DESC, user_id LIMIT 100")
def agg_popular(t):
    return A.popular(t.events, "user_id", "value", F.col("event_type") != "view", 5, 100).withColumn("mean_value", R(F.col("mean_value")))


@query(
    "agg_hourly",
    """SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H') AS hour, count(*) AS n, round(avg(value), 6) AS mean, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, round(quantile_cont(value, 0.99), 6) AS p99,
       round(max(value), 6) AS max, count(*) FILTER (event_type <> 'error') AS n_ok, count(*) FILTER (event_type = 'error') AS n_failed, round(100.0 * count(*) FILTER (event_type <> 'error') / count(*), 2)::DOUBLE AS ok_percent FROM events GROUP BY 1""",
)
def agg_hourly(t):
    out = A.hourly_performance(t.events, "ts", "value", F.col("event_type") != "error")
    return out.select(F.date_format("hour", "yyyy-MM-dd HH").alias("hour"), "n", *[R(F.col(c)).alias(c) for c in ("mean", "p50", "p95", "p99", "max")], "n_ok", "n_failed", "ok_percent")


@query(
    "agg_anomalies",
    """WITH g AS (SELECT avg(value) AS m, stddev_samp(value) AS s FROM events), h AS (SELECT date_trunc('hour', ts) AS hour, avg(value) AS mean, count(*) AS n FROM events GROUP BY 1), c AS (SELECT avg(n) AS typical FROM h)
       SELECT strftime(hour, '%Y-%m-%d %H') AS hour, n, CASE WHEN mean > m + 0.2 * s THEN 'SLOW' ELSE 'HIGH_VOLUME' END AS kind, CASE WHEN (mean > m + 0.2 * s AND mean > m + 0.4 * s) OR (NOT mean > m + 0.2 * s AND n > 0.4 * typical) THEN 'HIGH' ELSE 'MEDIUM' END AS severity
       FROM h, g, c WHERE mean > m + 0.2 * s OR n > 0.2 * typical""",
)
def agg_anomalies(t):
    return A.performance_anomalies(t.events, "ts", "value", 0.2).select(F.date_format("hour", "yyyy-MM-dd HH").alias("hour"), "n", "kind", "severity")


@query("agg_chunk_statistics", "SELECT source, count(*) AS n, round(avg(n_chars), 6) AS mean_chars, min(n_chars) AS least, max(n_chars) AS most FROM documents GROUP BY 1")
def agg_chunks(t):
    return t.documents.groupBy("source").agg(F.count("*").alias("n"), R(F.avg("n_chars")).alias("mean_chars"), F.min("n_chars").alias("least"), F.max("n_chars").alias("most"))


@query("agg_backup_health", "SELECT event_type, count(*) AS n, count(*) FILTER (value > 50) AS n_large, round(sum(value), 2) AS total, round(100.0 * count(*) FILTER (value > 50) / count(*), 2)::DOUBLE AS percent FROM events GROUP BY 1")
def agg_backup(t):
    g = t.events.groupBy("event_type").agg(F.count("*").alias("n"), F.count_if(F.col("value") > 50).alias("n_large"), R(F.sum("value"), 2).alias("total"))
    return g.withColumn("percent", A.share(F.col("n_large"), F.col("n")))


@query("agg_h_index", "SELECT s_nationkey, coalesce(max(CASE WHEN n >= r THEN r END), 0) AS h_index FROM (SELECT *, row_number() OVER (PARTITION BY s_nationkey ORDER BY n DESC, s_suppkey) AS r FROM (SELECT s_nationkey, s_suppkey, count(*) AS n FROM supplier JOIN lineitem ON l_suppkey = s_suppkey GROUP BY 1, 2)) GROUP BY 1")
def agg_h(t):
    n = t.supplier.join(t.lineitem, F.col("l_suppkey") == F.col("s_suppkey")).groupBy("s_nationkey", "s_suppkey").agg(F.count("*").alias("n"))
    return A.h_index(n, "s_nationkey", "n", "s_suppkey")


@query("agg_citation_anomaly", "SELECT p_partkey, count(*) AS n_in FROM part JOIN lineitem ON l_partkey = p_partkey WHERE p_size > 40 GROUP BY 1 HAVING count(*) > 25")
def agg_citation(t):
    return t.part.where("p_size > 40").join(t.lineitem, F.col("l_partkey") == F.col("p_partkey")).groupBy("p_partkey").agg(F.count("*").alias("n_in")).where("n_in > 25")


@query(
    "agg_nearest_rank",
    """WITH l AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS r FROM events), g AS (SELECT event_type, list_sort(list(value)) AS v, avg(value) AS mean, stddev_samp(value) AS stdev, median(value) AS median FROM l WHERE r <= 100 GROUP BY 1)
       SELECT event_type, round(mean, 6) AS mean, round(stdev, 6) AS stdev, round(median, 6) AS median, v[CAST(floor(len(v) * 0.5) AS INT) + 1] AS p50, v[CAST(floor(len(v) * 95 / 100) AS INT) + 1] AS p95, v[CAST(floor(len(v) * 99 / 100) AS INT) + 1] AS p99, len(v)::INT AS n, v[1] AS min, v[len(v)] AS max FROM g""",
)
def agg_nearest(t):
    out = A.nearest_rank(t.events, "event_type", [F.desc("ts"), F.desc("event_id")], "value", 100)
    return out.withColumns({c: R(F.col(c)) for c in ("mean", "stdev", "median")})


@query("agg_bottlenecks", "SELECT user_id, count(*) AS n, round(avg(value), 6) AS mean, round(quantile_cont(value, 0.95), 6) AS p95 FROM events GROUP BY 1 HAVING count(*) >= 2 AND quantile_cont(value, 0.95) > 1.5 * avg(value)")
def agg_bottlenecks(t):
    return A.bottlenecks(t.events, "user_id", "value").withColumns({"mean": R(F.col("mean")), "p95": R(F.col("p95"))})


@query("agg_sla", "SELECT event_type, count(*) AS total, count(*) FILTER (NOT value < 60) AS violations, round(1 - count(*) FILTER (NOT value < 60) / count(*), 6) AS rate FROM events GROUP BY 1")
def agg_sla(t):
    return A.compliance(t.events, "event_type", F.col("value") < 60).withColumn("rate", R(F.col("rate"), 6))


@query(
    "agg_histogram_percentiles",
    """WITH g AS (SELECT event_type, list_sort(list(value)) AS v, count(*) AS n FROM events GROUP BY 1), p AS (SELECT *, 0.95 * (n - 1) AS q95, 0.99 * (n - 1) AS q99 FROM g)
       SELECT event_type, v[CAST(floor((n + 1) / 2) AS INT)] AS p50,
       CASE WHEN q95 = floor(q95) THEN v[CAST(floor(q95) AS INT) + 1] ELSE round_even(v[CAST(floor(q95) AS INT) + 1] + (v[least(CAST(floor(q95) AS INT) + 2, n)] - v[CAST(floor(q95) AS INT) + 1]) * (q95 - floor(q95)), 0) END AS p95,
       CASE WHEN q99 = floor(q99) THEN v[CAST(floor(q99) AS INT) + 1] ELSE round_even(v[CAST(floor(q99) AS INT) + 1] + (v[least(CAST(floor(q99) AS INT) + 2, n)] - v[CAST(floor(q99) AS INT) + 1]) * (q99 - floor(q99)), 0) END AS p99 FROM p""",
)
def agg_histogram(t):
    return A.histogram_percentiles(t.events, "event_type", "value")


@query("agg_buckets", "SELECT event_type, count(*) FILTER (value <= 10) AS le_10, count(*) FILTER (value <= 50) AS le_50, count(*) FILTER (value <= 90) AS le_90, round(sum(value), 2) AS sum, count(*) AS count FROM events GROUP BY 1")
def agg_buckets(t):
    return A.buckets(t.events, "event_type", "value", (10, 50, 90)).withColumn("sum", R(F.col("sum"), 2))


@query("agg_mean_deviation", "SELECT round(avg(l_quantity), 6) AS mean_l_quantity, round(stddev_pop(l_quantity), 6) AS std_l_quantity, round(avg(l_discount), 6) AS mean_l_discount, round(stddev_pop(l_discount), 6) AS std_l_discount, count(*) AS n FROM lineitem")
def agg_mean(t):
    out = A.mean_and_deviation(t.lineitem, "l_quantity", "l_discount")
    return out.select(*[R(F.col(c)).alias(c) if c != "n" else F.col(c) for c in out.columns])


@query("agg_blame", "SELECT party, count(*) AS n, round(sum(d), 6) AS total, round(avg(d), 6) AS mean FROM (SELECT unnest([l_returnflag, l_linestatus]) AS party, l_quantity AS d FROM lineitem) GROUP BY 1")
def agg_blame(t):
    out = A.blame(t.lineitem.withColumn("parties", F.array("l_returnflag", "l_linestatus")), "parties", "l_quantity")
    return out.withColumns({"total": R(F.col("total")), "mean": R(F.col("mean"))})


@query("agg_evidence", "SELECT l_orderkey, count(*) AS n, round(least(1, avg(1 - l_discount) * (0.7 + 0.3 * least(count(*) / 5, 1))), 6) AS confidence FROM lineitem GROUP BY 1")
def agg_evidence(t):
    out = A.evidence_confidence(t.lineitem.withColumn("c", 1 - F.col("l_discount")), "l_orderkey", "c")
    return out.withColumn("confidence", R(F.col("confidence"), 6))


@query("agg_best", "SELECT p_partkey, p_retailprice FROM part WHERE p_retailprice IS NOT NULL ORDER BY p_retailprice DESC, p_partkey LIMIT 1")
def agg_best(t):
    return A.best(t.part, "p_partkey", "p_retailprice").select("p_partkey", "p_retailprice")


@query("agg_json_props", "SELECT event_type, round(avg(CAST(json_extract_string(props, '$.k') AS DOUBLE)), 6) AS mean_k, count(*) AS n FROM events GROUP BY 1")
def agg_json(t):
    return t.events.groupBy("event_type").agg(R(F.avg(F.get_json_object("props", "$.k").cast("double"))).alias("mean_k"), F.count("*").alias("n"))


# Windows


ROLL = "PARTITION BY event_type ORDER BY ts, event_id ROWS BETWEEN 9 PRECEDING AND CURRENT ROW"


@query("win_rolling_count", f"SELECT event_id, round(avg(value) OVER w, 6) AS mean, round(stddev_pop(value) OVER w, 6) AS std, min(value) OVER w AS min, max(value) OVER w AS max, round(quantile_cont(value, 0.5) OVER w, 6) AS p50, round(quantile_cont(value, 0.95) OVER w, 6) AS p95 FROM events WINDOW w AS ({ROLL})")
def win_rolling(t):
    out = W.rolling_count(t.events, "event_type", ["ts", "event_id"], "value", 10)
    return out.select("event_id", *[R(F.col(c)).alias(c) for c in ("mean", "std")], "min", "max", R(F.col("p50")).alias("p50"), R(F.col("p95")).alias("p95"))


@query("win_rolling_time", "SELECT event_id, round(avg(value) OVER w, 6) AS mean, count(value) OVER w AS n, max(value) OVER w AS max FROM events WINDOW w AS (PARTITION BY event_type ORDER BY ts RANGE BETWEEN INTERVAL 3600 SECOND PRECEDING AND CURRENT ROW)")
def win_time(t):
    return W.rolling_time(t.events, "event_type", "ts", "value", 3600).select("event_id", R(F.col("mean")).alias("mean"), "n", "max")


@query("win_several", "SELECT event_id, round(avg(value) OVER a, 6) AS mean_5, max(value) OVER a AS max_5, round(avg(value) OVER b, 6) AS mean_20, max(value) OVER b AS max_20 FROM events WINDOW a AS (PARTITION BY event_type ORDER BY ts, event_id ROWS 4 PRECEDING), b AS (PARTITION BY event_type ORDER BY ts, event_id ROWS 19 PRECEDING)")
def win_several(t):
    out = W.several_windows(t.events, "event_type", ["ts", "event_id"], "value", (5, 20))
    return out.select("event_id", *[R(F.col(c)).alias(c) for c in ("mean_5", "max_5", "mean_20", "max_20")])


@query("win_trend", "SELECT user_id, CASE WHEN count(*) >= 2 THEN round(regr_slope(value, s) * 1000000, 3) END AS slope FROM (SELECT *, (epoch_us(ts) - min(epoch_us(ts)) OVER (PARTITION BY user_id)) / 1e6 AS s FROM events) GROUP BY 1")
def win_trend(t):
    return W.trend(t.events, "user_id", "ts", "value").select("user_id", R(F.col("slope") * 1e6, 3).alias("slope"))


@query("win_rate", "SELECT user_id, CASE WHEN a <> 0 AND e > s THEN round(1e6 * 100 * (b - a) / a / (e - s), 6) END AS rate FROM (SELECT user_id, arg_min(value, (ts, event_id)) AS a, arg_max(value, (ts, event_id)) AS b, min(epoch_us(ts)) AS s, max(epoch_us(ts)) AS e FROM events GROUP BY 1)")
def win_rate(t):
    return W.rate_of_change(t.events, "user_id", "ts", "value", "event_id").select("user_id", R(F.col("percent_per_second"), 6).alias("rate"))


@query(
    "win_zscore",
    """SELECT event_id, round(z, 6) AS z, CASE WHEN z > 5 THEN 'critical' WHEN z > 4 THEN 'high' WHEN z > 3.5 THEN 'medium' ELSE 'low' END AS severity FROM (SELECT event_id, abs(value - m) / nullif(s, 0) AS z, n FROM (SELECT *, avg(value) OVER w AS m, stddev_pop(value) OVER w AS s, count(value) OVER w AS n
       FROM events WINDOW w AS (PARTITION BY event_type ORDER BY ts, event_id ROWS BETWEEN 50 PRECEDING AND 1 PRECEDING))) WHERE n >= 10 AND z > 2""",
)
def win_zscore(t):
    return W.zscore_anomalies(t.events, "event_type", ["ts", "event_id"], "value", 50, 2.0, 10).select("event_id", R(F.col("z")).alias("z"), "severity")


@query(
    "win_iqr",
    """WITH q AS (SELECT event_type, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM events GROUP BY 1)
       SELECT event_id, round(greatest(q1 - value, value - q3) / (q3 - q1), 6) AS far FROM events JOIN q USING (event_type) WHERE q3 > q1 AND greatest(q1 - value, value - q3) / (q3 - q1) > 0.3""",
)
def win_iqr(t):
    return W.iqr_anomalies(t.events, "event_type", "value", 0.3).select("event_id", R(F.col("far")).alias("far"))


@query(
    "win_degradation",
    """SELECT user_id, round((a - b) / nullif(a, 0), 6) AS fall FROM (SELECT user_id, avg(value) FILTER (r <= floor(c / 2)) AS a, avg(value) FILTER (r > floor(c / 2)) AS b
       FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS r, count(*) OVER (PARTITION BY user_id) AS c FROM events) GROUP BY 1)""",
)
def win_degradation(t):
    return W.degradation(t.events, "user_id", ["ts", "event_id"], "value").select("user_id", R(F.col("fall")).alias("fall"))


@query("win_outliers", "SELECT event_id, round(z, 6) AS z FROM (SELECT event_id, (value - avg(value) OVER w) / stddev_samp(value) OVER w AS z, count(value) OVER w AS n FROM events WINDOW w AS (PARTITION BY user_id)) WHERE n >= 10 AND abs(z) > 2")
def win_outliers(t):
    return W.statistical_outliers(t.events, "user_id", "value", 2.0).select("event_id", R(F.col("z")).alias("z"))


@query("win_top_per_group", "SELECT l_suppkey, l_orderkey, l_linenumber, rank FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber) AS rank FROM lineitem) WHERE rank <= 3")
def win_top(t):
    return W.top_per(t.lineitem, ["l_suppkey"], [F.desc("l_extendedprice"), "l_orderkey", "l_linenumber"], 3).select("l_suppkey", "l_orderkey", "l_linenumber", "rank")


@query("win_timeline_conflicts", "SELECT CAST(o_orderdate AS DATE) AS d, count(*) AS n, count(DISTINCT o_orderstatus) AS n_distinct FROM orders GROUP BY 1 HAVING count(*) > 1 AND count(DISTINCT o_orderstatus) > 1")
def win_conflicts(t):
    return W.timeline_conflicts(t.orders.withColumn("d", F.to_date("o_orderdate")), "d", "o_orderstatus")


@query("win_density", "SELECT o_orderpriority, round(count(*) / count(DISTINCT CAST(o_orderdate AS DATE)), 6) AS density FROM orders GROUP BY 1")
def win_density(t):
    return W.density(t.orders.withColumn("d", F.to_date("o_orderdate")), "o_orderpriority", "d").withColumn("density", R(F.col("density"), 6))


@query("win_interval_events", "SELECT o_orderkey, kind, CAST(x AS DATE) AS day FROM (SELECT o_orderkey, 'start' AS kind, o_orderdate AS x FROM orders UNION ALL SELECT o_orderkey, 'end', max(l_shipdate) FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1)")
def win_intervals(t):
    end = t.lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.max("l_shipdate").alias("e"))
    return W.interval_events(t.orders.join(end, "o_orderkey", "left"), "o_orderkey", "o_orderdate", "e").select("o_orderkey", "kind", F.to_date("at").alias("day"))


@query(
    "win_suppress_repeats",
    """WITH RECURSIVE e AS (SELECT event_id, user_id, epoch_us(ts) / 1e6 AS s FROM events), f AS (SELECT user_id, min((s, event_id)) AS p FROM e GROUP BY 1
       UNION ALL SELECT user_id, (SELECT min((e.s, e.event_id)) FROM e WHERE e.user_id = f.user_id AND e.s >= f.p[1] + 7200) FROM f WHERE p IS NOT NULL)
       SELECT CAST(p[2] AS BIGINT) AS event_id FROM f WHERE p IS NOT NULL""",
)
def win_suppress(t):
    return W.suppress_repeats(t.events, "user_id", W.micros("ts") / 1e6, "event_id", 7200).select("event_id")


# Sets and limits


@query("top_union_of_branches", "SELECT id, sum(s) AS score FROM (SELECT l_partkey AS id, 1 AS s FROM lineitem WHERE l_quantity > 45 UNION SELECT p_partkey, 2 FROM part WHERE p_size > 40 UNION SELECT p_partkey, 4 FROM part WHERE p_retailprice > 1500) GROUP BY 1")
def top_union(t):
    a = t.lineitem.where("l_quantity > 45").select(F.col("l_partkey").alias("id"), F.lit(1).alias("s"))
    b = t.part.where("p_size > 40").select(F.col("p_partkey").alias("id"), F.lit(2).alias("s"))
    c = t.part.where("p_retailprice > 1500").select(F.col("p_partkey").alias("id"), F.lit(4).alias("s"))
    return a.union(b).union(c).distinct().groupBy("id").agg(F.sum("s").alias("score"))


@query("top_two_stage", "SELECT c_custkey, round(0.7 * c_acctbal + 0.3 * c_nationkey, 6) AS score FROM (SELECT * FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 60) ORDER BY 0.7 * c_acctbal + 0.3 * c_nationkey DESC, c_custkey LIMIT 20")
def top_two(t):
    few = t.customer.orderBy(F.desc("c_acctbal"), "c_custkey").limit(60)
    score = 0.7 * F.col("c_acctbal") + 0.3 * F.col("c_nationkey")
    return few.withColumn("s", score).orderBy(F.desc("s"), "c_custkey").limit(20).select("c_custkey", R(F.col("s")).alias("score"))


@query("top_source_priority", "SELECT id, source FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY p) AS r FROM (SELECT DISTINCT l_partkey AS id, 'graph' AS source, 0 AS p FROM lineitem WHERE l_discount > 0.09 UNION ALL SELECT p_partkey, 'text', 1 FROM part WHERE p_size < 20)) WHERE r = 1")
def top_priority(t):
    g = t.lineitem.where("l_discount > 0.09").select(F.col("l_partkey").alias("id"), F.lit("graph").alias("source"), F.lit(0).alias("p")).distinct()
    x = t.part.where("p_size < 20").select(F.col("p_partkey").alias("id"), F.lit("text").alias("source"), F.lit(1).alias("p"))
    return g.union(x).groupBy("id").agg(F.min_by("source", "p").alias("source"))
