"""Text functions over documents, pages and conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import filters as P
from .registry import query

R = lambda c, n=6: F.round(c, n)
DOCS = "documents WHERE text IS NOT NULL"
SPLIT = r"list_filter(string_split_regex(trim(text), '\s+'), lambda x: x <> '')"
TOK = r"regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')"


def docs(t):
    return t.documents.where("text IS NOT NULL")


@query("txt_normalize", rf"SELECT doc_id, trim(regexp_replace(translate(text, '0123456789', '۰۱۲۳۴۵۶۷۸۹'), '\s+', ' ', 'g')) AS text FROM {DOCS}")
def txt_normalize(t):
    return docs(t).select("doc_id", T.normalize(F.col("text")).alias("text"))


@query("txt_clean")
def txt_clean(t):
    return t.pages.select("page_id", T.clean(F.col("html")).alias("text"))


@query("txt_without_unwanted")
def txt_unwanted(t):
    return docs(t).select("doc_id", T.without_unwanted(F.col("text")).alias("text"))


@query(
    "txt_redact",
    r"""SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}', '[EMAIL]', 'g'), '(?:\+98|0)?9\d{9}\b', '[PHONE]', 'g'),
       '\b\d{10}\b', '[NATIONAL_ID]', 'g'), '\b\d{4}[- ]?\d{4}[- ]?\d{4}[- ]?\d{4}\b', '[CARD]', 'g'), '\b\d{1,3}(?:\.\d{1,3}){3}\b', '[IP]', 'g') AS text FROM documents WHERE text IS NOT NULL""",
)
def txt_redact(t):
    return docs(t).select("doc_id", T.redact(F.col("text")).alias("text"))


@query("txt_is_safe", r"SELECT doc_id, NOT (regexp_matches(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}') OR regexp_matches(text, '(?:\+98|0)?9\d{9}\b') OR regexp_matches(text, '\b\d{10}\b') OR regexp_matches(text, '\b\d{4}[- ]?\d{4}[- ]?\d{4}[- ]?\d{4}\b') OR regexp_matches(text, '\b\d{1,3}(?:\.\d{1,3}){3}\b')) AS safe FROM documents WHERE text IS NOT NULL")
def txt_safe(t):
    return docs(t).select("doc_id", T.is_safe(F.col("text")).alias("safe"))


@query("txt_scrub")
def txt_scrub(t):
    return docs(t).select("doc_id", T.scrub(F.col("text")).alias("text"))


@query("txt_sentences", r"SELECT doc_id, len(list_filter(list_transform(string_split_regex(text, '[.!?؟]+'), lambda s: trim(s)), lambda s: length(s) > 0))::INT AS n_sentences FROM documents WHERE text IS NOT NULL")
def txt_sentences(t):
    return docs(t).select("doc_id", F.size(T.sentences_plain(F.col("text"))).alias("n_sentences"))


@query("txt_statistics", rf"SELECT doc_id, length(text)::INT AS n_chars, len(w)::INT AS n_words, len(list_distinct(w))::INT AS n_distinct, round(CASE WHEN len(w) > 0 THEN length(array_to_string(w, '')) / len(w) ELSE 0 END, 6) AS mean_word FROM (SELECT doc_id, text, {SPLIT} AS w FROM {DOCS})")
def txt_statistics(t):
    s = T.statistics(F.col("text"))
    return docs(t).select("doc_id", s["n_chars"].alias("n_chars"), s["n_words"].alias("n_words"), s["n_distinct"].alias("n_distinct"), R(s["mean_word"]).alias("mean_word"))


@query("txt_truncate", f"SELECT doc_id, CASE WHEN length(text) <= 80 THEN text ELSE substr(text, 1, 77) || '...' END AS text FROM {DOCS}")
def txt_truncate(t):
    return docs(t).select("doc_id", T.truncate(F.col("text"), 80).alias("text"))


@query("txt_script_share", f"SELECT doc_id, round((length(text) - length(regexp_replace(text, '[éèêç]', '', 'g'))) / length(regexp_replace(text, '[^\\p{{L}}\\p{{M}}\\p{{N}}_]+', '', 'g')), 6) AS share FROM {DOCS} AND length(regexp_replace(text, '[^\\p{{L}}\\p{{M}}\\p{{N}}_]+', '', 'g')) > 0")
def txt_share(t):
    return docs(t).where(F.length(F.regexp_replace("text", r"(?U)\W+", "")) > 0).select("doc_id", R(T.script_share(F.col("text"), "[éèêç]")).alias("share"))


@query("txt_jaccard_neighbours", f"WITH d AS (SELECT doc_id, list_distinct({TOK}) AS w FROM {DOCS}) SELECT a.doc_id, round(CASE WHEN len(list_distinct(list_concat(a.w, b.w))) > 0 THEN len(list_intersect(a.w, b.w)) / len(list_distinct(list_concat(a.w, b.w))) ELSE 1 END, 6) AS jaccard FROM d a JOIN d b ON b.doc_id = a.doc_id + 1")
def txt_jaccard(t):
    d = docs(t).select("doc_id", T.tokens(F.col("text")).alias("w"))
    other = d.select((F.col("doc_id") - 1).alias("doc_id"), F.col("w").alias("v"))
    return d.join(other, "doc_id").select("doc_id", R(T.jaccard(F.col("w"), F.col("v"))).alias("jaccard"))


@query("txt_dates", r"SELECT event_id, len(regexp_extract_all(d, '\b\d{4}[/-]\d{1,2}[/-]\d{1,2}\b'))::INT AS n FROM (SELECT event_id, 'on ' || strftime(ts, '%Y-%m-%d') || ' and 1400/1/2' AS d FROM events)")
def txt_dates(t):
    return t.events.select("event_id", F.size(T.dates(F.concat(F.lit("on "), F.date_format("ts", "yyyy-MM-dd"), F.lit(" and 1400/1/2")))).alias("n"))


@query("txt_first_number", r"SELECT event_id, coalesce(CAST(nullif(regexp_extract(props, '\"k\": (\d+)', 1), '') AS INT), 0) AS n FROM events")
def txt_number(t):
    return t.events.select("event_id", T.first_number(F.col("props"), r'"z": (\d+)', r'"k": (\d+)').alias("n"))


@query("txt_entity_id", """SELECT p_partkey, 'part_' || substr(sha256('{"brand":"' || p_brand || '","name":"' || p_name || '"}'), 1, 48) AS id FROM part""")
def txt_id(t):
    return t.part.select("p_partkey", T.canonical_id("part", name=F.col("p_name"), brand=F.col("p_brand")).alias("id"))


@query("txt_intent", "SELECT doc_id, CASE WHEN regexp_matches(text, '!!') THEN 'SHOUT' WHEN regexp_matches(text, '\\|') THEN 'TABLE' ELSE 'GENERAL' END AS intent, CASE WHEN regexp_matches(text, '!!|\\|') THEN 0.9 ELSE 0.5 END AS confidence FROM documents WHERE text IS NOT NULL")
def txt_intent(t):
    label, sure = T.classify(F.col("text"), [("SHOUT", "!!"), ("TABLE", r"\|")], "GENERAL")
    return docs(t).select("doc_id", label.alias("intent"), sure.alias("confidence"))


@query("txt_route", "SELECT doc_id, CASE WHEN greatest(a, b) <= 0 THEN 'GENERAL' WHEN a >= b THEN 'EN' ELSE 'ROM' END AS route FROM (SELECT doc_id, CASE WHEN contains(text, ' the ') THEN 1.0 ELSE 0 END + CASE WHEN contains(text, ' of ') THEN 0.5 ELSE 0 END AS a, CASE WHEN contains(text, ' la ') THEN 1.0 ELSE 0 END + CASE WHEN contains(text, ' de ') THEN 0.7 ELSE 0 END AS b FROM documents WHERE text IS NOT NULL)")
def txt_route(t):
    return docs(t).select("doc_id", T.route(F.col("text"), {"EN": {" the ": 1.0, " of ": 0.5}, "ROM": {" la ": 1.0, " de ": 0.7}}, "GENERAL").alias("route"))


@query("txt_complexity", f"SELECT doc_id, round(0.5 * len({SPLIT}) + CASE WHEN contains(text, 'tion') THEN 1.5 ELSE 0 END + CASE WHEN contains(text, '|') THEN 5 ELSE 0 END, 4)::DOUBLE AS score FROM {DOCS}")
def txt_complexity(t):
    return docs(t).select("doc_id", R(T.complexity(F.col("text"), ["tion"], [("|", 5.0)]), 4).cast("double").alias("score"))


@query("txt_contradictions", f"WITH d AS (SELECT doc_id, {TOK} AS w FROM {DOCS}) SELECT a.doc_id, (list_contains(a.w, 'the') AND list_contains(b.w, 'la')) OR (list_contains(a.w, 'la') AND list_contains(b.w, 'the')) OR (list_contains(a.w, 'not') <> list_contains(b.w, 'not') AND list_has_any(a.w, b.w)) AS contradicts FROM d a JOIN d b ON b.doc_id = a.doc_id + 1")
def txt_contradictions(t):
    d = docs(t).select("doc_id", T.tokens(F.col("text")).alias("w"))
    other = d.select((F.col("doc_id") - 1).alias("doc_id"), F.col("w").alias("v"))
    return d.join(other, "doc_id").select("doc_id", T.contradicts(F.col("w"), F.col("v"), {"the": "la"}, ["not"]).alias("contradicts"))


@query("txt_ngrams", rf"SELECT doc_id, len(list_distinct(list_transform(range(1, greatest(len(w) - 2, 0) + 1), lambda i: array_to_string(w[i:i + 2], ' '))))::INT AS n FROM (SELECT doc_id, {SPLIT} AS w FROM {DOCS})")
def txt_ngrams(t):
    return docs(t).select("doc_id", F.size(F.array_distinct(T.ngrams(T.words(F.col("text")), 3))).alias("n"))


@query("txt_page_validation", "SELECT page_id, array_to_string(list_filter([CASE WHEN length(html) < 1000 THEN 'too_small' END, CASE WHEN length(html) > 20000 THEN 'too_large' END, CASE WHEN lower(regexp_extract(split_part(split_part(url, '?', 1), '#', 1), '(\\.[^./]+)$', 1)) <> '.html' THEN 'suffix' END], lambda x: x IS NOT NULL), ',') AS problems FROM pages")
def txt_pages(t):
    path = F.regexp_extract("url", "^[^?#]*", 0)
    return t.pages.select("page_id", F.array_join(P.file_problems(path, F.length("html"), 1000, 20000, [".html"]), ",").alias("problems"))


@query("txt_html", r"SELECT page_id, length(trim(regexp_replace(regexp_replace(html, '<[^>]+>', '', 'g'), '\s+', ' ', 'g'))) > 0 AS has_text FROM pages")
def txt_html(t):
    from ..sources.readers import html_text

    return t.pages.select("page_id", (F.length(html_text(F.col("html"))) > 0).alias("has_text"))
