"""Keywords, entities, relations, chunking, deduplication."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import chunks as C
from ..operators import documents as D
from .registry import query

R = lambda c, n=6: F.round(c, n)
TOK = r"regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')"


def docs(t):
    return t.documents.where("text IS NOT NULL")


@query(
    "doc_keywords",
    f"""SELECT doc_id, word, n, rank FROM (SELECT doc_id, word, count(*) AS n, row_number() OVER (PARTITION BY doc_id ORDER BY count(*) DESC, min(p)) AS rank
        FROM (SELECT doc_id, unnest({TOK}) AS word, unnest(range(len({TOK}))) AS p FROM documents WHERE text IS NOT NULL) WHERE length(word) >= 3 GROUP BY 1, 2) WHERE rank <= 5""",
)
def doc_keywords(t):
    return D.keywords(docs(t), "doc_id", "text", 5)


@query("doc_spans", r"""SELECT doc_id, category, value FROM (SELECT doc_id, 'email' AS category, unnest(regexp_extract_all(text, '[\w.]+@[\w.]+')) AS value FROM documents UNION ALL SELECT doc_id, 'number', unnest(regexp_extract_all(text, '[0-9]{3,}')) FROM documents)""")
def doc_spans(t):
    return D.spans(docs(t), "doc_id", "text", {"email": r"[\w.]+@[\w.]+", "number": "[0-9]{3,}"})


@query("doc_merge_entities", r"SELECT lower(p_brand) AS name, p_type, max(p_retailprice) AS score, string_agg(DISTINCT 's' || p_size % 3, '+' ORDER BY 's' || p_size % 3) AS sources, count(*) AS n FROM part GROUP BY 1, 2")
def doc_merge(t):
    return D.merge_entities(t.part.withColumn("src", F.concat(F.lit("s"), (F.col("p_size") % 3).cast("string"))), "p_brand", "p_type", "p_retailprice", "src")


@query("doc_relations")
def doc_relations(t):
    return D.relations(docs(t), "doc_id", "text", r"\b[A-Z]{3,}\b|\b\d{3,}\b")


@query("doc_hash_dedup", r"SELECT min(doc_id) AS doc_id FROM (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(trim(regexp_replace(text, '\s+', ' ', 'g'))), '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}', '[EMAIL]', 'g'), '(?:\+98|0)?9\d{9}\b', '[PHONE]', 'g'), '\b\d{10}\b', '[NATIONAL_ID]', 'g'), '\b\d{4}[- ]?\d{4}[- ]?\d{4}[- ]?\d{4}\b', '[CARD]', 'g'), '\b\d{1,3}(?:\.\d{1,3}){3}\b', '[IP]', 'g') AS x FROM documents WHERE text IS NOT NULL) GROUP BY x")
def doc_hash(t):
    return D.hash_dedup(docs(t), "text", "doc_id").select("doc_id")


@query("doc_qa_dedup", "SELECT min(conv_id * 100 + turn) AS id FROM conversations GROUP BY md5(lower(trim(role)) || '|' || lower(trim(coalesce(text, ''))))")
def doc_qa(t):
    c = t.conversations.withColumn("id", F.col("conv_id") * 100 + F.col("turn"))
    return D.first_of(c, [F.md5(F.concat(F.lower(F.trim("role")), F.lit("|"), F.lower(F.trim(F.coalesce("text", F.lit(""))))))], ["id"]).select("id")


@query("doc_greedy_dedup")
def doc_greedy(t):
    return D.greedy_dedup(t.documents, "doc_id", T.tokens(F.coalesce("text", F.lit(""))), 0.85)


FIX = """WITH d AS (SELECT doc_id, text, length(text) AS n, greatest(CAST(ceil((length(text) - 512) / 462) AS INT), 0) AS last FROM documents WHERE length(text) > 0)
SELECT doc_id, i::INT AS chunk, substr(text, i * 462 + 1, 512) AS text FROM (SELECT *, unnest(range(0, last + 1)) AS i FROM d)"""


@query("doc_chunk_fixed", FIX)
def doc_fixed(t):
    return D.chunk_fixed(docs(t), "doc_id", "text", 512, 50)


@query("doc_chunk_words")
def doc_words(t):
    return D.chunk_words(docs(t), "doc_id", "text", 120)


@query("doc_chunk_sentences")
def doc_sentences(t):
    return D.chunk_sentences(docs(t), "doc_id", "text", 400)


PARA = r"""WITH p AS (SELECT doc_id, unnest(x) AS p, unnest(range(len(x))) AS k FROM (SELECT doc_id, list_filter(list_transform(string_split_regex(text, '\n+'), lambda s: trim(s)), lambda s: length(s) > 0) AS x FROM documents WHERE text IS NOT NULL)),
c AS (SELECT doc_id, k, i, substr(p, i * 300 + 1, 300) AS text FROM (SELECT *, unnest(range(0, CAST(floor((length(p) - 1) / 300) AS INT) + 1)) AS i FROM p))
SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY k, i) - 1)::INT AS chunk, text FROM c"""


@query("doc_chunk_paragraphs", PARA)
def doc_paragraphs(t):
    return D.chunk_paragraphs(docs(t), "doc_id", "text", 300)


@query("doc_chunk_headings")
def doc_headings(t):
    return D.chunk_headings(docs(t), "doc_id", "text", r"\n[A-Z]{4,}", 600)


@query("doc_chunk_by_similarity")
def doc_similarity(t):
    return D.chunk_by_similarity(t.documents.where("text IS NOT NULL"), "doc_id", "text", 0.05, 300)


@query("doc_chunk_adaptive")
def doc_adaptive(t):
    """Chunks of about 120 words that end where sentences change, never between an initial and a name."""
    c = C.chunk_adaptive(t.documents, "doc_id", "text", 60, 120, 160, entity=r"\b[A-Z]\.\s[A-Z]\w+")
    return c.withColumns({"coherence": R(F.col("coherence")), "density": R(F.col("density"))})


@query("doc_chunk_score")
def doc_score(t):
    c = D.chunk_sentences(docs(t), "doc_id", "text", 400)
    return c.select("doc_id", "chunk", R(D.chunk_score(F.col("text"), 20, 120)).alias("score"))


@query("doc_expand_terms", "WITH s AS (SELECT * FROM (VALUES ('building', 'house'), ('building', 'site'), ('automobile', 'car')) v(term, synonym)) SELECT c_custkey, rank, variant FROM (SELECT c_custkey, row_number() OVER (PARTITION BY c_custkey ORDER BY synonym) AS rank, synonym || ' market' AS variant FROM customer JOIN s ON lower(c_mktsegment) = term) WHERE rank <= 1")
def doc_expand(t):
    s = t.spark.createDataFrame([("building", "house"), ("building", "site"), ("automobile", "car")], "term string, synonym string")
    return D.expand_terms(t.customer.select("c_custkey", F.concat("c_mktsegment", F.lit(" market")).alias("q")), "c_custkey", "q", s, 1)


@query("doc_corpus_hash", "SELECT source, sha256(string_agg(doc_id || ':' || sha256(text), chr(10) ORDER BY CAST(doc_id AS VARCHAR))) AS hash FROM documents WHERE text IS NOT NULL GROUP BY 1")
def doc_corpus(t):
    return D.corpus_hash(docs(t).withColumn("path", F.col("doc_id").cast("string")), "source", "path", "text")
