"""A corpus pipeline in stages; each stage's rows are written and read again.

Stages work on all rows their predecessor kept. All but the last return the
columns of documents, further ones included, whatever their names. All take
null ids, null, empty and very long texts (a text must fit into a task), ties,
repeated rows and empty tables; an empty table gives no rows.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm import decontaminate, langid, line_dedup, ngram_join, sentencepiece_codec
from quern.llm.common import stored

#: Documents go of whose letter n-grams less than this share is in any language. Of 1,864 held-out clean texts the
#: lowest have 0.87 (mixed languages included), random letters 0.32, random draws of the eight commonest letters
#: 0.58 to 0.80, other scripts 0.
MIN_KNOWN_SHARE = 0.75
NEAR = ngram_join.Rule(k=5, num=80, den=100)
MODEL = "piece_bpe_32k.model"


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents go whose letters are of no language: null and empty texts and texts without letters, too.

    A text of two languages, or one that fits two equally, stays. Repeated rows share their fate.
    """
    return langid.keep_known(docs, langid.learn(langid.train_set(docs)), MIN_KNOWN_SHARE)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated and nearly repeated lines go, the earliest by (id, line) stays; n_chars follows the text.

    No document goes: a null text stays null (n_chars too), one that loses every line stays empty; rows equal in
    id and text keep the same lines; null ids come first.
    """
    return line_dedup.dedup_lines(docs).withColumn("n_chars", F.length("text").cast("long"))


def dedup_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-equal documents the one with the smallest id stays.

    Null, empty and wordless texts are near nothing and stay; of rows equal in id and text one stays; rows
    without an id stay.
    """
    return ngram_join.one_of_each(docs, NEAR)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a passage of a benchmark item go.

    Null, empty and wordless texts stay; repeated rows go or stay together; an empty benchmark takes nothing.
    """
    return decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), mode="document")


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of what is left, with digests of ids and of the decoded text.

    A row for each row; null and empty texts have begin and end id only; repeated rows have equal ids.
    """
    return sentencepiece_codec.encode(docs, public_tokenizers.path(MODEL))


STAGES = [
    ("language_id", language_id),
    ("line_dedup", dedup_lines),
    ("ngram_join", dedup_documents),
    ("decontaminate", drop_benchmark),
    ("sentencepiece", tokens),
]
#: Languages and tokens cannot be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        rows = stored(stage(spark, rows, sf_dir), name)
    return STAGES[-1][1](spark, rows, sf_dir)
