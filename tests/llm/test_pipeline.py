"""The pipeline's stages on small tables and on odd rows."""

import corpus_pipeline
from quern.llm import sentencepiece_codec
from quern.llm.common import stored

from test_llm_operators import SF, no_documents, odd_documents


def test_stages_keep_the_columns(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet")
    columns, counts = rows.columns, [rows.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        rows = stored(stage(spark, rows, SF), name)
        assert rows.columns == columns
        counts.append(rows.count())
    assert counts == sorted(counts, reverse=True) and counts[-1] > 0.8 * counts[0]
    out = corpus_pipeline.run(spark, SF)
    assert sorted(r["doc_id"] for r in out.collect()) == sorted(r["doc_id"] for r in rows.collect())


def test_last_stage_equals_the_library(spark):
    import public_tokenizers
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(corpus_pipeline.MODEL))
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    for r in corpus_pipeline.tokens(spark, docs, SF).collect():
        assert list(r["ids"]) == [1, *sp.encode(texts[r["doc_id"]] or ""), 2]
    assert sentencepiece_codec.HEAP_FROM > 0


def test_stages_on_odd_and_no_rows(spark):
    for docs in (odd_documents(spark), no_documents(spark)):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, SF)
            assert set(out.columns) == set(docs.columns)
            out.count()
        corpus_pipeline.tokens(spark, docs, SF).count()
