"""The corpus queries and, where SQL can express them, their SQL."""

from __future__ import annotations

from . import (
    chat_format,
    chat_repair,
    decontaminate,
    hilbert_shards,
    langid,
    line_dedup,
    ngram_join,
    quality_fm,
    quality_rules,
    sentencepiece_codec,
    source_audit,
    suffix_dedup,
    url_filter,
)

QUERIES = {
    "op1_sentencepiece": sentencepiece_codec.query,
    "op2_url_filter": url_filter.query,
    "op3_suffix_dedup": suffix_dedup.query,
    "op4_language_id": langid.query,
    "op5_line_dedup": line_dedup.query,
    "op6_ngram_join": ngram_join.query,
    "op7_chat_format": chat_format.query,
    "op8_quality_rules": quality_rules.query,
    "op9_decontaminate": decontaminate.query,
    "op10_quality_fm": quality_fm.query,
    "op11_chat_repair": chat_repair.query,
    "op12_source_audit": source_audit.query,
    "op13_hilbert_shards": hilbert_shards.query,
}
ORACLES: dict[str, str] = {
    "op5_line_dedup": line_dedup.ORACLE,
    "op6_ngram_join": ngram_join.ORACLE,
    "op7_chat_format": chat_format.ORACLE,
    "op9_decontaminate": decontaminate.ORACLE,
    "op12_source_audit": source_audit.ORACLE,
}
