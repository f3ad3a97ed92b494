"""Queries of the operators and their SQL twins."""

from __future__ import annotations

from . import (
    centroids,
    decontamination,
    filter_audit,
    language,
    lz_fingerprint,
    mixing,
    ngram_join,
    personal_data,
    quality,
    sharding,
    substring_dedup,
    token_counts,
    toxicity,
)

QUERIES = {
    "op1_ngram_jaccard_join": ngram_join.query,
    "op2_quality_classifier": quality.query,
    "op3_benchmark_decontamination": decontamination.query,
    "op4_toxicity": toxicity.query,
    "op5_token_counts": token_counts.query,
    "op6_substring_dedup": substring_dedup.query,
    "op7_personal_data": personal_data.query,
    "op8_language_id": language.query,
    "op9_lz_fingerprint": lz_fingerprint.query,
    "op10_source_mixing": mixing.query,
    "op11_rendezvous_sharding": sharding.query,
    "op12_filter_audit": filter_audit.query,
    "op13_ptolemaic_clustering": centroids.query,
}

SQL = {
    "op1_ngram_jaccard_join": ngram_join.SQL,
    "op3_benchmark_decontamination": decontamination.SQL,
    "op6_substring_dedup": substring_dedup.SQL,
    "op10_source_mixing": mixing.SQL,
    "op11_rendezvous_sharding": sharding.SQL,
    "op12_filter_audit": filter_audit.SQL,
    "op13_ptolemaic_clustering": centroids.SQL,
}
