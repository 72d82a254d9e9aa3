"""The training-data queries and the SQL of those that SQL can state."""

from __future__ import annotations

from . import language, mixing, near_text, postings, records, sentences, sharding, suffixes, tokens, vectors


def queries() -> dict:
    return {
        "op1_hypergeometric_shards": sharding.op1_hypergeometric_shards,
        "op2_sentence_spans": sentences.op2_sentence_spans,
        "op3_token_counts": tokens.op3_token_counts,
        "op4_token_records": records.op4_token_records,
        "op5_odd_sketch_components": near_text.op5_odd_sketch_components,
        "op6_benchmark_contamination": postings.op6_benchmark_contamination,
        "op7_language_id": language.op7_language_id,
        "op8_vector_links": vectors.op8_vector_links,
        "op9_repeated_bytes": suffixes.op9_repeated_bytes,
        "op10_raked_mixture": mixing.op10_raked_mixture,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op2_sentence_spans": sentences.ORACLE_SQL,
        "op5_odd_sketch_components": near_text.ORACLE_SQL,
        "op6_benchmark_contamination": postings.ORACLE_SQL,
        "op8_vector_links": vectors.ORACLE_SQL,
        "op9_repeated_bytes": suffixes.ORACLE_SQL,
        "op10_raked_mixture": mixing.oracle_sql(),
    }
