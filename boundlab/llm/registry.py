"""The subpackage's queries and their DuckDB texts."""

from __future__ import annotations

import corpus_pipeline

from . import chat, divergence, infill, language_model, licenses, mixing, pieces, quality, quality_model, quality_sql, sharding, simhash, topk, toxicity

QUERIES = {
    "op1_quality_rules": quality.op1_quality_rules,
    "op2_simhash_near_dedup": simhash.op2_simhash_near_dedup,
    "op3_sentencepiece": pieces.op3_sentencepiece,
    "op4_license_scan": licenses.op4_license_scan,
    "op5_chat_formatting": chat.op5_chat_formatting,
    "op6_top_k": topk.op6_top_k,
    "op7_source_mixing": mixing.op7_source_mixing,
    "op8_balanced_shards": sharding.op8_balanced_shards,
    "op9_language_model": language_model.op9_language_model,
    "op10_toxicity": toxicity.op10_toxicity,
    "op11_quality_model": quality_model.op11_quality_model,
    "op12_source_divergence": divergence.op12_source_divergence,
    "op13_fill_in_middle": infill.op13_fill_in_middle,
    "pipeline": corpus_pipeline.run,
}
ORACLES = {
    "op1_quality_rules": quality_sql.ORACLE,
    "op4_license_scan": licenses.ORACLE,
    "op5_chat_formatting": chat.ORACLE,
    "op6_top_k": topk.ORACLE,
    "op7_source_mixing": mixing.ORACLE,
    "op12_source_divergence": divergence.ORACLE,
    "op13_fill_in_middle": infill.ORACLE,
}
if corpus_pipeline.ORACLE_SQL:
    ORACLES["pipeline"] = corpus_pipeline.ORACLE_SQL
