"""The queries of this subpackage: name -> callable(spark, sf_dir), and their SQL."""

from __future__ import annotations

from statloom.llm import bpe, chat, embed_dedup, line_dedup, packing, pii, quality, simhash, toxicity, urls

QUERIES = {
    "op1_line_dedup": line_dedup.op1_query,
    "op2_preference_format": chat.op2_query,
    "op3_simhash_dedup": simhash.op3_query,
    "op4_embedding_dedup": embed_dedup.op4_query,
    "op5_toxicity": toxicity.op5_query,
    "op6_bpe": bpe.op6_query,
    "op7_quality_rules": quality.op7_query,
    "op8_best_fit_packing": packing.op8_query,
    "op9_url_filter": urls.op9_query,
    "op10_pii": pii.op10_query,
}

ORACLE_SQL = {
    "op1_line_dedup": line_dedup.OP1_SQL,
    "op4_embedding_dedup": embed_dedup.OP4_SQL,
    "op7_quality_rules": quality.OP7_SQL,
}
