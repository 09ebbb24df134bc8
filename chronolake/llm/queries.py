"""Registered queries of these operators, and their DuckDB equivalents where SQL has one."""

from . import embedding_dedup, jaccard, language, lm_scoring, mixing, packing, sharding, topk, toxicity, url_filter

QUERIES = {
    "op1_lm_scoring": lm_scoring.op1_lm_scoring,
    "op2_url_filter": url_filter.op2_url_filter,
    "op3_embedding_dedup": embedding_dedup.op3_embedding_dedup,
    "op4_sharding": sharding.op4_sharding,
    "op5_topk": topk.op5_topk,
    "op6_language": language.op6_language,
    "op7_toxicity": toxicity.op7_toxicity,
    "op8_mixing": mixing.op8_mixing,
    "op9_packing": packing.op9_packing,
    "op10_jaccard": jaccard.op10_jaccard,
}

ORACLES = {"op2_url_filter": url_filter.ORACLE, "op3_embedding_dedup": embedding_dedup.ORACLE, "op4_sharding": sharding.ORACLE, "op5_topk": topk.ORACLE, "op10_jaccard": jaccard.ORACLE}
