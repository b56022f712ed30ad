"""The training-data queries by name."""

from __future__ import annotations

from . import bpe, clusters, decontaminate, embedding_dedup, fim, language, language_model, near_dup, sharding, suffix_dedup, token_counts, urls, vectors

QUERIES = {
    "op1_near_dedup": near_dup.op1_near_dedup,
    "op2_language_id": language.op2_language_id,
    "op3_sharding": sharding.op3_sharding,
    "op4_suffix_dedup": suffix_dedup.op4_suffix_dedup,
    "op5_bpe": bpe.op5_bpe,
    "op6_decontamination": decontaminate.op6_decontamination,
    "op7_url_filters": urls.op7_url_filters,
    "op7_url_rules": urls.op7_url_rules,
    "op8_exact_top_k": vectors.op8_exact_top_k,
    "op9_token_counts": token_counts.op9_token_counts,
    "op10_lm_scoring": language_model.op10_lm_scoring,
    "op10_lm_scoring_order_three": language_model.op10_lm_scoring_order_three,
    "op11_centroid_clusters": clusters.op11_centroid_clusters,
    "op12_embedding_dedup": embedding_dedup.op12_embedding_dedup,
    "op13_fill_in_middle": fim.op13_fill_in_middle,
}
ORACLES: dict[str, str] = {
    "op7_url_rules": urls.OP7_SQL,
    "op8_exact_top_k": vectors.OP8_SQL,
    "op11_centroid_clusters": clusters.OP11_SQL,
    "op12_embedding_dedup": embedding_dedup.OP12_SQL,
    "op13_fill_in_middle": fim.OP13_SQL,
}
