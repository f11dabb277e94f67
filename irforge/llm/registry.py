"""The queries of the corpus operators and their SQL twins."""

from __future__ import annotations

from irforge.llm import centroid_clustering, decontamination, fingerprints, jaccard_join, language_id, line_dedup, packing, sharding, substring_dedup, token_counts, toxicity, url_filter, vector_codes

LLM_QUERIES = {
    "op1_ngram_jaccard_join": jaccard_join.op1_ngram_jaccard_join,
    "op2_language_id": language_id.op2_language_id,
    "op3_sharding": sharding.op3_sharding,
    "op4_decontamination": decontamination.op4_decontamination,
    "op5_line_dedup": line_dedup.op5_line_dedup,
    "op6_url_filters": url_filter.op6_url_filters,
    "op7_packing": packing.op7_packing,
    "op8_substring_dedup": substring_dedup.op8_substring_dedup,
    "op9_toxicity": toxicity.op9_toxicity,
    "op10_fingerprints": fingerprints.op10_fingerprints,
    "op11_centroid_clustering": centroid_clustering.op11_centroid_clustering,
    "op12_vector_codes": vector_codes.op12_vector_codes,
    "op13_token_counts": token_counts.op13_token_counts,
}

LLM_SQL: dict[str, str] = {
    "op1_ngram_jaccard_join": jaccard_join.SQL,
    "op5_line_dedup": line_dedup.SQL,
    "op6_url_filters": url_filter.SQL,
    "op11_centroid_clustering": centroid_clustering.SQL,
    "op12_vector_codes": vector_codes.SQL,
}
