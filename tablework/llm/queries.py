"""The package's registered queries and their DuckDB SQL."""

from __future__ import annotations

from tablework.llm import (
    centroid_clusters, decontaminate, language_id, license_scan, ngram_join, pii, sentence_pieces, substring_dedup, token_counts,
    toxicity, vector_join, warc, whitening,
)

QUERIES = {
    "op1_ngram_jaccard": ngram_join.query,
    "op2_toxicity": toxicity.query,
    "op3_vector_join": vector_join.query,
    "op4_decontaminate": decontaminate.query,
    "op5_token_counts": token_counts.query,
    "op6_sentence_pieces": sentence_pieces.query,
    "op7_license_scan": license_scan.query,
    "op8_personal_data": pii.query,
    "op9_language_id": language_id.query,
    "op10_warc": warc.query,
    "op11_whitening": whitening.query,
    "op12_substring_dedup": substring_dedup.query,
    "op13_centroid_clusters": centroid_clusters.query,
}

ORACLES: dict[str, str] = {
    "op13_centroid_clusters": centroid_clusters.oracle(),
}
