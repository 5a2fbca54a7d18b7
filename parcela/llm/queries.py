"""The queries of this subpackage by name, and their SQL where SQL can express them."""

from __future__ import annotations

from . import exact_dedup, fingerprint, hard_negatives, language_id, line_dedup, mixing, near_dedup, packing, sharding, token_output, toxicity, url_filter

QUERIES = {
    "op1_near_dedup": near_dedup.query,
    "op2_mixing": mixing.query,
    "op3_sharding": sharding.query,
    "op4_url_filter": url_filter.query,
    "op5_exact_dedup": exact_dedup.query,
    "op6_toxicity": toxicity.query,
    "op7_line_dedup": line_dedup.query,
    "op8_fingerprint": fingerprint.query,
    "op9_best_fit_packing": packing.query,
    "op10_token_output": token_output.query,
    "op11_hard_negatives": hard_negatives.query,
    "op12_language_id": language_id.query,
}

SQL = {"op1_near_dedup": near_dedup.SQL, "op4_url_filter": url_filter.SQL, "op5_exact_dedup": exact_dedup.SQL, "op7_line_dedup": line_dedup.SQL, "op11_hard_negatives": hard_negatives.SQL}
