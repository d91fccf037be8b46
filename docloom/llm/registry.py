"""Queries of this subpackage and, where SQL can express them, their SQL."""

from docloom.llm import alignment, best_fit, centroids, exact_dedup, language_id, lm_scoring, mixing, packing, quality, simhash, suffix_dedup, url_filter, vptree

QUERIES = {
    "op1_suffix_dedup": suffix_dedup.op1_suffix_dedup,
    "op2_mixing": mixing.op2_mixing,
    "op3_vptree": vptree.op3_vptree,
    "op4_lm_scoring": lm_scoring.op4_lm_scoring,
    "op5_simhash": simhash.op5_simhash,
    "op6_packing": packing.op6_packing,
    "op7_exact_dedup": exact_dedup.op7_exact_dedup,
    "op8_language_id": language_id.op8_language_id,
    "op9_url_filter": url_filter.op9_url_filter,
    "op10_quality": quality.op10_quality,
    "op11_alignment": alignment.op11_alignment,
    "op12_best_fit": best_fit.op12_best_fit,
    "op13_centroids": centroids.op13_centroids,
}
ORACLE_SQL = {
    "op1_suffix_dedup": suffix_dedup.OP1_SQL,
    "op3_vptree": vptree.OP3_SQL,
    "op7_exact_dedup": exact_dedup.OP7_SQL,
    "op9_url_filter": url_filter.OP9_SQL,
    "op13_centroids": centroids.OP13_SQL,
}
