"""Queries of the training-data operators, by name, and SQL for those that SQL can express."""

from __future__ import annotations

from . import decontaminate, licenses, near_dup, packing, quality, sharding, substring_dedup, token_counts, toxicity, vptree

QUERIES = {
    "op1_best_fit_packing": packing.op1,
    "op2_toxicity": toxicity.op2,
    "op3_benchmark_decontamination": decontaminate.op3,
    "op4_vantage_point_search": vptree.op4,
    "op5_minhash_near_dedup": near_dup.op5,
    "op6_substring_dedup": substring_dedup.op6,
    "op7_quality_classifier": quality.op7,
    "op8_extendible_sharding": sharding.op8,
    "op9_token_counts": token_counts.op9,
    "op10_license_scan": licenses.op10,
}

ORACLE_SQL = {
    "op3_benchmark_decontamination": decontaminate.OP3_SQL,
    "op8_extendible_sharding": sharding.OP8_SQL,
    "op10_license_scan": licenses.OP10_SQL,
}
