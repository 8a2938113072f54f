"""The queries of the training-data operators and their DuckDB SQL."""

from __future__ import annotations

from litmine.llm import (
    decontamination,
    exact_dedup,
    hard_negatives,
    license_scans,
    line_dedup,
    merkle_manifest,
    mixing,
    near_dups,
    quality_rules,
    secret_scans,
    sharding,
    token_counts,
    url_filters,
)

QUERIES = {
    "op1_quality_rules": quality_rules.op1_quality_rules,
    "op2_near_duplicates": near_dups.op2_near_duplicates,
    "op3_url_filters": url_filters.op3_url_filters,
    "op4_sharding": sharding.op4_sharding,
    "op5_secret_scans": secret_scans.op5_secret_scans,
    "op6_benchmark_decontamination": decontamination.op6_benchmark_decontamination,
    "op7_source_mixing": mixing.op7_source_mixing,
    "op8_license_scans": license_scans.op8_license_scans,
    "op9_line_dedup": line_dedup.op9_line_dedup,
    "op10_token_counts": token_counts.op10_token_counts,
    "op11_exact_dedup": exact_dedup.op11_exact_dedup,
    "op12_hard_negatives": hard_negatives.op12_hard_negatives,
    "op13_merkle_manifest": merkle_manifest.op13_merkle_manifest,
}
ORACLES = {
    "op1_quality_rules": quality_rules.OP1_SQL,
    "op2_near_duplicates": near_dups.OP2_SQL,
    "op4_sharding": sharding.OP4_SQL,
    "op6_benchmark_decontamination": decontamination.OP6_SQL,
    "op8_license_scans": license_scans.OP8_SQL,
    "op11_exact_dedup": exact_dedup.OP11_SQL,
    "op12_hard_negatives": hard_negatives.OP12_SQL,
}
