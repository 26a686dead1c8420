"""Registered queries of the training-data operators, and DuckDB SQL where it can express them."""

import corpus_pipeline

from . import bpe, exact_dedup, licenses, near_dedup, packing, quality_model, quality_rules, substring_dedup, token_counts, toxicity

QUERIES = {
    "op1_token_counts": token_counts.op1_token_counts,
    "op2_near_dedup": near_dedup.op2_near_dedup,
    "op3_substring_dedup": substring_dedup.op3_substring_dedup,
    "op4_bpe": bpe.op4_bpe,
    "op5_exact_dedup": exact_dedup.op5_exact_dedup,
    "op6_quality_model": quality_model.op6_quality_model,
    "op7_license_scan": licenses.op7_license_scan,
    "op8_quality_rules": quality_rules.op8_quality_rules,
    "op9_toxicity": toxicity.op9_toxicity,
    "op10_packing": packing.op10_packing,
    "pipeline": corpus_pipeline.run,
}
SQL = {
    "op5_exact_dedup": exact_dedup.OP5_SQL,
    "op7_license_scan": licenses.OP7_SQL,
    "op8_quality_rules": quality_rules.OP8_SQL,
}
if corpus_pipeline.ORACLE_SQL:
    SQL["pipeline"] = corpus_pipeline.ORACLE_SQL
