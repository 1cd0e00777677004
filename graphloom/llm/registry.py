"""Queries and SQL of this subpackage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import best_fit, chat_format, collocations, exact_dedup, merkle, mixing, packing, personal_data, quality, secret_scan, simhash, token_rollup, toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_divergence": quality.op1,
    "op2_token_rollup": token_rollup.op2,
    "op3_personal_data": personal_data.op3,
    "op4_chat_format": chat_format.op4,
    "op5_mixing": mixing.op5,
    "op6_secret_scan": secret_scan.op6,
    "op7_toxicity": toxicity.op7,
    "op8_exact_dedup": exact_dedup.op8,
    "op9_simhash_near_dedup": simhash.op9,
    "op10_packing": packing.op10,
    "op11_collocations": collocations.op11,
    "op12_merkle_manifest": merkle.op12,
    "op13_best_fit_packing": best_fit.op13,
}

ORACLE_SQL: dict[str, str] = {
    "op1_quality_divergence": quality.OP1_SQL,
    "op8_exact_dedup": exact_dedup.OP8_SQL,
    "op11_collocations": collocations.OP11_SQL,
    "op12_merkle_manifest": merkle.OP12_SQL,
}
