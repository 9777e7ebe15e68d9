"""The queries of the corpus operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import (
    fill_in_middle, filter_audit, lm, lz_fingerprint, mixing, pii, quality, quality_classifier, secrets, sentencepiece_viterbi,
    sharding, simhash, token_output,
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality": quality.op1_quality,
    "op2_mixing": mixing.op2_mixing,
    "op3_token_output": token_output.op3_token_output,
    "op4_lz_fingerprint": lz_fingerprint.op4_lz_fingerprint,
    "op5_sentencepiece": sentencepiece_viterbi.op5_sentencepiece,
    "op6_pii": pii.op6_pii,
    "op7_lm": lm.op7_lm,
    "op8_sharding": sharding.op8_sharding,
    "op9_secrets": secrets.op9_secrets,
    "op10_simhash": simhash.op10_simhash,
    "op11_filter_audit": filter_audit.op11_filter_audit,
    "op12_fill_in_middle": fill_in_middle.op12_fill_in_middle,
    "op13_quality_classifier": quality_classifier.op13_quality_classifier,
}

ORACLES: dict[str, str] = {
    "op1_quality": quality.ORACLE_OP1,
    "op2_mixing": mixing.ORACLE_OP2,
    "op8_sharding": sharding.ORACLE_OP8,
    "op11_filter_audit": filter_audit.ORACLE_OP11,
    "op12_fill_in_middle": fill_in_middle.ORACLE_OP12,
}
