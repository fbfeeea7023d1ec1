"""Queries of the training-data operators, with SQL where SQL can express one."""

from __future__ import annotations

from . import brown_lm, chroma, conversations, decontamination, hard_negatives, licenses, line_dedup, mixing, near_dedup, pii, quality, sharding, toxicity


def queries() -> dict:
    return {
        "op1_bfd_sharding": sharding.query,
        "op2_toxicity_lexicon": toxicity.query,
        "op3_brown_lm_scoring": brown_lm.query,
        "op4_fuzzy_line_dedup": line_dedup.query,
        "op5_benchmark_decontamination": decontamination.query,
        "op6_temperature_mixing": mixing.query,
        "op7_pii_semi_crf": pii.query,
        "op8_minhash_near_dedup": near_dedup.query,
        "op9_license_scan": licenses.query,
        "op10_chroma_fingerprints": chroma.query,
        "op11_conversation_repair": conversations.query,
        "op12_quality_crf": quality.query,
        "op13_hard_negatives": hard_negatives.query,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op5_benchmark_decontamination": decontamination.ORACLE_SQL,
        "op8_minhash_near_dedup": near_dedup.ORACLE_SQL,
        "op13_hard_negatives": hard_negatives.ORACLE_SQL,
    }
