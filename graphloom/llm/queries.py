"""Queries of this subpackage and their DuckDB SQL, by name."""

from __future__ import annotations

from . import (
    license_scan,
    packing,
    pii,
    quality_classifier,
    quality_rules,
    secret_scan,
    sentencepiece_codec,
    simhash,
    toxicity,
    winnowing,
)


def queries() -> dict:
    return {
        "op1_best_fit_packing": packing.op1_best_fit_packing,
        "op2_license_scan": license_scan.op2_license_scan,
        "op3_secret_scan": secret_scan.op3_secret_scan,
        "op4_winnowing": winnowing.op4_winnowing,
        "op5_quality_classifier": quality_classifier.op5_quality_classifier,
        "op6_simhash_dedup": simhash.op6_simhash_dedup,
        "op7_pii": pii.op7_pii,
        "op8_sentencepiece": sentencepiece_codec.op8_sentencepiece,
        "op9_toxicity": toxicity.op9_toxicity,
        "op10_quality_rules": quality_rules.op10_quality_rules,
    }


def oracle_sql() -> dict[str, str]:
    return {"op10_quality_rules": quality_rules.ORACLE}
