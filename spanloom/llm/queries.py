"""The queries of this subpackage and their SQL, for the entry module."""

from __future__ import annotations

from . import bpe, chat_format, fingerprints, line_dedup, mixing, pii, quality_rules, simhash_dedup, token_counts, toxicity


def queries() -> dict:
    return {
        "op1_chat_format": chat_format.op1_chat_format,
        "op2_quality_rules": quality_rules.op2_quality_rules,
        "op3_pii": pii.op3_pii,
        "op4_toxicity": toxicity.op4_toxicity,
        "op5_fingerprints": fingerprints.op5_fingerprints,
        "op6_line_dedup": line_dedup.op6_line_dedup,
        "op7_simhash_dedup": simhash_dedup.op7_simhash_dedup,
        "op8_token_counts": token_counts.op8_token_counts,
        "op9_bpe": bpe.op9_bpe,
        "op10_mixing": mixing.op10_mixing,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_chat_format": chat_format.OP1_SQL,
        "op6_line_dedup": line_dedup.OP6_SQL,
        "op10_mixing": mixing.OP10_SQL,
    }
