"""The queries of this subpackage and their SQL, by name."""

from __future__ import annotations

from provena.llm import byte_dedup, exact_dedup, fingerprints, html_text, mixing, near_dedup, packing, quality, secrets, substring_dedup


def queries() -> dict:
    return {
        "op1_secret_scan": secrets.op1_secret_scan,
        "op2_substring_dedup": substring_dedup.op2_substring_dedup,
        "op3_exact_dedup": exact_dedup.op3_exact_dedup,
        "op4_mix_to_targets": mixing.op4_mix_to_targets,
        "op5_pack": packing.op5_pack,
        "op6_byte_dedup": byte_dedup.op6_byte_dedup,
        "op7_main_text": html_text.op7_main_text,
        "op8_quality": quality.op8_quality,
        "op9_fingerprint": fingerprints.op9_fingerprint,
        "op10_near_dedup": near_dedup.op10_near_dedup,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_secret_scan": secrets.OP1_SQL, "op2_substring_dedup": substring_dedup.OP2_SQL, "op3_exact_dedup": exact_dedup.OP3_SQL, "op6_byte_dedup": byte_dedup.OP6_SQL, "op10_near_dedup": near_dedup.OP10_SQL}
