"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from . import decontaminate, exact_dedup, language_id, licenses, near_dedup, packing, pii, suffix_dedup, toxicity, url_filter


def queries() -> dict:
    return {
        "op1_best_fit_packing": packing.op1_best_fit_packing,
        "op2_decontaminate": decontaminate.op2_decontaminate,
        "op3_license_scan": licenses.op3_license_scan,
        "op4_exact_dedup": exact_dedup.op4_exact_dedup,
        "op5_language_id": language_id.op5_language_id,
        "op6_toxicity": toxicity.op6_toxicity,
        "op7_url_filter": url_filter.op7_url_filter,
        "op8_suffix_array_dedup": suffix_dedup.op8_suffix_array_dedup,
        "op9_minhash_near_dedup": near_dedup.op9_minhash_near_dedup,
        "op10_pii": pii.op10_pii,
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_decontaminate": decontaminate.OP2_SQL, "op3_license_scan": licenses.OP3_SQL, "op4_exact_dedup": exact_dedup.OP4_SQL, "op8_suffix_array_dedup": suffix_dedup.OP8_SQL}
