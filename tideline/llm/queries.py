"""The queries of this subpackage and their SQL, by name."""

from __future__ import annotations

from tideline.llm import decontaminate, langid, licenses, lm, neardup, pieces, pii, quality, tokenids, urls

QUERIES = {
    "op1_minhash_near_dedup": neardup.query,
    "op2_language_id": langid.query,
    "op3_pii_surrogates": pii.query,
    "op4_token_ids": tokenids.query,
    "op5_lm_scoring": lm.query,
    "op6_url_filter": urls.query,
    "op7_benchmark_decontamination": decontaminate.query,
    "op8_license_scan": licenses.query,
    "op9_sentencepiece": pieces.query,
    "op10_quality_rules": quality.query,
}
ORACLE: dict[str, str] = {
    "op1_minhash_near_dedup": neardup.SQL,
    "op7_benchmark_decontamination": decontaminate.SQL,
    "op10_quality_rules": quality.SQL,
}
