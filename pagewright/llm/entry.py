"""Queries and SQL of the corpus operators, for the driver's entry module."""

from __future__ import annotations

from pagewright.llm import bpe, fingerprint, license_scan, mixing, near_dedup, outliers, pii, quality_model, toxicity, url_filter

QUERIES = {
    "op1_mix": mixing.op1_mix,
    "op2_bpe": bpe.op2_bpe,
    "op3_near_dedup": near_dedup.op3_near_dedup,
    "op4_fingerprint": fingerprint.op4_fingerprint,
    "op5_license_scan": license_scan.op5_license_scan,
    "op6_url_filter": url_filter.op6_url_filter,
    "redirected_urls": url_filter.redirected_urls,
    "op7_toxicity": toxicity.op7_toxicity,
    "op8_quality": quality_model.op8_quality,
    "op9_pii": pii.op9_pii,
    "op10_quality_rules": outliers.op10_quality_rules,
    "quality_statistics": outliers.quality_statistics,
    "edited_texts": fingerprint.edited_texts,
}

ORACLE_SQL = {
    "op1_mix": mixing.ORACLE,
    "op3_near_dedup": near_dedup.ORACLE,
    "op5_license_scan": license_scan.ORACLE,
    "op6_url_filter": url_filter.ORACLE,
    "redirected_urls": url_filter.REDIRECTED_ORACLE,
    "quality_statistics": outliers.STATISTICS_ORACLE,
    "edited_texts": fingerprint.EDITED_ORACLE,
}
