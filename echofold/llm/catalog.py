"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from echofold.llm import op1_decontaminate, op2_packing, op3_near_dedup, op4_quality, op5_fingerprint, op6_language, op7_warc, op8_license_scan, op9_toxicity, op10_url_filter


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_decontaminate": op1_decontaminate.op1_decontaminate,
        "op2_packing": op2_packing.op2_packing,
        "op3_near_dedup": op3_near_dedup.op3_near_dedup,
        "op4_quality": op4_quality.op4_quality,
        "op5_fingerprint": op5_fingerprint.op5_fingerprint,
        "op6_language": op6_language.op6_language,
        "op7_warc": op7_warc.op7_warc,
        "op8_license_scan": op8_license_scan.op8_license_scan,
        "op9_toxicity": op9_toxicity.op9_toxicity,
        "op10_url_filter": op10_url_filter.op10_url_filter,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_decontaminate": op1_decontaminate.ORACLE,
        "op3_near_dedup": op3_near_dedup.ORACLE,
        "op7_warc": op7_warc.ORACLE,
        "op8_license_scan": op8_license_scan.ORACLE,
        "op10_url_filter": op10_url_filter.ORACLE,
    }
