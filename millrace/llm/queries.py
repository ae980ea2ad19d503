"""The queries of this subpackage and their SQL, for the registry."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from millrace.llm import bpe, decontaminate, licenses, lines, parsing, passages, quality, simhash, urls, wrappers

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_html_text": wrappers.op1_html_text,
    "op2_line_dedup": lines.op2_line_dedup,
    "op3_fingerprints": parsing.op3_fingerprints,
    "op4_byte_bpe": bpe.op4_byte_bpe,
    "op5_url_filter": urls.op5_url_filter,
    "op6_license_scan": licenses.op6_license_scan,
    "op7_quality": quality.op7_quality,
    "op8_simhash_groups": simhash.op8_simhash_groups,
    "op9_decontamination": decontaminate.op9_decontamination,
    "op10_substring_dedup": passages.op10_substring_dedup,
    "pipeline": corpus_pipeline.run,
}
ORACLES: dict[str, str] = {"op5_url_filter": urls.ORACLE_SQL, "op6_license_scan": licenses.ORACLE_SQL}
