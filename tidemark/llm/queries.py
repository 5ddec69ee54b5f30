"""The queries of the subpackage, by name, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import url_filter
from tidemark.llm.decontamination import op6_decontamination
from tidemark.llm.language_model import op5_language_model
from tidemark.llm.license_scan import op2_licenses
from tidemark.llm.line_dedup import op9_line_dedup
from tidemark.llm.quality_rules import op10_quality
from tidemark.llm.sentencepiece_codec import op1_sentencepiece
from tidemark.llm.simhash import op8_simhash
from tidemark.llm.token_packing import op3_token_packing
from tidemark.llm.toxicity import op4_toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_sentencepiece": op1_sentencepiece,
    "op2_licenses": op2_licenses,
    "op3_token_packing": op3_token_packing,
    "op4_toxicity": op4_toxicity,
    "op5_language_model": op5_language_model,
    "op6_decontamination": op6_decontamination,
    "op7_url_filter": url_filter.op7_url_filter,
    "op8_simhash": op8_simhash,
    "op9_line_dedup": op9_line_dedup,
    "op10_quality": op10_quality,
}

ORACLES: dict[str, str] = {
    "op7_url_filter": url_filter.ORACLE,
}
