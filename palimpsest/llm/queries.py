"""Queries of the training-data operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from palimpsest.llm.decontaminate import op9_decontamination
from palimpsest.llm.lines import op1_line_dedup
from palimpsest.llm.media import op10_media_columns
from palimpsest.llm.mixing import op2_mixing
from palimpsest.llm.neardup import op7_near_dedup
from palimpsest.llm.oracles import sql
from palimpsest.llm.quality import op4_quality
from palimpsest.llm.substrings import op6_suffix_dedup
from palimpsest.llm.tokens import op5_token_output
from palimpsest.llm.toxicity import op3_toxicity
from palimpsest.llm.urls import op8_url_filters


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (
        op1_line_dedup,
        op2_mixing,
        op3_toxicity,
        op4_quality,
        op5_token_output,
        op6_suffix_dedup,
        op7_near_dedup,
        op8_url_filters,
        op9_decontamination,
        op10_media_columns,
    )
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return sql()
