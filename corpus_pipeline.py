"""The corpus pipeline: toxicity, near-duplicates, decontamination, mixing, token output.

Each stage takes the documents that its predecessor kept, written as Parquet and read again, and returns documents with the same columns; the
last returns one row for each document in the token files. A stage deletes the working tables of the stage before, whose result is written by then.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from palimpsest.llm.common import Workspace, stage_tables
from palimpsest.llm.decontaminate import decontaminate
from palimpsest.llm.mixing import mix
from palimpsest.llm.neardup import keep_one
from palimpsest.llm.tokens import token_digests
from palimpsest.llm.toxicity import drop_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the model rejects go."""
    with stage_tables(spark):
        return drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays: that of the smallest doc_id."""
    with stage_tables(spark):
        return keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark passages go from the texts; documents that are mostly benchmark go."""
    with stage_tables(spark):
        return decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources in the proportions of their weights; a document taken twice stands twice."""
    with stage_tables(spark):
        return mix(docs)


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packed token files, read back."""
    with stage_tables(spark):
        return token_digests(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxicity),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("mixing", mixing),
    ("token_output", token_output),
]

#: SQL can express neither the trees nor the tokenizer; the stages are tested one by one and together.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    ws, before = Workspace(spark), None
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = ws.stage(stage(spark, docs, sf_dir), name)
        ws.drop(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
