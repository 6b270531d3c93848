"""The corpus pipeline: five stages from raw documents to token ids, each written and reread."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidyshelf.llm.bpe import encode_stage
from tidyshelf.llm.jaccard import near_stage
from tidyshelf.llm.language import language_stage
from tidyshelf.llm.lines import line_stage
from tidyshelf.llm.mixing import mixing_stage
from tidyshelf.session import shared_path

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

STAGES: list[tuple[str, Stage]] = [
    ("language_id", language_stage),
    ("line_dedup", line_stage),
    ("near_duplicates", near_stage),
    ("source_mixing", mixing_stage),
    ("byte_bpe", encode_stage),
]

#: The language network and the ids of the merges have no SQL; tests compare the stages with brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``; each result is a table in the shared folder that the next one reads."""
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for name, stage in STAGES:
        path = shared_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
