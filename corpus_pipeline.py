"""The corpus pipeline: stages of alignspark.llm, each written as Parquet and reread as the next one's documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from alignspark.llm.common import stored, table
from alignspark.llm.language import language_stage
from alignspark.llm.line_dedup import line_dedup_stage
from alignspark.llm.ngram_join import ngram_stage
from alignspark.llm.packing import packing_stage
from alignspark.llm.pii import pii_stage

STAGES = [
    ("language", language_stage),
    ("line_dedup", line_dedup_stage),
    ("ngram_join", ngram_stage),
    ("pii", pii_stage),
    ("packing", packing_stage),
]

#: Trained and iterative stages can't be put in SQL; tests/llm/test_pipeline.py holds the rows against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
