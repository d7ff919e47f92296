"""Scoring of a stream of pairs: row by row, without state, so late rows and restarts need nothing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import DataStreamWriter

from alignspark.operators.scoring import Parameters, score


def score_stream(pairs: DataFrame, model: Parameters, best: bool = False, keep: list[str] | None = None) -> DataFrame:
    if not pairs.isStreaming:
        raise ValueError("pairs isn't a stream; use operators.scoring.score")
    return score(pairs, model, best, keep)


def scored_to(pairs: DataFrame, model: Parameters, path: str, checkpoint: str) -> DataStreamWriter:
    """A writer that scores what has come and appends it to Parquet files."""
    return score_stream(pairs, model).writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True)
