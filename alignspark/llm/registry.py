"""Queries and SQL of this subpackage."""

from __future__ import annotations

from importlib import import_module

MODULES = ("ann", "pii", "line_dedup", "ngram_join", "language", "html_text", "embedding_dedup", "lm_score", "packing", "pieces", "merkle", "toxicity", "periods")


def _merged(name: str) -> dict:
    out: dict = {}
    for module in MODULES:
        out |= getattr(import_module(f"alignspark.llm.{module}"), name)
    return out


def queries() -> dict:
    return _merged("QUERIES")


def sql() -> dict:
    return _merged("SQL")
