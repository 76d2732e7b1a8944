"""Queries and SQL of the training-data operators and of the pipeline."""

from __future__ import annotations

import importlib

import corpus_pipeline

MODULES = ["toxicity", "url_filter", "syncmers", "bpe", "packing", "simhash", "quality_rules", "quality_classifier", "line_dedup", "suffix_dedup", "anchors", "alignment", "centroids"]


def queries() -> dict:
    out: dict = {}
    for m in MODULES:
        out |= importlib.import_module(f"corvane.llm.{m}").QUERIES
    return out | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    out: dict = {}
    for m in MODULES:
        out |= importlib.import_module(f"corvane.llm.{m}").ORACLE
    return out
