"""Collects the queries of all plan modules."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessera.plans import q_answer, q_chunk, q_ingest, q_more, q_retrieve, q_scope, q_text

MODULES = [q_text, q_scope, q_chunk, q_retrieve, q_ingest, q_answer, q_more]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: build for module in MODULES for name, build in module.queries().items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for module in MODULES for name, sql in module.oracle_sql().items()}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queries()["R04_bm25_top_k"](spark, sf_dir)
