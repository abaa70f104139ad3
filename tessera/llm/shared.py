"""Helpers that several operators use."""

from __future__ import annotations

from pyspark.sql import SparkSession

from tessera.operators.durable import broadcast_if_small, materialize, scratch, shared_folder
from tessera.shipping import ship

__all__ = ["broadcast_if_small", "free_name", "materialize", "parallelism", "scratch", "shared_folder", "ship"]


def parallelism(spark: SparkSession) -> int:
    """Partitions for exchanges whose number this library chooses."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def free_name(taken: list[str], wanted: str) -> str:
    """``wanted``, or the first name after it that no column of the input has (case-insensitive)."""
    lower = {name.lower() for name in taken}
    name, n = wanted, 1
    while name.lower() in lower:
        n += 1
        name = f"{wanted}_{n}"
    return name
