"""Incremental maintenance: what to ingest, index, keep or remove, by fingerprint.

A snapshot is (target_file, source_mtime, source_size [, config_hash]); the plan is a full outer
join of two of them, so a sync costs what changed plus one narrow join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def same_fingerprint(a_time: Column, a_size: Column, b_time: Column, b_size: Column) -> Column:
    """Equal to the bit; a missing part matches nothing."""
    return F.coalesce((a_time == b_time) & (a_size == b_size), F.lit(False))


def needs_ingest(raw: DataFrame, processed: DataFrame) -> DataFrame:
    """``raw`` (path, mtime, size) with ``ingest``: false only where content and sidecar exist and match."""
    known = processed.select("path", F.col("mtime").alias("p_mtime"), F.col("size").alias("p_size"), "has_sidecar")
    keep = F.coalesce(F.col("has_sidecar"), F.lit(False)) & same_fingerprint(F.col("mtime"), F.col("size"), F.col("p_mtime"), F.col("p_size"))
    return raw.join(known, "path", "left").select("path", (~keep).alias("ingest"))


def orphans(processed: DataFrame, raw: DataFrame, prefix: str = "") -> DataFrame:
    """Processed rows under ``prefix`` whose raw file is gone."""
    return processed.filter(F.startswith("path", F.lit(prefix))).join(raw, "path", "left_anti")


def update_plan(current: DataFrame, stored: DataFrame, *, force: bool = False) -> DataFrame:
    """(target_file, action): index, unchanged or removed.  Rows without a target_file always index."""
    now = current.select("target_file", F.col("source_mtime").alias("a_time"), F.col("source_size").alias("a_size"), F.lit(True).alias("here"))
    then = stored.select("target_file", F.col("source_mtime").alias("b_time"), F.col("source_size").alias("b_size"))
    both = now.join(then, "target_file", "full_outer")
    same = same_fingerprint(F.col("a_time"), F.col("a_size"), F.col("b_time"), F.col("b_size"))
    action = F.when(F.col("here").isNull(), "removed").when(F.lit(force) | (F.coalesce("target_file", F.lit("")) == "") | ~same, "index").otherwise("unchanged")
    return both.select("target_file", action.alias("action"))


def merged_index(old_chunks: DataFrame, plan: DataFrame, new_chunks: DataFrame) -> DataFrame:
    """Chunks of unchanged documents as they are, and those of the others as they came out anew."""
    kept = old_chunks.join(plan.filter("action = 'unchanged'").select("target_file"), "target_file", "left_semi")
    return kept.unionByName(new_chunks)


def cascade_removed(images: DataFrame, documents: DataFrame, key: str = "target_file") -> DataFrame:
    """Images whose document is gone."""
    return images.join(documents.select(key), key, "left_anti")
