"""Chats shaped for prompts: the last question, its history, and blocks of turns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import text as X


def last_question(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, question): the last user turn that is not blank."""
    asked = turns.filter((F.col("role") == "user") & (X.strip(F.col("content")) != ""))
    return asked.groupBy("conv_id").agg(F.max("turn").alias("turn"), F.max_by("content", "turn").alias("content")).select("conv_id", "turn", X.strip(F.col("content")).alias("question"))


def history(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, role, content): non-blank user and assistant turns before the last question."""
    last = last_question(turns).select("conv_id", F.col("turn").alias("asked_at"))
    clean = turns.filter(F.col("role").isin("user", "assistant")).withColumn("content", X.strip(F.col("content"))).filter("content <> ''")
    return clean.join(last, "conv_id").filter("turn < asked_at").drop("asked_at")


def _recent(rows: DataFrame, most: int) -> DataFrame:
    order = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    return rows.withColumn("back", F.row_number().over(order)).filter(F.col("back") <= most)


def _label() -> Column:
    return F.when(F.col("role") == "user", "User").otherwise("Assistant")


def rewrite_history(rows: DataFrame, most: int = 4, cut: int = 300) -> DataFrame:
    """(conv_id, history): the last turns, one a line, assistants cut."""
    long = (F.col("role") == "assistant") & (F.length("content") > cut)
    line = F.concat(F.lit("["), _label(), F.lit("]: "), F.when(long, F.concat(F.substring("content", 1, cut), F.lit("..."))).otherwise(F.col("content")))
    ordered = F.array_sort(F.collect_list(F.struct("turn", line.alias("line"))))
    return _recent(rows, most).groupBy("conv_id").agg(F.array_join(F.transform(ordered, lambda x: x["line"]), "\n").alias("history"))


def answer_history(rows: DataFrame, conversations: DataFrame, most: int = 6, cut: int = 4000) -> DataFrame:
    """(conv_id, history) for every row of ``conversations``: the last turns as blocks, or ``(none)``."""
    own = X.strip(F.col("content"))
    body = F.when(F.length(own) > cut, F.concat(F.substring(own, 1, cut), F.lit("…(truncated)"))).otherwise(own)
    block = F.concat(F.lit("["), _label(), F.lit("]:\n"), body)
    ordered = F.array_sort(F.collect_list(F.struct("turn", block.alias("block"))))
    made = _recent(rows, most).groupBy("conv_id").agg(F.array_join(F.transform(ordered, lambda x: x["block"]), "\n\n").alias("history"))
    return conversations.select("conv_id").distinct().join(made, "conv_id", "left").select("conv_id", F.coalesce("history", F.lit("(none)")).alias("history"))
