"""Chat formatting by prefix-target expansion.

Every assistant turn becomes an example of its own: the turns before it are context, and only
that reply is trainable.  Examples point into the one formatted conversation: how many of its
characters are context, and the mask, where the reply begins and ends.  So a conversation with n
turns costs n pointers and not n**2 pieces; ``with_prompts`` and ``with_replies`` cut the context
and the masked text out where they are wanted.

Template of a turn: ``<|turn|>role<|text|>text<|end|>`` and a line feed.  Inside roles and texts
a backslash is doubled and every control string gets a backslash and a hyphen after its first
character; ``unescape`` undoes both.

Null roles and texts count as empty.  Rows go by turn, then role, then text; null turns come
last.  Repeated rows are turns of their own.  A null conv_id is a conversation like any other.
A conversation without an assistant turn has no examples.  DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
#: Strings that the template or common chat templates use as control strings.
CONTROL = (TURN, TEXT, END, "<s>", "</s>", "[INST]", "[/INST]", "<|im_start|>", "<|im_end|>", "<|endoftext|>")
TRAINABLE_ROLE = "assistant"
#: Characters of a stretch, in which masked text is looked up.
STRETCH = 8192


def escape(text: Column) -> Column:
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for word in CONTROL:
        out = F.replace(out, F.lit(word), F.lit(f"{word[0]}\\-{word[1:]}"))
    return out


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"\\(?:(\\)|-)", "$1")


def format_conversations(df: DataFrame) -> DataFrame:
    """One row per conversation of ``df`` (conv_id, turn, role, text): ``conv_id``,
    ``formatted`` and ``examples``, an array of (example from 0, context_chars, target_start,
    target_end): offsets into ``formatted`` in characters, end exclusive."""
    by_turn = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_last(), "role", "text")
    before = by_turn.rowsBetween(Window.unboundedPreceding, -1)
    rows = df.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("nth", F.row_number().over(by_turn)).withColumns({"head": F.concat(F.lit(TURN), escape(F.col("role")), F.lit(TEXT)), "body": escape(F.col("text"))})
    rows = rows.withColumn("piece", F.concat("head", "body", F.lit(f"{END}\n"))).withColumn("at", F.coalesce(F.sum(F.length("piece")).over(before), F.lit(0)))
    target = F.struct("nth", F.col("at").alias("context_chars"), (F.col("at") + F.length("head")).alias("target_start"), (F.col("at") + F.length("head") + F.length("body")).alias("target_end"))
    whole = rows.groupBy("conv_id").agg(
        F.array_sort(F.collect_list(F.struct("nth", "piece"))).alias("pieces"),
        F.array_sort(F.collect_list(F.when(F.col("role") == TRAINABLE_ROLE, target))).alias("targets"),
    )
    return whole.select(
        "conv_id",
        F.array_join(F.transform("pieces", lambda p: p["piece"]), "").alias("formatted"),
        F.transform("targets", lambda t, i: F.struct(i.alias("example"), t["context_chars"].alias("context_chars"), t["target_start"].alias("target_start"), t["target_end"].alias("target_end"))).alias("examples"),
    )


def expand_examples(formatted: DataFrame) -> DataFrame:
    """One row per assistant turn of ``format_conversations``' result."""
    return formatted.select("conv_id", F.explode("examples").alias("e")).select("conv_id", "e.*")


def with_prompts(formatted: DataFrame) -> DataFrame:
    """``expand_examples`` with ``prompt`` (all that precedes the reply) written out."""
    one = formatted.select("conv_id", "formatted", F.explode("examples").alias("e"))
    return one.select("conv_id", "e.*", F.substring("formatted", F.lit(1), F.col("e.target_start").cast("int")).alias("prompt"))


def in_stretches(formatted: Column) -> Column:
    """A text as an array of stretches of ``STRETCH`` characters, so that a place far inside is reached
    without reading all that precedes it."""
    return F.regexp_extract_all(formatted, F.lit(f"(?s).{{1,{STRETCH}}}"), F.lit(0))


def masked(stretches: Column, example: Column) -> Column:
    """What the mask of an example leaves of a formatted conversation, as it stands there."""
    begin, end = example["target_start"], example["target_end"]
    first, last = F.floor(begin / STRETCH).cast("int"), F.floor(end / STRETCH).cast("int")
    covered = F.when(first == last, F.get(stretches, first)).otherwise(F.array_join(F.slice(stretches, first + 1, last - first + 1), ""))
    return F.substring(covered, (begin - first * STRETCH + 1).cast("int"), (end - begin).cast("int"))


def with_replies(formatted: DataFrame) -> DataFrame:
    """``expand_examples`` with ``reply``, the masked text unescaped."""
    one = formatted.select("conv_id", in_stretches(F.col("formatted")).alias("stretches"), "examples").select("conv_id", "stretches", F.explode("examples").alias("e"))
    return one.select("conv_id", "e.*", unescape(masked(F.col("stretches"), F.col("e"))).alias("reply"))


def loss_text(stretches: Column, examples: Column) -> Column:
    """All text under the loss masks of a conversation, in order, unescaped."""
    return F.array_join(F.transform(examples, lambda e: unescape(masked(stretches, e))), "")


def read_back(formatted: Column) -> Column:
    """The turns of a formatted conversation: array of (role, text), unescaped."""
    pieces = F.filter(F.split(formatted, r"<\|end\|>\n", -1), lambda p: p != "")
    return F.transform(pieces, lambda p: F.struct(
        unescape(F.substr(F.split_part(p, F.lit(TEXT), F.lit(1)), F.lit(len(TURN) + 1))).alias("role"),
        unescape(F.split_part(p, F.lit(TEXT), F.lit(2))).alias("text"),
    ))
