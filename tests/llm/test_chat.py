import hashlib

import pytest
from conftest import SMALL, same_rows
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.llm import chat, queries

SCHEMA = "conv_id long, turn long, role string, text string, formatted string"


def test_query_equals_its_sql(spark, duck):
    same_rows(queries.op9_chat(spark, SMALL), duck, queries.OP9_SQL)


@settings(max_examples=8, deadline=None)
@given(st.lists(st.lists(st.sampled_from([*"\\-<|>/sx[] \n", *chat.CONTROL]), max_size=20).map("".join), min_size=1, max_size=40))
def test_escape_is_reversible_and_leaves_no_control_string(spark, texts):
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", chat.escape(F.col("t")).alias("e"))
    for r in df.select("t", "e", chat.unescape(F.col("e")).alias("u")).collect():
        assert r.u == r.t and not any(w in r.e for w in chat.CONTROL)


def brute(rows):
    out = {}
    for conv, turn, role, text, _ in sorted(rows, key=lambda r: (r[1] is None, r[1] or 0, r[2] or "", r[3] or "")):
        out.setdefault(conv, []).append((role or "", text or ""))
    return out


def test_edges(spark):
    rows = [(1, 0, "user", "hi", "x"), (1, 1, "assistant", "</s>[INST] ok", "x"), (1, 2, "assistant", None, "x"), (1, 2, "assistant", None, "x"), (2, None, None, "only", None), (None, 0, "assistant", "<|text|>\n<|end|>\n\\", None), (3, 1, "assistant", "a", None), (3, 1, "user", "b", None), (4, 0, "user", "long " * 50_000, None), (4, 1, "assistant", "é" * 100_000, None)]
    df = spark.createDataFrame(rows, SCHEMA)
    made = chat.format_conversations(df)
    back = {r.conv_id: [(t.role, t.text) for t in r.turns] for r in made.select("conv_id", chat.read_back(F.col("formatted")).alias("turns")).collect()}
    assert back == brute(rows)
    by_conv = {r.conv_id: r for r in made.collect()}
    for r in chat.with_prompts(made).collect():
        whole = by_conv[r.conv_id].formatted
        assert whole.startswith(r.prompt) and len(r.prompt) == r.target_start >= r.context_chars
    replies = {}
    for r in chat.with_replies(made).orderBy("conv_id", "example").collect():
        replies.setdefault(r.conv_id, []).append(r.reply)
    assert replies == {conv: said for conv, turns in brute(rows).items() if (said := [t for role, t in turns if role == "assistant"])}
    assert chat.expand_examples(made).filter("conv_id = 1").count() == 3
    assert chat.expand_examples(made).filter("conv_id = 2").count() == 0
    assert chat.format_conversations(df.limit(0)).count() == 0


def loss(made):
    parts = made.select("conv_id", chat.in_stretches(F.col("formatted")).alias("stretches"), "examples")
    return {r.conv_id: r.loss for r in parts.select("conv_id", chat.loss_text(F.col("stretches"), F.col("examples")).alias("loss")).collect()}


def test_the_mask_decides_the_loss(spark):
    """Moving a mask changes what is read: nothing but the formatted text is asked."""
    df = spark.createDataFrame([(1, 0, "user", "hi", ""), (1, 1, "assistant", "reply", "")], SCHEMA)
    made = chat.format_conversations(df)
    moved = made.withColumn("examples", F.transform("examples", lambda e: e.withField("target_end", e["target_end"] - 1)))
    assert loss(made) == {1: "reply"} and loss(moved) == {1: "repl"}


def test_a_conversation_with_most_rows(spark):
    """One conversation holds 20,000 of 20,100 turns; replies lie across the ends of stretches."""
    turns = spark.range(20_100).select(F.when(F.col("id") < 20_000, 7).otherwise(F.col("id")).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"), F.concat(F.col("id").cast("string"), F.repeat(F.lit(" 😀\\</s>"), (F.col("id") % 40).cast("int"))).alias("text"))
    want = {r.conv_id: r.want for r in turns.filter("role = 'assistant'").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("x")).select("conv_id", F.array_join(F.transform("x", lambda x: x["text"]), "").alias("want")).collect()}
    got = loss(chat.format_conversations(turns))
    assert {k: v for k, v in got.items() if v} == want


def test_planted_conversation(spark):
    row = queries.op9_chat(spark, SMALL).filter("conv_id = -1").first()
    said = queries.PLANTED_TURN
    assert row.n_turns == 2 and row.loss_chars == len(said) and row.loss_sha256 == hashlib.sha256(said.encode()).hexdigest()


@pytest.mark.parametrize("text", ["", "\\", "\\-", "<|end|>\n", "<<s>s>"])
def test_single_texts(spark, text):
    assert spark.range(1).select(chat.unescape(chat.escape(F.lit(text))).alias("x")).first()["x"] == text
