"""Packed postings: what they hold, that a search equals scoring everything, and what it skips."""

import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from conftest import SMALL
from pyspark.sql import functions as F

from tessera.operators import index as I
from tessera.operators import postings as P
from tessera.operators import retrieve as R
from tessera.schema import RETRIEVAL

TOKEN = re.compile(r"[^\W_]+|[_&]+")
CHUNKS = "chunk_key long, pos string, project string, build string, content string"


def shard_of(texts, avgdl):
    """A packed shard of ``texts`` (lists of tokens), and for each place the text there."""
    n = len(texts)
    table = pa.table({"project": ["p"] * n, "build": ["b"] * n, "shard": pa.array([0] * n, pa.int64()), "key": pa.array(range(n), pa.int64()), "pos": pa.array([f"{i:05d}" for i in range(n)]), "tokens": pa.array(texts, pa.list_(pa.string()))})
    made = P.pack_shard(table)
    rows = dict(zip(made.column("token").to_pylist(), made.column("packed").to_pylist(), strict=True))
    me = made.column("token").to_pylist().index("")
    keys = made.column("keys").to_pylist()[me]
    lengths = np.frombuffer(rows.pop(""), "<i4")
    assert lengths.tolist() == [len(texts[i]) for i in keys] and made.column("total").to_pylist()[me] == sum(map(len, texts))
    return P.Shard(lengths, {t: P.Postings.read(x) for t, x in rows.items()}, avgdl, RETRIEVAL), keys, rows


def plain_scores(texts, asked, avgdl):
    out = {}
    for i, tokens in enumerate(texts):
        counts = Counter(tokens)
        if any(t in counts for t, _ in asked):
            out[i] = round(sum(w * float(P.impact(np.array(float(counts[t])), np.array(float(len(tokens))), avgdl, RETRIEVAL)) for t, w in asked if t in counts), P.DIGITS)
    return out


@pytest.mark.parametrize("seed", range(12))
def test_search_equals_scoring_everything(seed):
    rng = np.random.default_rng(seed)
    vocabulary = [f"t{i}" for i in range(int(rng.choice([5, 40, 400])))]
    texts = [[vocabulary[min(int(x), len(vocabulary)) - 1] for x in rng.zipf(1.4, int(rng.integers(0, 60)))] for _ in range(int(rng.integers(1, 700)))]
    avgdl = max(1.0, sum(map(len, texts)) / len(texts))
    shard, keys, rows = shard_of(texts, avgdl)
    assert {t: int(np.frombuffer(x, "<i4")[0]) for t, x in rows.items()} == Counter(t for own in texts for t in set(own))
    low = -0.3 if seed % 3 == 0 else 0.1
    for _ in range(20):
        asked = [(t, float(rng.uniform(low, 4))) for t in rng.choice([*vocabulary, "absent"], int(rng.integers(1, 12)))]
        asked = list(dict(asked).items())
        want = plain_scores(texts, asked, avgdl)
        for k in (1, 4, 50):
            spots, scores, _ = shard.search([t for t, _ in asked], [w for _, w in asked], k)
            got = {keys[s]: x for s, x in zip(spots.tolist(), scores.tolist(), strict=True)}
            assert all(abs(want[i] - x) <= 1.1e-6 for i, x in got.items())
            kth = sorted(want.values(), reverse=True)[k - 1] if len(want) >= k else float("-inf")
            assert set(got) >= {i for i, x in want.items() if x > kth + 2e-6 or kth <= 0}
            assert sum(x >= kth - 2e-6 for x in got.values()) >= min(k, len(want))
        spots, _, _ = shard.search([t for t, _ in asked], [w for _, w in asked], None)
        assert {keys[s] for s in spots.tolist()} == set(want)


def test_ranges_are_skipped():
    """Most postings of a question are never scored, though it asks for words that half of all chunks have."""
    rng = np.random.default_rng(5)
    topics = [[f"a{t}_{i}" for i in range(300)] for t in range(30)]
    texts = []
    for _ in range(4000):
        own = topics[int(rng.integers(30))]
        texts.append([own[min(int(x), 300) - 1] for x in rng.zipf(1.3, 60)] + [f"the{int(x)}" for x in rng.integers(0, 6, 12)])
    avgdl = sum(map(len, texts)) / len(texts)
    df = Counter(t for own in texts for t in set(own))
    shard, _, _ = shard_of(texts, avgdl)
    scored = every = 0
    for at in range(0, 4000, 131):
        asked = sorted(set(texts[at]))
        weights = [float(np.log((4000 - df[t] + 0.5) / (df[t] + 0.5))) if df[t] < 2000 else 0.1 for t in asked]
        spots, _, n = shard.search(asked, weights, 8)
        assert len(spots) >= 8
        scored, every = scored + n, every + sum(df[t] for t in asked)
    assert scored < 0.25 * every


def rows_of(df, *names):
    return sorted(tuple(r[n] for n in names) for r in df.collect())


def test_many_shards_and_hot_scope(spark, monkeypatch):
    """A scope of many shards, cutoffs from a first share, and the same rows as from one shard."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").filter("text is not null")
    scope = F.when(F.col("doc_id") % 5 == 0, "q").otherwise("p")
    chunks = docs.select(F.col("doc_id").alias("chunk_key"), F.lpad(F.col("doc_id").cast("string"), 9, "0").alias("pos"), scope.alias("project"), F.lit("b").alias("build"), F.col("text").alias("content"))
    asked = spark.read.parquet(f"{SMALL}/benchmark.parquet").select(F.col("item_id").alias("qid"), F.col("text").alias("query"))
    pool = asked.select("qid", F.lit(0).alias("tier"), F.lit("p").alias("project"), F.lit("b").alias("build")).unionAll(asked.filter("qid % 2 = 0").select("qid", F.lit(1), F.lit("q"), F.lit("b")))
    one = rows_of(R.sparse_recall(asked, pool, I.lexical(chunks, "chunk_key"), 6), "qid", "tier", "chunk_key", "score", "rank")
    every = rows_of(R.bm25_scores(asked, I.lexical(chunks, "chunk_key")), "qid", "chunk_key", "score")
    monkeypatch.setattr(P, "SHARD_CHUNKS", 12)
    monkeypatch.setattr(P, "FEW_SHARDS", 4)
    index = I.lexical(chunks, "chunk_key")
    assert index.packs.filter("token = ''").count() > 10
    assert rows_of(R.sparse_recall(asked, pool, index, 6), "qid", "tier", "chunk_key", "score", "rank") == one
    assert rows_of(R.bm25_scores(asked, index), "qid", "chunk_key", "score") == every


def test_unpacked_and_weights(spark):
    rows = [(1, "a", "p", "b", "x y x"), (2, "b", "p", "b", ""), (3, "c", "p", "c", None), (4, "d", "p", "c", "y " * 3000)]
    index = I.lexical(spark.createDataFrame(rows, CHUNKS), "chunk_key")
    assert rows_of(P.unpacked(index.packs), "token", "chunk_key", "pos", "length", "tf") == [("x", 1, "a", 3, 2), ("y", 1, "a", 3, 1), ("y", 4, "d", 3000, 3000)]
    assert index.stats.first()["n"] == 4
    asked = spark.createDataFrame([("y",), ("z",)], "token string")
    assert rows_of(index.weights(asked), "token", "df") == [("y", 2)]
    assert rows_of(index.leads, "project", "build", "chunk_key") == [("p", "b", 1), ("p", "b", 2), ("p", "c", 3), ("p", "c", 4)]


def test_empty(spark):
    index = I.lexical(spark.createDataFrame([], CHUNKS), "chunk_key")
    asked = spark.createDataFrame([(1, "x")], "qid long, query string")
    pool = spark.createDataFrame([(1, 0, "p", "b")], "qid long, tier int, project string, build string")
    assert R.sparse_recall(asked, pool, index, 3).count() == 0 and R.bm25_scores(asked, index).count() == 0


def test_plan_moves_each_posting_once(spark):
    """One cogroup brings packed rows and questions together."""
    chunks = spark.createDataFrame([(i, str(i), "p", "b", f"w{i % 7} x") for i in range(50)], CHUNKS)
    index = I.lexical(chunks, "chunk_key")
    asked = spark.createDataFrame([(1, 0, "p", "b", ["x"], [1.0])], "qid long, tier int, project string, build string, tokens array<string>, weights array<double>")
    plan = P.search(index.packs, asked, index.stats.select("avgdl"), 3)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FlatMapCoGroupsInArrow") == 1 and "CartesianProduct" not in plan


def test_totals_are_added_up_where_postings_are_read(spark, tmp_path):
    """By token, of live chunks alone: as from all postings, of which none leaves its task."""
    rng = np.random.default_rng(8)
    texts = [" ".join(rng.choice(["a", "b", "c & d", "e_1", f"only{i}"], int(rng.integers(0, 30)))) for i in range(300)]
    rows = spark.createDataFrame([(i, i, f"p{i % 3}" if i else "alone", "b", "" if not i else t) for i, t in enumerate(texts)], "chunk_key long, pos long, project string, build string, text string")
    packs = P.materialize(P.packed(rows, "chunk_key", "text"), "totals-packs")
    for live in (None, F.transform("keys", lambda k: k % 3 != 0)):
        held = packs if live is None else P.materialize(packs.withColumn("live", live), "totals-live")
        total, posts = P.totals(held), P.unpacked(held)
        want = posts.groupBy("token").agg(F.count("*").alias("df"), F.sum("tf").alias("tf"), F.sum("length").alias("chars"))
        assert {tuple(r) for r in total.collect()} == {tuple(r) for r in want.collect()}
        told = Counter(t for i, text in enumerate(texts) if i and (live is None or i % 3) for t in re.findall(r"[\w&]+", text))
        assert {r.token: r.tf for r in total.collect()} == told
