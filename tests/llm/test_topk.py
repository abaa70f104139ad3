import math
from fractions import Fraction

import numpy as np
from conftest import SMALL, same_rows
from pyspark.sql import functions as F

from tessera.llm import queries, topk

SCHEMA = "vec_id long, embedding array<float>, label int, score string, rank string"


def brute(vectors, k, scale=1024):
    whole = {i: [math.floor(scale * Fraction(x)) for x in v] for i, v in vectors.items()}
    out = set()
    for q in whole:
        if q % 100 == 0:
            scored = sorted(((-sum(a * b for a, b in zip(whole[q], v)), i) for i, v in whole.items() if i != q and len(v) == len(whole[q])))
            out |= {(q, n, i, -s) for n, (s, i) in enumerate(scored[:k], 1)}
    return out


def got(df):
    return {(r.query_id, r["rank"], r.vec_id, r.score) for r in df.collect()}


def test_query_equals_its_sql(spark, duck):
    same_rows(queries.op1_topk(spark, SMALL), duck, queries.OP1_SQL)


def test_ties_negatives_and_small_packs(spark, monkeypatch):
    monkeypatch.setattr(topk, "PACK", 7)
    monkeypatch.setattr(topk, "BLOCK", 2)
    rng = np.random.default_rng(4)
    base = np.round(rng.normal(size=(40, 6)), 1).astype(np.float32)
    vectors = {i: base[i % 40].tolist() for i in range(500)}
    df = spark.createDataFrame([(i, v, 0, "", "") for i, v in vectors.items()], SCHEMA)
    assert got(topk.exact_top_k(df, F.col("id") % 100 == 0, 10)) == brute(vectors, 10)
    low = {i: [-1.0 - i % 7, -2.0] for i in range(230)}
    df = spark.createDataFrame([(i, v, 0, "", "") for i, v in low.items()], SCHEMA)
    assert got(topk.exact_top_k(df, F.col("id") % 100 == 0, 10)) == brute(low, 10)


def test_edges(spark):
    good = {0: [1.0, 2.0], 100: [0.5, 0.5], 3: [2.0, 0.0], 200: [1.0, 1.0, 1.0], 7: [1.0, 0.0, 0.0]}
    rows = [(i, v, 1, "", "") for i, v in good.items()] + [(3, good[3], 1, "", ""), (5, None, 1, "", ""), (6, [1.0, float("nan")], 1, "", ""), (8, [float("inf"), 1.0], 1, "", ""), (9, [1.0, None], 1, "", ""), (None, [1.0, 1.0], 1, "", "")]
    assert got(topk.exact_top_k(spark.createDataFrame(rows, SCHEMA), F.col("id") % 100 == 0, 10)) == brute(good, 10)
    assert topk.exact_top_k(spark.createDataFrame([], SCHEMA), F.col("id") % 100 == 0).count() == 0
    alone = spark.createDataFrame([(100, [1.0], 1, "", "")], SCHEMA)
    assert topk.exact_top_k(alone, F.col("id") % 100 == 0).count() == 0


def test_large_components_stay_exact(spark):
    vectors = {i: [float(np.float32(1e6 + i)), float(np.float32(-3e2 * i)), 1.0] for i in range(120)}
    df = spark.createDataFrame([(i, v, 1, "", "") for i, v in vectors.items()], SCHEMA)
    assert got(topk.exact_top_k(df, F.col("id") % 100 == 0, 5)) == brute(vectors, 5)


def test_extreme_components(spark):
    """Products beyond doubles, and scores beyond longs, which are clamped."""
    vectors = {0: [1e306, 1.0], 1: [1e306, -2.0], 2: [-1e306, 3.0], 3: [1e-3, 4.0], 4: [5e-324, -1.5], 100: [-1e308, 0.5], 5: [1e30, 1e30]}
    df = spark.createDataFrame([(i, v, 1, "", "") for i, v in vectors.items()], SCHEMA.replace("float", "double"))
    limit = 2**63
    want = set()
    for q, n, i, score in brute(vectors, 10):
        want.add((q, i, min(max(score, -limit), limit - 1)))
    made = got(topk.exact_top_k(df, F.col("id") % 100 == 0, 10))
    assert {(q, i, s) for q, _, i, s in made} == want
    for q in (0, 100):
        ranked = [(-s, i) for _, n, i, s in sorted(r for r in made if r[0] == q)]
        assert ranked == sorted(ranked)


def test_the_cutoff_saves_scores(spark, monkeypatch, tmp_path):
    """Clustered vectors: phase 3 works out the scores of a small part of all pairs."""
    rng = np.random.default_rng(7)
    centres = rng.normal(size=(40, 32))
    vectors = centres[rng.integers(40, size=3000)] + 0.1 * rng.normal(size=(3000, 32))
    vectors /= np.linalg.norm(vectors, axis=1, keepdims=True)
    df = spark.createDataFrame([(i, v.tolist(), 0, "", "") for i, v in enumerate(vectors)], SCHEMA.replace("float", "double"))
    held = {}
    keep = topk.materialize
    monkeypatch.setattr(topk, "materialize", lambda frame, tag, **more: held.setdefault(tag, keep(frame, tag, **more)))
    made = got(topk.exact_top_k(df, F.col("id") % 100 == 0))
    assert made == brute(dict(enumerate(vectors.tolist())), 10)
    sent = [r.sent for r in held["entries"].collect()]
    entries = sum((len(x) - 1) // 4 if x[:1] == b"P" else int(np.unpackbits(np.frombuffer(x, np.uint8, offset=1)).sum()) for x in sent)
    assert 0 < entries < 0.5 * 30 * 3000  # of 90,000 pairs, slices counted apart
    assert sum(map(len, sent)) <= 4 * 30 * 3000 / 8 + 100 * len(sent)


def test_entries_travel_either_way():
    rng = np.random.default_rng(3)
    for share in (0.0, 0.001, 0.02, 0.05, 0.5, 1.0):
        one, other = (rng.random((37, 91)) < share for _ in range(2))
        read = topk.entries_read([topk.entries_sent(one), topk.entries_sent(other)], one.size)
        assert np.array_equal(read.reshape(one.shape), one | other)


def test_scores_below_the_range_of_a_long(spark):
    """Fewer candidates than asked for have no cutoff, and scores that are clamped to the least long reach it."""
    few = {0: [1e8] * 4, 1: [-1e8] * 4, 2: [1e8, 1e8, -1e8, 1.0]}
    many = few | {i: [-1e8] * 3 + [-1e8 - i] for i in range(3, 30)}
    for vectors in (few, many):
        df = spark.createDataFrame([(i, v, 0, "", "") for i, v in vectors.items()], SCHEMA.replace("float", "double"))
        made = got(topk.exact_top_k(df, F.col("id") % 100 == 0, 5))
        clamped = sorted((-max(-(2**63), min(2**63 - 1, sum(math.floor(1024 * a) * math.floor(1024 * b) for a, b in zip(vectors[0], v)))), i) for i, v in vectors.items() if i)
        assert made == {(0, n, i, -s) for n, (s, i) in enumerate(clamped[:5], 1)}


def test_queries_that_are_too_many_to_broadcast(spark, monkeypatch):
    monkeypatch.setattr(topk, "SMALL_QUERIES", 0)
    monkeypatch.setattr(topk, "PACK", 30)
    rng = np.random.default_rng(6)
    vectors = {i: rng.normal(size=8).tolist() for i in range(400)}
    df = spark.createDataFrame([(i, v, 0, "", "") for i, v in vectors.items()], SCHEMA.replace("float", "double"))
    assert got(topk.exact_top_k(df, F.col("id") % 100 == 0)) == brute(vectors, 10)
