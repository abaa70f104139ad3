"""Packs of vectors: rows equal a search of all, and few packs are visited."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import retrieve as R
from tessera.operators import vectors as W


def clustered(seed, n, dim, centres, spread):
    rng = np.random.default_rng(seed)
    middle = rng.normal(size=(centres, dim))
    made = middle[rng.integers(centres, size=n)] + spread * rng.normal(size=(n, dim))
    return made / np.linalg.norm(made, axis=1, keepdims=True)


def brute(asked, units, k, allowed=None):
    out = set()
    for q, v in asked.items():
        scores = [(-round(float(v @ u), 6) + 0.0, i) for i, u in enumerate(units) if len(u) == len(v) and (allowed is None or allowed(q, i))]
        out |= {(q, i, -s, n) for n, (s, i) in enumerate(sorted(scores)[:k], 1)}
    return out


def got(df):
    return {(r.qid, r.key, r.score + 0.0, r["rank"]) for r in df.collect()}


@pytest.mark.parametrize("size", [64, 7])
def test_equal_to_a_search_of_all_and_few_visits(spark, size, monkeypatch):
    monkeypatch.setattr(W, "PART", 300)
    monkeypatch.setattr(W, "CENTRES", 20)
    monkeypatch.setattr(W, "QUESTIONS", 9)
    units = clustered(1, 2000, 16, 25, 0.15)
    units[50:60] = units[50]
    held = spark.createDataFrame([(i, v.tolist(), "") for i, v in enumerate(units)], "key long, unit array<double>, scope string")
    packs = held.sparkSession.createDataFrame(W.pack_vectors(held).toPandas())
    packs = W.materialize(packs.withColumns({"n": F.col("n").cast("int"), "dim": F.col("dim").cast("int")}), "test-packs")
    asked = {i: units[i] for i in range(0, 2000, 50)}
    visits = []
    found = W.dense_search(spark.createDataFrame([(i, v.tolist()) for i, v in asked.items()], "qid long, unit array<double>"), packs, size, visits=visits)
    assert got(found) == brute(asked, units, size)
    assert visits[0].count() < (0.35 if size == 7 else 0.5) * packs.count() * len(asked)


def test_packs_hold_every_vector_once_and_bound_it(spark, monkeypatch):
    monkeypatch.setattr(W, "PART", 200)
    units = clustered(2, 1500, 8, 4, 0.4)
    rows = [(i, v.tolist(), f"s{i % 3}" if i % 7 else None, i * 10) for i, v in enumerate(units)] + [(9001, [1.0, 0.0], "s1", 1)]
    made = W.pack_vectors(spark.createDataFrame(rows, "key long, unit array<double>, scope string, document long"), extra=("document",)).collect()
    assert sorted(k for r in made for k in r["keys"]) == sorted(i for i, *_ in rows)
    assert len({r.pack for r in made}) == len(made)
    for r in made:
        own, centre = np.frombuffer(r.units).reshape(r.n, r.dim), np.frombuffer(r.centre)
        assert r.n <= W.PACK and np.arccos(np.clip(own @ centre, -1, 1)).max() <= r.width + 1e-9
        assert all(rows[k][3] == d for k, d in zip(r["keys"], r.document, strict=True) if k < 9000)


def test_scopes_lengths_and_dead_vectors(spark):
    units = clustered(3, 600, 8, 5, 0.3)
    held = spark.createDataFrame([(i, v.tolist(), f"s{i % 4}") for i, v in enumerate(units)], "key long, unit array<double>, scope string")
    packs = W.materialize(W.pack_vectors(held), "scoped-packs")
    asked = {q: units[q] for q in (3, 10, 77)}
    scopes = {3: ["s0", "s1"], 10: ["s2", "s2", "none"], 77: []}
    rows = spark.createDataFrame([(q, v.tolist(), scopes[q]) for q, v in asked.items()], "qid long, unit array<double>, scopes array<string>")
    allowed = lambda q, i: f"s{i % 4}" in scopes[q]
    assert got(W.dense_search(rows, packs, 5)) == brute(asked, units, 5, allowed)
    dead = W.materialize(packs.withColumn("live", F.transform("keys", lambda x: x % 5 != 0)), "dead-packs")
    assert got(W.dense_search(rows, dead, 5)) == brute(asked, units, 5, lambda q, i: allowed(q, i) and i % 5 != 0)
    assert W.dense_search(rows.filter("qid < 0"), packs, 5).count() == 0
    assert R.dense_recall(rows.select("qid", "unit"), held.filter("key < 0"), 2).count() == 0


def moved(plan):
    """Bytes that the exchanges of a plan that ran have written or broadcast."""
    name = plan.getClass().getSimpleName()
    if name == "AdaptiveSparkPlanExec":
        return moved(plan.executedPlan())
    if name.endswith("QueryStageExec"):
        return moved(plan.plan())
    size, below = plan.metrics().get("dataSize"), plan.children()
    return (size.get().value() if size.isDefined() else 0) + sum(moved(below.apply(i)) for i in range(below.size()))


@pytest.mark.parametrize("spread", [0.1, 50.0])
def test_what_moves_does_not_grow_with_the_visits(spark, spread):
    """On vectors without clusters every question visits nearly every pack; vectors and questions move few times."""
    units = clustered(4, 6000, 64, 30, spread)
    held = spark.createDataFrame([(i, v.tolist(), "") for i, v in enumerate(units)], "key long, unit array<double>, scope string")
    packs = W.materialize(W.pack_vectors(held), "packs-moved")
    asked = {i: units[i] for i in range(0, 6000, 15)}
    visits = []
    found = W.dense_search(spark.createDataFrame([(i, v.tolist()) for i, v in asked.items()], "qid long, unit array<double>"), packs, 4, visits=visits)
    assert got(found) == brute(asked, units, 4)
    if spread > 1:
        assert visits[0].count() > 0.8 * packs.count() * len(asked)
    assert 0 < moved(found._jdf.queryExecution().executedPlan()) < 3 * (units.nbytes + len(asked) * 64 * 8)


def test_groups_of_packs_and_turns_of_questions(spark, monkeypatch):
    """Many meetings of a scope, ties across them, and vectors that do not count."""
    for name, value in (("VECTORS", 150), ("ASKED", 20), ("QUESTIONS", 7)):
        monkeypatch.setattr(W, name, value)
    units = clustered(5, 900, 8, 6, 0.5)
    units[100:200] = units[100]
    held = spark.createDataFrame([(i, v.tolist(), f"s{i % 2}") for i, v in enumerate(units)], "key long, unit array<double>, scope string")
    packs = W.materialize(W.pack_vectors(held).withColumn("live", F.when(F.col("scope") == "s1", F.transform("keys", lambda x: x % 5 != 0))), "packs-met")
    asked = {q: units[q] for q in range(0, 900, 9)}
    rows = spark.createDataFrame([(q, v.tolist(), ["s0", "s1"] if q % 2 else ["s1"]) for q, v in asked.items()], "qid long, unit array<double>, scopes array<string>")
    assert got(W.dense_search(rows, packs, 6)) == brute(asked, units, 6, lambda q, i: (i % 2 or q % 2) and (i % 2 == 0 or i % 5))
