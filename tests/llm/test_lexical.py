import math
import re
from collections import Counter
from functools import partial

import numpy as np
import pytest
from conftest import SMALL, same_rows
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.llm import lexical, queries

DOCS = "doc_id long, text string, item string, rank string, score string, nth string"
ITEMS = "item_id long, text string, term string"
TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def plain_terms(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items, k=50):
    counts = [(i, Counter(plain_terms(text))) for i, text in docs]
    counts = [(i, c, sum(c.values())) for i, c in counts if c]
    n, total = len(counts), sum(size for *_, size in counts)
    df = Counter(t for _, c, _ in counts for t in c)
    asked = {}
    for item, text in items:
        asked.setdefault(item, set()).update(plain_terms(text))
    out = []
    for item, own in asked.items():
        scored = []
        for i, c, size in counts:
            m = 50 + 50 * size * n // total
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 20 * m)) for t in own if t in c)
            if score > 0:
                scored.append((-score, i is not None, i or 0))
        out += [(item, nth, i if known else None, -score) for nth, (score, known, i) in enumerate(sorted(scored)[:k], 1)]
    return sorted(map(repr, out))


def got(df):
    return sorted(repr((r.item_id, r["rank"], r.doc_id, r.score)) for r in df.collect())


def made(spark, docs, items):
    return spark.createDataFrame([(*d, "", "", "", "") for d in docs], DOCS), spark.createDataFrame([(*i, "") for i in items], ITEMS)


@settings(max_examples=300, deadline=None)
@given(st.text(st.characters(exclude_categories=["Cs"]), max_size=40))
def test_terms(text):
    assert [t.decode() for t in lexical.terms(text)] == plain_terms(text)


def test_terms_of_the_column(spark):
    texts = ["A-b C3\x00d", "Ünï Écl ©x", "", None, "\U0001f600 z　y", "[\\]^_`{|}~\x7fq@/:", "İI" * 3]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", lexical.term_column(F.col("t")).alias("x")).collect()
    assert all((r.x or []) == plain_terms(r.t) for r in rows)


def test_query_equals_its_sql(spark, duck):
    same_rows(queries.op13_lexical(spark, SMALL), duck, queries.OP13_SQL)


@pytest.mark.parametrize("seed", range(3))
def test_random_corpora(spark, monkeypatch, seed):
    """Zipf words, ties by repeated texts, repeated and null ids, several small blocks."""
    monkeypatch.setattr(lexical, "BATCH_TERMS", 25 if seed == 1 else 10_000)
    rng = np.random.default_rng(seed)
    words = lambda n: " ".join(f"w{min(int(x), 60)}" for x in rng.zipf(1.3, n))
    docs = [(i if i % 11 else None, words(int(rng.integers(0, 60)))) for i in range(700)]
    docs += docs[:150] + [(3, None), (4, ""), (5, "...")] + [(5000 + i, "w1 w2 w3") for i in range(80)]
    items = [(i, words(int(rng.integers(0, 12)))) for i in range(14)] + [(2, "w50 W7"), (None, "w9 w9"), (77, None), (78, "absent"), (79, "")]
    monkeypatch.setattr(lexical, "_blocks", partial(lexical._blocks, documents=90))
    df, asked = made(spark, docs, items)
    assert got(lexical.ranked(df, asked, k=20)) == brute(docs, items, 20)


def test_search_stops_early():
    """A rare term leads; postings of a common one are hardly read, and its bounds prove the rest."""
    rng = np.random.default_rng(0)
    n = 20_000
    lengths = np.full(n, 100)
    lists = {0: np.sort(rng.choice(n, 12_000, False)), 1: np.sort(rng.choice(n, 900, False)), 2: np.sort(rng.choice(n, 300, False))}
    times = {0: rng.integers(1, 30, 12_000), 1: rng.integers(1, 4, 900), 2: rng.integers(1, 4, 300)}
    ends = np.cumsum([len(lists[t]) for t in lists])
    row = {"ids": np.arange(n), "lengths": lengths.astype(np.int64).tobytes(), "terms": np.arange(3, dtype=np.int32).tobytes(), "ends": ends.astype(np.int64).tobytes(), "spots": np.concatenate(list(lists.values())).astype(np.int32).tobytes(), "times": np.concatenate(list(times.values())).astype(np.int32).tobytes()}
    weight = lexical.weights(n, np.array([len(lists[t]) for t in lists]))
    block = lexical.Block(row, weight, n, int(lengths.sum()))
    scores = np.zeros(n, np.int64)
    for t in lists:
        scores[lists[t]] += lexical.impacts(weight[[t]], times[t], lengths[lists[t]], n, int(lengths.sum()))
    spots, found, taken = block.search([0, 1, 2], 10, 1)
    best = np.sort(scores)[::-1][:10]
    assert np.array_equal(np.sort(found)[::-1][:10], best) and np.array_equal(scores[spots], found)
    assert taken < 0.2 * n and not block.scores.any() and not block.met.any()
    # A cutoff that k documents elsewhere reach leaves only what reaches it too.
    spots, found, _ = block.search([0, 1, 2], 10, int(best[3]))
    assert set(np.flatnonzero(scores >= best[3])) == set(spots)


def test_edges(spark):
    empty, asked = made(spark, [], [(1, "a")])
    assert lexical.ranked(empty, asked).count() == 0
    docs, none = made(spark, [(1, "a"), (2, "b " * 400_000)], [])
    assert lexical.ranked(docs, none).count() == 0
    rows = [(1, "a"), (2, "b " * 400_000 + "a")]
    docs, asked = made(spark, rows, [(1, "a b")])
    assert got(lexical.ranked(docs, asked)) == brute(rows, [(1, "a b")])
