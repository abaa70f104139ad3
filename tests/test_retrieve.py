import time

import duckdb
import numpy as np
import pytest
from conftest import same_rows
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.functions import text as X
from tessera.operators import index as I
from tessera.operators import retrieve as R
from tessera.operators import scope as S
from tessera.plans import registry

COLUMNS = "qid long, tier int, pos long, scope_rank int, doc_rank int, boost int, score double"


def simulated(rows, k=8, threshold=-3.0, quotas=(6, 2, 2)):
    """Tier after tier, as a search that stops early would go."""
    by_tier = {}
    for r in rows:
        by_tier.setdefault(r[1], []).append(r)
    for own in by_tier.values():
        own.sort(key=lambda r: (-r[6], r[3], r[4], -r[5], r[2]))
    primary = None
    for tier in sorted(by_tier):
        primary = tier
        if by_tier[tier][0][6] >= threshold:
            break
    cap = min(k, max(quotas[primary], k - sum(quotas[primary + 1 :])))
    chosen = by_tier[primary][:cap]
    for tier in sorted(t for t in by_tier if t > primary):
        chosen += by_tier[tier][: min(quotas[tier], k - len(chosen))]
    return [r[2] for r in chosen[:k]]


def test_cascade_equals_a_stepwise_search(spark):
    rng = np.random.default_rng(3)
    rows = [(q, int(rng.integers(3)), q * 100 + i, int(rng.integers(3)), int(rng.integers(2)), int(rng.integers(4)), float(np.round(rng.normal(-4, 2), 1))) for q in range(300) for i in range(int(rng.integers(1, 25)))]
    got = {}
    for r in R.cascade(spark.createDataFrame(rows, COLUMNS)).orderBy("qid", "rank").collect():
        got.setdefault(r.qid, []).append(r.pos)
    for q in range(300):
        assert got[q] == simulated([r for r in rows if r[0] == q])


@pytest.mark.parametrize(("tier", "k", "want"), [(0, 8, 6), (1, 8, 6), (2, 8, 8), (0, 4, 4), (1, 4, 2), (2, 2, 2), (0, 1, 1)])
def test_primary_quota(spark, tier, k, want):
    assert spark.range(1).select(R.primary_quota(F.lit(tier), k, (6, 2, 2)).alias("x")).first()["x"] == want


def test_no_tier_is_good_enough(spark):
    rows = [(1, 0, 1, 0, 0, 0, -9.0), (1, 2, 2, 0, 0, 0, -8.0)]
    assert [r.pos for r in R.cascade(spark.createDataFrame(rows, COLUMNS)).collect()] == [2]


def test_flat_order_prefers_boost_and_cascade_score(spark):
    rows = spark.createDataFrame([(1, 0, 1, 0, 0, 9, -5.0), (1, 0, 2, 0, 0, 0, 2.0)], COLUMNS)
    assert [r.pos for r in R.flat_results(rows, 2).orderBy("rank").collect()] == [1, 2]
    assert [r.pos for r in R.cascade(rows).orderBy("rank").collect()] == [2, 1]


def test_fusion_keeps_the_first_list_first(spark):
    a = spark.createDataFrame([(1, 7, 1), (1, 8, 2)], "qid long, chunk_key long, rank int")
    b = spark.createDataFrame([(1, 8, 1), (1, 9, 2)], "qid long, chunk_key long, rank int")
    assert [r.chunk_key for r in R.fused(a, b).orderBy("rank").collect()] == [7, 8, 9]


def test_sparse_recall_fills_up_with_zero_scores(spark):
    chunks = spark.createDataFrame([(1, 1, "p", "b", "alpha beta"), (2, 2, "p", "b", "gamma"), (3, 3, "p", "b", "alpha"), (4, 4, "q", "b", "alpha")], "chunk_key long, pos long, project string, build string, content string")
    pool = spark.createDataFrame([(1, 0, "p", "b")], "qid long, tier int, project string, build string")
    asked = spark.createDataFrame([(1, "gamma")], "qid long, query string")
    found = R.sparse_recall(asked, pool, I.lexical(chunks, "chunk_key"), 3)
    assert [r.chunk_key for r in found.orderBy("rank").collect()] == [2, 1, 3]


def test_dense_recall_respects_scopes(spark):
    vectors = spark.createDataFrame([(1, [1.0, 0.0], "a"), (2, [0.8, 0.6], "b"), (3, [0.0, 1.0], "a")], "key long, unit array<double>, scope string")
    asked = spark.createDataFrame([(5, [1.0, 0.0], ["b"]), (6, [0.0, 1.0], ["a", "b"])], "qid long, unit array<double>, scopes array<string>")
    got = {(r.qid, r.rank): r.key for r in R.dense_recall(asked, vectors, 2).collect()}
    assert got == {(5, 1): 2, (6, 1): 3, (6, 2): 2}
    assert R.dense_recall(asked.filter("qid < 0"), vectors, 2).count() == 0


CATALOG = [("p1", ["b1", "b10"]), ("p10", ["b2"])]


@pytest.mark.parametrize(("query", "want"), [
    ("voltage of p1 b10 rail", ("p1", "b10", "build", "voltage of rail")), ("p1/b1 pins", ("p1", "b1", "build", "pins")), ("P1 Common rules", ("p1", None, "project_common", "rules")),
    ("全局 rules", (None, None, "enterprise", "rules")), ("b2 alone", (None, None, None, "b2 alone")), ("which p10", ("p10", None, "inherit", "which")), ("p1", ("p1", None, "inherit", "p1")), ("", (None, None, None, "")),
])
def test_scope_extraction(spark, query, want):
    products = spark.createDataFrame(CATALOG, "product string, revisions array<string>")
    row = S.extracted(spark.createDataFrame([(1, query)], "qid long, query string"), products).first()
    assert (row.product, row.revision, row.layer, row.stripped) == want


@pytest.mark.parametrize("seed", range(4))
def test_automaton_equals_the_join(spark, seed):
    """Random catalogs with names inside names, cases, blanks and other signs."""
    rng = np.random.default_rng(seed)
    parts = ["p1", "P1", "p10", "alpha", "alpha beta", "x-1", "Ünï", "b", "b1", "b10", "common", "rev c", "a.b", "g_h", "1"]
    products = {str(rng.choice(parts)): [str(x) for x in rng.choice(parts, int(rng.integers(0, 5)), False)] for _ in range(9)}
    signs = [" ", " ", " ", "/", " / ", "-", ", ", "", "  "]
    texts = ["".join(str(rng.choice([*parts, "of", "global", "Common", "ALPHA", "全局"] if rng.random() < 0.97 else ["global"])) + str(rng.choice(signs)) for _ in range(int(rng.integers(0, 7)))) for _ in range(250)]
    catalog = spark.createDataFrame([*products.items()], "product string, revisions array<string>")
    asked = spark.createDataFrame([*enumerate(texts)], "qid long, query string")
    rows = lambda df: {r.qid: (r.product, r.revision, r.layer, r.stripped) for r in df.collect()}
    one, other = rows(S.extracted(asked, catalog)), rows(S.joined_rules(asked, catalog))
    assert {q: (texts[q], one[q], other[q]) for q in one if one[q] != other[q]} == {}


def test_cost_follows_the_text(spark):
    """Ten thousand products that share words with every question."""
    rows = [(f"board {i}", [f"rev {j}" for j in range(4)]) for i in range(10_000)]
    names = S.Names(rows, S.LAYOUT)
    assert names.rule("pins of board 77 rev 3 board") == ("board 77", "rev 3", "build", " ")
    few = S.Names(rows[:100], S.LAYOUT)
    took = {}
    for name, own in (("many", names), ("few", few)):
        began = time.perf_counter()
        for i in range(2000):
            own.rule(f"what is on board {i % 90} of the board family")
        took[name] = time.perf_counter() - began
    assert took["many"] < 5 * took["few"] + 0.2
    catalog = spark.createDataFrame(rows, "product string, revisions array<string>")
    asked = spark.createDataFrame([(i, f"board {i} / rev 1 of board") for i in range(500)], "qid long, query string")
    assert S.extracted(asked, catalog).filter("layer = 'build' and revision = 'rev 1' and product = concat('board ', qid)").count() == 500
    assert S.extracted(asked, catalog.limit(0)).filter("layer is not null").count() == 0


def test_expansion(spark):
    rows = spark.createDataFrame([(1, "p", "b"), (2, "p", "common"), (3, "global", "x")], "qid long, project string, build string")
    got = {}
    for r in S.ranks(rows).orderBy("qid", "scope_rank").collect():
        got.setdefault(r.qid, []).append((r.project, r.build))
    assert got == {1: [("p", "b"), ("p", "common"), ("global", "global")], 2: [("p", "common"), ("global", "global")], 3: [("global", "global")]}


@settings(max_examples=25, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 2), st.integers(-60, 20)), min_size=1, max_size=30), st.integers(1, 10))
def test_simulation_never_exceeds_k(rows, k):
    made = [(1, t, i, 0, 0, 0, s / 10) for i, (t, s) in enumerate(rows)]
    assert len(simulated(made, k)) <= k


def test_letters_change_case_as_in_sql(spark, duck):
    """Every letter; ``upper`` alone would write ß as SS."""
    letters = [chr(c) for c in [*range(1, 0xD800), *range(0xE000, 0x110000)]]
    told = spark.createDataFrame([(c,) for c in letters], "c string").select("c", X.upper_by_letter(F.col("c")).alias("u"), X.lower_by_letter(F.col("c")).alias("l"))
    want = duck.execute("SELECT c, upper(c), lower(c) FROM (SELECT chr(i::INTEGER) AS c FROM range(1, 1114112) r(i) WHERE i < 55296 OR i > 57343)").fetchall()
    assert {tuple(r) for r in told.collect()} == set(want)


@pytest.mark.parametrize("name", ["R14_pool_retrieve", "R20_flat_retrieve", "R21_retrieve"])
def test_retrieval_matches_words_as_its_sql_does(spark, tmp_path, name):
    """Words whose upper or lower case Java and SQL write differently."""
    texts = ["große straße", "GROSSE STRASSE", "GROẞE STRAẞE", "STRASSE und große", "ohm Ω kelvin 3K", "OHM Ω KELVIN 3K", "ﬁlter ΟΔΟΣ", "FILTER οδος", "οδοσ İstanbul", "ISTANBUL istanbul", "maſs MASS", "ŉa ǰa"]
    asked = ["große straße", "strasse grosse x", "3K Ωm ohm", "ΟΔΟΣ οδος ﬁlter", "İstanbul MAẞ maſs", "straße STRASSE STRAẞE", "ŉa ǰa ΟΔΟΣ οδοσ", "große οδος 3k"]
    spark.createDataFrame([(i, texts[i % 12] + f" n{i}") for i in range(240)], "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(list(enumerate(asked)), "item_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/benchmark.parquet")
    con = duckdb.connect()
    for table in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{tmp_path}/{table}.parquet/*.parquet'")
    same_rows(registry.queries()[name](spark, str(tmp_path)), con, registry.oracle_sql()[name])
