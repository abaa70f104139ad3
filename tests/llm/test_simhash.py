import numpy as np
import pytest
import xxhash
from conftest import SMALL

from tessera.llm import queries, simhash
from tessera.llm.components import LocalComponents, connected_components

SCHEMA = "doc_id long, text string, fp string, component string"


def plain(text, words=3):
    """The definition, bit by bit."""
    tokens = (text or "").encode().lower().split()
    shingles = [b" ".join(tokens[i : i + words]) for i in range(max(1, len(tokens) - words + 1))] if tokens else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if hashes and 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute(fps):
    """Smallest id reachable by links of at most three bits; fps: list of (id, fp)."""
    root = {i: i for i, _ in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, x in fps:
        for b, y in fps:
            if a < b and bin(x ^ y).count("1") <= 3:
                p, q = sorted((find(a), find(b)))
                root[q] = p
    return {i: find(i) for i, _ in fps}


@pytest.mark.parametrize("text", [None, "", " \t\n", "one", "one Two", "a b c", "a b c d a b c d", "Ä ä X\u00a0y z", "w " * 9000])
def test_fingerprint(text):
    assert simhash.fingerprint(text) == plain(text)


def test_query_equals_brute_force(spark):
    docs = [(r.doc_id, plain(r.text)) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    want = brute(docs)
    for r in queries.op5_simhash(spark, SMALL).collect():
        assert r.fingerprint == f"{dict(docs)[r.doc_id]:016x}" and r.component_id == want[r.doc_id]


@pytest.mark.parametrize("depth", [0, 2, 5])
def test_every_close_pair_meets_in_one_shard(depth):
    rng = np.random.default_rng(depth)
    base = rng.integers(0, 2**63, 400).astype(np.uint64)
    near = base ^ np.array([sum(1 << int(b) for b in rng.choice(64, 3, replace=False)) for _ in base], np.uint64)
    values = np.concatenate((base, near))
    tree = simhash.Tree(values[::3], depth)
    index, shard, home = tree.deal(values, 3)
    lives = dict(zip(index[home].tolist(), shard[home].tolist(), strict=True))
    assert len(lives) == len(values)
    visits = set(zip(index.tolist(), shard.tolist(), strict=True))
    for i, j in zip(*np.nonzero(np.bitwise_count(values[:, None] ^ values[None, :]) <= 3), strict=True):
        assert (i, lives[j]) in visits or (j, lives[i]) in visits


def test_local_search_is_exact():
    rng = np.random.default_rng(5)
    held = rng.integers(0, 2**63, 900).astype(np.uint64)
    held[:300] = held[0] ^ (np.uint64(1) << rng.integers(0, 63, 300).astype(np.uint64))
    got = {(int(a), int(b)) for i, j in simhash.close_pairs(held, held, 3) for a, b in zip(i, j, strict=True)}
    want = {(int(a), int(b)) for a, b in zip(*np.nonzero(np.bitwise_count(held[:, None] ^ held[None, :]) <= 3), strict=True)}
    assert got == want


def test_many_shards_give_the_same_groups(spark, monkeypatch):
    monkeypatch.setattr(simhash, "SHARD_SIZE", 40)
    docs = [(r.doc_id, plain(r.text)) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    got = {r.doc_id: r.component_id for r in simhash.near_duplicates(spark.read.parquet(f"{SMALL}/documents.parquet")).collect()}
    assert got == brute(docs)


def numbers(rng, n):
    return rng.integers(-(2**63), 2**63 - 1, n, dtype=np.int64)


def test_deep_trees_grow_in_rounds_and_stay_even(spark, monkeypatch):
    """Twelve levels in four rounds: shards are even, and all close pairs meet."""
    monkeypatch.setattr(simhash, "SHARD_SIZE", 8)
    monkeypatch.setattr(simhash, "LEVELS", 3)
    monkeypatch.setattr(simhash, "CHUNK", 100)
    rng = np.random.default_rng(3)
    base = numbers(rng, 10_000)
    near = base[:2_000] ^ np.array([sum(1 << int(b) for b in rng.choice(63, 3, replace=False)) for _ in range(2_000)], np.int64)
    both = np.unique(np.concatenate((base, near)))
    values = spark.createDataFrame([(int(x),) for x in both], "fp long")
    visits = simhash.shard_visits(values, 3).toPandas()
    sizes = visits[visits["home"]].groupby("shard").size()
    assert sizes.sum() == len(both) and visits["shard"].max() >= 2**10 and sizes.max() <= 8 * 8 and len(sizes) >= 2**11 * 0.7
    links = simhash.near_links(values).collect()
    local = LocalComponents(len(both))
    at = {int(x): i for i, x in enumerate(both)}
    local.link(np.array([at[r.a] for r in links]), np.array([at[r.b] for r in links]))
    assert (local.root[[at[int(x)] for x in base[:2_000]]] == local.root[[at[int(x)] for x in near]]).all()


def test_a_null_id_joins_two_groups(spark):
    """The middle document has no id; the outer ones are close to it but not to each other."""
    words = [f"w{i}" for i in range(400)]
    texts = [" ".join(words)]
    while len(texts) < 3:  # look for a chain of links by changing words
        rng = np.random.default_rng(len(texts))
        for _ in range(20_000):
            own = texts[-1].split()
            own[int(rng.integers(400))] = f"x{rng.integers(10**6)}"
            made = " ".join(own)
            far = [bin(plain(made) ^ plain(t)).count("1") for t in texts]
            if far[-1] in (2, 3) and all(f > 3 for f in far[:-1]):
                texts.append(made)
                break
    rows = [(9, texts[0], "", ""), (None, texts[1], "", ""), (4, texts[2], "", "")]
    got = {r.doc_id: r.component_id for r in simhash.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {9: 4, None: 4, 4: 4}


def test_string_ids(spark):
    rows = [("b", "same words here", "", ""), ("a", "same words here", "", ""), ("c", "other words there", "", "")]
    df = spark.createDataFrame(rows, SCHEMA.replace("doc_id long", "doc_id string"))
    assert {r.doc_id: r.component_id for r in simhash.near_duplicates(df).collect()} == {"a": "a", "b": "a", "c": "c"}


def test_edges(spark):
    rows = [(3, None, "", ""), (1, "", "", ""), (1, "", "", ""), (None, "a b c", "", ""), (7, "a b c", "", ""), (8, "X y z " * 3000, "", ""), (None, "alone here now", "", "")]
    got = sorted(((str(r.doc_id), r.component_id) for r in simhash.near_duplicates(spark.createDataFrame(rows, SCHEMA)).select("doc_id", "component_id").collect()), key=str)
    assert got == sorted([("3", 1), ("1", 1), ("1", 1), ("None", 7), ("7", 7), ("8", 8), ("None", None)], key=str)
    assert simhash.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0


def test_components(spark):
    chain = [(i + 1, i) for i in range(60)] + [(200, 201), (203, 200), (5, 5), (None, 1)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(61)}, 200: 200, 201: 200, 203: 200}
    local = LocalComponents(6)
    local.link(np.array([5, 3]), np.array([3, 1]))
    assert local.root.tolist() == [0, 1, 2, 1, 4, 1]
