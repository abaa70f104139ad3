import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from conftest import SMALL

from tessera.llm import queries, shards

SCHEMA = "doc_id long, text string, shard int, key string"


def test_ranges_and_parts_follow_the_rows():
    assert [shards.range_digits(n) for n in (0, 10**6, 4096 * 10**6, 4097 * 10**6, 5 * 10**10)] == [3, 3, 3, 4, 4]


class Listed:
    def __init__(self, ends):
        self.ends = ends

    def last(self, x):
        below = [e for e in self.ends if e <= x]
        return below[-1] if below else None


@pytest.mark.parametrize("seed", range(30))
def test_cuts_are_minimax(seed):
    rng = np.random.default_rng(seed)
    sizes = rng.integers(1, int(rng.choice([3, 50, 400])), int(rng.integers(1, 40)))
    n = int(rng.integers(1, 8))
    ends = np.cumsum(sizes).tolist()
    capacity, cuts = shards.minimax_cuts(Listed(ends), int(sizes.max()), ends[-1], n)
    # The best contiguous partition by dynamic programming.
    best = [0] + [10**9] * len(ends)
    for _ in range(n):
        best = [0] + [min(max(best[i], ends[j] - (ends[i - 1] if i else 0)) for i in range(j + 1)) for j in range(len(ends))]
    loads = np.diff([0, *cuts, ends[-1]])
    assert capacity == best[-1] == loads.max() and len(loads) <= n


def check(rows, out, n_shards):
    texts = defaultdict(list)
    for r in rows:
        texts[r[0]].append(r[1] or "")
    got = [r.asDict() for r in out.collect()]
    assert Counter(r["doc_id"] for r in got) == Counter(r[0] for r in rows)
    slots = defaultdict(list)
    for r in got:
        slots[r["shard"]].append(r["slot"])
        assert 0 <= r["shard"] < n_shards
        assert (r["size"], r["text_crc32"]) in [(len(t.encode()) + 1, zlib.crc32(t.encode())) for t in texts[r["doc_id"]]]
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    return got


def test_edges(spark):
    rows = [(1, "a", 0, "k"), (1, "a", 0, "k"), (2, None, 0, "k"), (3, "", 0, "k"), (None, "é" * 50_000, 0, "k"), (5, "a", 0, "k")] + [(10 + i, f"text {i}" * (i % 7), 0, "k") for i in range(200)]
    got = check(rows, shards.shard_documents(spark.createDataFrame(rows, SCHEMA), 5), 5)
    where = defaultdict(set)
    for r in got:
        where[r["text_crc32"]].add(r["shard"])
    assert all(len(s) == 1 for s in where.values())
    assert shards.shard_documents(spark.createDataFrame(rows, SCHEMA).limit(0)).count() == 0


def test_hot_group(spark):
    rows = [(i, "same text" if i % 3 else f"text {i}", 0, "k") for i in range(900)]
    check(rows, shards.shard_documents(spark.createDataFrame(rows, SCHEMA), 4), 4)


def test_query_sizes_are_near_equal(spark):
    out = queries.op6_shards(spark, SMALL).toPandas()
    loads = out.groupby("shard")["size"].sum()
    groups = out.groupby("text_crc32")["size"].sum()
    assert loads.max() <= out["capacity"].iloc[0] and loads.max() <= max(groups.max(), -(-loads.sum() // 16) + groups.max())
