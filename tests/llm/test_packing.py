import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from conftest import SMALL
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tessera.llm import packing, queries

PATH = public_tokenizers.path("byte_bpe_50k.json")
OWN = Tokenizer.from_file(PATH)
SCHEMA = "doc_id long, text string, piece string, bin string"


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.mark.parametrize("text", ["", "Hello world's", "a <|endoftext|> b", "<|endoftext|>", "naïve 你好\n\n  x", "x" * 5000, "don't  \t 12 34"])
def test_ids_equal_the_library(library, text):
    own = packing.encoder(PATH)
    assert own._own is None and own.encode(text) == library.encode(text, add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["<|endoftext|>", "<|endof", "text|>", "'s", "'ve", " ", "\n", "\t", "a", "Word", "12", "é你", "!?", "\u00a0", "\u3000"]), max_size=25).map("".join))
def test_random_texts_equal_the_library(text):
    own = packing.encoder(PATH)
    assert own.encode(text) == own.encode_slices(text) == OWN.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("unit", [" ", "\n", "^", "\t \u3000"])
def test_long_runs(library, unit):
    """Runs that a backtracking pattern gives up on."""
    short, long = unit * 3_000 + "x", unit * 3_000_000 + "x"
    own = packing.encoder(PATH)
    assert own.encode(short) == library.encode(short, add_special_tokens=False).ids
    ids = own.encode(long)
    assert own._codec.decode(ids) == long.encode()


@pytest.mark.parametrize(("n", "want"), [(1, [(0, 1)]), (1024, [(0, 1024)]), (1025, [(0, 1), (1, 1024)]), (2048, [(0, 1024), (1024, 1024)]), (2500, [(0, 452), (452, 1024), (1476, 1024)])])
def test_cut(n, want):
    assert packing.cut(n) == want


@pytest.mark.parametrize("seed", range(25))
def test_best_fit_and_bound(seed):
    rng = np.random.default_rng(seed)
    lengths = rng.integers(1, int(rng.choice([1024, 600, 90])), int(rng.integers(1, 300)))
    of, at = packing.best_fit_decreasing(lengths)
    bins = of.max() + 1
    for b in range(bins):
        own = sorted(zip(at[of == b], lengths[of == b], strict=True))
        assert [a for a, _ in own] == [sum(n for _, n in own[:i]) for i in range(len(own))] and sum(n for _, n in own) <= 1024
    # The plain rule, item by item.
    rooms = []
    for n in sorted(lengths.tolist(), reverse=True):
        fit = [r for r in rooms if r >= n]
        if fit:
            rooms.remove(min(fit))
        rooms.append((min(fit) if fit else 1024) - n)
    assert bins == len(rooms) and packing.bin_bound(lengths) <= bins


def test_bound_counts_large_items():
    assert packing.bin_bound(np.full(7, 600)) == 7 and packing.bin_bound(np.full(9, 342)) == 5


def check(out, docs, library):
    by_doc, by_bin = defaultdict(list), defaultdict(list)
    for r in out.collect():
        by_doc[r.doc_id].append(r)
        by_bin[r.sequence_id].append((r.offset, r.length))
    assert set(by_doc) == set(docs)
    for i, rows in by_doc.items():
        ids = np.array([*library.encode(docs[i] or "", add_special_tokens=False).ids, 2], "<u4")
        rows.sort(key=lambda r: r.piece)
        assert [(r.start, r.length) for r in rows] == packing.cut(len(ids)) and [r.piece for r in rows] == list(range(len(rows)))
        assert all(r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes()) for r in rows)
    for own in by_bin.values():
        own.sort()
        assert [a for a, _ in own] == [sum(n for _, n in own[:i]) for i in range(len(own))] and sum(n for _, n in own) <= 1024
    return len(by_bin), sum(n for own in by_bin.values() for _, n in own)


def test_query(spark, library):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    out = queries.op7_packing(spark, SMALL)
    bins, _ = check(out, docs, library)
    lengths = np.array([r.length for r in out.select("length").collect()])
    assert bins <= 1.001 * packing.bin_bound(lengths) + 1  # of all pieces together, by dual-feasible functions


def test_exchange_between_partitions(spark, monkeypatch):
    monkeypatch.setattr(packing, "PARTITION_PIECES", 60)
    rng = np.random.default_rng(2)
    items = [(i, int(n)) for i, n in enumerate(rng.integers(1, 700, 1500))]
    placed = packing.pack(spark.createDataFrame(items, "uid long, length long")).collect()
    assert sorted(r.uid for r in placed) == list(range(1500))
    size = dict(items)
    fill = defaultdict(list)
    for r in placed:
        fill[r.bin].append((r.offset, size[r.uid]))
    for own in fill.values():
        own.sort()
        assert [a for a, _ in own] == [sum(n for _, n in own[:i]) for i in range(len(own))] and sum(n for _, n in own) <= 1024
    assert len(fill) <= 1.02 * packing.bin_bound(np.array([n for _, n in items])) + 1


def test_edges(spark, library):
    rows = [(1, None, "", ""), (2, "", "", ""), (3, "long words here " * 4000, "", ""), (4, "x", "", "")]
    df = spark.createDataFrame(rows, SCHEMA)
    check(packing.pack_documents(df, PATH), {i: t for i, t, *_ in rows}, library)
    assert packing.pack_documents(df.unionAll(df), PATH).count() == 2 * packing.pack_documents(df, PATH).count()
    assert packing.pack_documents(spark.createDataFrame([], SCHEMA), PATH).count() == 0
