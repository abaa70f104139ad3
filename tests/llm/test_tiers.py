import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from conftest import SMALL
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tessera.llm import queries, tiers

PATH = public_tokenizers.path("word_bpe_49k.json")
OWN = Tokenizer.from_file(PATH)
SCHEMA = "doc_id long, text string, ids string, window string, sequence_id string, step_group string"


def plain(text):
    return OWN.encode(text or "", add_special_tokens=False).ids


def ids(text):
    return np.frombuffer(tiers.encoder(PATH).encode(text), "<u4").tolist()


def test_file_takes_the_faster_way():
    assert tiers.encoder(PATH).fast


@pytest.mark.parametrize("unit", ["", "It's WE'LL they'Re 'D", "a<|endoftext|>b <|startoftext|>", "naïve ÀÉ İi İx", "你好 é ﬁ", "x" * 3000, "1234 ²¾ ª º", "\x00\x01\x02 \x1c\x1d\x1e\x1f y", "a b\u0085c\td  \n", "!!!??? #$%'s's", "Ǆ ǅ Ș ﬀ ɏ"])
def test_ids_equal_the_library(unit):
    assert ids(unit) == plain(unit)


def test_every_simple_character_and_token():
    for c in range(tiers.SIMPLE):
        text = f"a{chr(c)}b {chr(c)}{chr(c)}1"
        assert ids(text) == plain(text), c
    words = [t.removesuffix("</w>") for t in list(OWN.get_vocab())[::7] if t.isascii()]
    assert [ids(w) for w in words] == [plain(w) for w in words]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["'s", "'", "the", "Tion", "É", "ß", " ", "\n", "\t", "7", "²", "!?", "_", " ", "İ", "œ", "µ", "ª"]), max_size=30).map("".join))
def test_random_texts_equal_the_library(text):
    assert ids(text) == plain(text)


@pytest.mark.parametrize("seed", range(30))
def test_stretches(seed):
    rng = np.random.default_rng(seed)
    most = int(rng.choice([2048, 300, 20]))
    rests = [(i, 5, int(n)) for i, n in enumerate(rng.integers(int(rng.choice([1, most // 2])), most + 1, int(rng.integers(1, 400))))]
    windows, left = tiers.pack_stretch(rests)
    for size, pieces in windows:
        assert size in tiers.TIERS and sum(n for *_, n in pieces) == size
    assert sum(n for *_, n in left) < tiers.TIERS[-1]
    spans = defaultdict(list)
    for doc, start, n in [p for _, pieces in windows for p in pieces] + left:
        spans[doc].append((start, n))
    for doc, start, n in rests:
        at = start
        for a, m in sorted(spans.pop(doc)):
            assert a == at and m > 0
            at += m
        assert at == start + n
    assert not spans
    closed = tiers.pack_end(left)
    assert sum(n for _, own in closed for *_, n in own) == sum(n for *_, n in left)
    assert all(sum(n for *_, n in own) == size for size, own in closed[:-1])
    assert not closed or sum(n for *_, n in closed[-1][1]) == closed[-1][0] or sum(n for *_, n in closed[-1][1]) < tiers.TIERS[0]


def test_gaps_take_whole_documents_of_shorter_tiers():
    windows, left = tiers.pack_stretch([(0, 0, 2000), (1, 0, 40), (2, 0, 8), (3, 0, 1000), (4, 0, 24)])
    assert windows == [(2048, [(0, 0, 2000), (1, 0, 40), (2, 0, 8)]), (1024, [(3, 0, 1000), (4, 0, 24)])] and not left


def check(out, docs, step_tokens=tiers.STEP_TOKENS):
    """All contract properties; returns the tokens and the padding."""
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in out.collect():
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
    assert set(by_doc) == {i for i, _ in docs}
    copies = Counter(i for i, _ in docs)
    for i, text in docs:
        if copies[i] > 1:
            continue
        own = np.array([*plain(text), 1], "<u4")
        at = 0
        for r in sorted(by_doc[i], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(own) and r.ids_crc32 == zlib.crc32(own[at : at + r.length].tobytes())
            at += r.length
        assert at == len(own)
    tokens = padding = 0
    groups = defaultdict(list)
    for rows in by_sequence.values():
        rows.sort(key=lambda r: r.offset)
        assert [r.offset for r in rows] == [sum(x.length for x in rows[:i]) for i in range(len(rows))]
        assert len({(r.window, r.step_group) for r in rows}) == 1
        size = sum(r.length for r in rows)
        assert size <= rows[0].window <= 2048
        tokens += size
        padding += 0 if size & (size - 1) == 0 else 2048 - size
        groups[rows[0].window, rows[0].step_group].append(sum(r.length**2 for r in rows))
    by_tier = defaultdict(list)
    for (window, _), costs in groups.items():
        assert len(costs) <= step_tokens // window
        by_tier[window].append(costs)
    for costs in by_tier.values():
        assert max(map(len, costs)) - min(map(len, costs)) <= 1
    assert len({g for _, g in groups}) == len(groups)
    return tokens, padding, by_tier


def test_query(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    tokens, padding, _ = check(queries.op12_tiers(spark, SMALL), docs)
    assert tokens == sum(len(plain(t)) + 1 for _, t in docs) and padding < 2048


def test_rounds_and_balance(spark):
    """Small stretches over many tasks, so that ends of tasks meet in several rounds."""
    rng = np.random.default_rng(1)
    docs = [(i, "the " * int(n)) for i, n in enumerate(rng.integers(0, 700, 900))]
    df = spark.createDataFrame([(*d, "", "", "", "") for d in docs], SCHEMA).repartition(24)
    out = tiers.pack_documents(df, PATH, stretch=4096, step_tokens=8192)
    _, padding, by_tier = check(out, docs, 8192)
    assert padding < 2048
    sums = [sum(c) / len(c) for c in by_tier[1024]]
    plain_order = np.array([x for c in by_tier[1024] for x in c])
    assert np.std(sums) < 0.5 * plain_order.std()


def test_edges(spark):
    docs = [(1, None), (2, ""), (None, "x y"), (4, "long words here " * 40_000), (5, "z"), (5, "z")]
    df = spark.createDataFrame([(*d, "", "", "", "") for d in docs], SCHEMA)
    check(tiers.pack_documents(df, PATH), docs)
    held = tiers.pack_documents(df, PATH, with_ids=True).filter("doc_id = 4").orderBy("start").collect()
    assert b"".join(r.ids for r in held) == np.array([*plain(docs[3][1]), 1], "<u4").tobytes()
    assert tiers.pack_documents(spark.createDataFrame([], SCHEMA), PATH).count() == 0
