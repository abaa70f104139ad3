import base64
import hashlib

import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import bpe

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
RANKS = {base64.b64decode(a): int(b) for a, b in (line.split() for line in open(PATH, "rb"))}
LIBRARY = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})
SCHEMA = "doc_id long, text string, ids string"


@settings(max_examples=600, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from(list("  \n\t'''stmdrevlXab9é你٣!?-_\u00a0\u3000\U0001f600")), st.characters(exclude_categories=["Cs"])), max_size=40))
def test_ids_equal_the_library(text):
    own = bpe.codec(PATH)
    ids = own.encode(text)
    assert ids == LIBRARY.encode_ordinary(text)
    assert own.decode(ids) == text.encode()
    offsets = own.offsets(ids)
    assert offsets[-1] == len(text.encode()) and [own.decode(ids, offsets, a, b) for a, b in zip(offsets, offsets[1:])] == [LIBRARY.decode_single_token_bytes(i) for i in ids]
    data = text.encode()
    assert all(own.decode(ids, offsets, a, b) == data[a:b] for a in range(0, len(data), 3) for b in range(a, len(data) + 2, 5))


def test_scan_equals_the_automaton_step_by_step():
    text = " It's  we'd'\n 12ab!!'ll x'ver\t\tend '' \u3000z"
    state, want = bpe.ENDED, []
    for i, symbol in enumerate(bpe.symbols(bpe.code_points(text)).tolist()):
        state, starts = bpe.step(state, symbol)
        want += [i] * starts
    assert bpe.token_starts(bpe.code_points(text)).tolist() == want
    assert len(bpe.automaton()[0]) < 64  # so few functions arise


@pytest.mark.parametrize("text", [" " * 1_000_000 + "x", "\n" * 1_000_000, "^" * 300_000, "'s" * 200_000, "a'" * 100_000])
def test_long_runs(text):
    own = bpe.codec(PATH)
    ids = own.encode(text)
    assert own.decode(ids, own.offsets(ids)) == text.encode()


@pytest.mark.parametrize("text", ["", " ", "   x", "a" * 300_000, "it's' 're ''ll", "x\r\n\r\n  y", "'" * 50, "don't 'tis we'd've", "<|endoftext|>"])
def test_edges(text):
    own = bpe.codec(PATH)
    assert own.encode(text) == LIBRARY.encode_ordinary(text) and own.decode(own.encode(text)) == text.encode()


def test_cache_starts_anew(monkeypatch):
    monkeypatch.setattr(bpe, "CACHE_SLICES", 3)
    own = bpe.Codec.from_rank_file(PATH)
    text = "one two three four five six one two"
    assert own.encode(text) == LIBRARY.encode_ordinary(text) == own.encode(text)


def test_operators(spark):
    rows = [(1, "Hello world's end", "x"), (1, "Hello world's end", "x"), (2, "", "y"), (None, None, None), (4, "naïve 你好 " * 2000, "z")]
    df = spark.createDataFrame(rows, SCHEMA)
    out = bpe.round_trip(df, PATH).collect()
    assert len(out) == 5
    for r in out:
        text = next(t or "" for i, t, _ in rows if i == r.doc_id)
        ids = LIBRARY.encode_ordinary(text)
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())
    encoded = bpe.encode_documents(df, PATH)
    assert encoded.columns == ["doc_id", "text", "ids", "offsets"]
    for r in bpe.decode_documents(encoded, PATH).collect():
        assert bytes(r.decoded) == (r.text or "").encode() and len(r.offsets) == len(r.ids) + 1
    assert bpe.round_trip(df.limit(0), PATH).count() == 0
