"""Byte-level BPE encoding and decoding with vectorised pre-tokenisation.

A text becomes an array of code points, that an array of classes (letter, number, white space,
other), and that, with a look at no more than two code points ahead, an array of symbols.  A small
automaton reads the symbols: its states say what run the last code point belongs to, and whether
the next one may start a token.  Each symbol is a transition function on the states; functions
compose associatively, the functions that ever arise are few and numbered, and so an inclusive scan
over the text is a handful of look-ups in a table of compositions, each over twice the distance of
the last.  It ends as soon as every function is constant, since nothing further left matters then.
No regular expression runs over the text.

The slices between token starts go through a cache of merged pairs.  The UTF-8 offsets of the
tokens are kept, and decoding places each token's bytes at its offset, so that any range of bytes
can be decoded by itself.

Nulls count as empty texts.  An empty text has no tokens and decodes to no bytes.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.shared import free_name, ship

OTHER, LETTER, NUMBER, SPACE = 0, 1, 2, 3
#: Endings that follow an apostrophe as one token, by their length.
ONE_LETTER_ENDINGS = "stmd"
TWO_LETTER_ENDINGS = ("re", "ve", "ll")
#: Distinct slices a worker keeps; beyond it the cache starts anew.
CACHE_SLICES = 300_000
#: Longer slices are merged each time: they hardly ever repeat.
CACHED_LENGTH = 48


@lru_cache(1)
def class_table() -> np.ndarray:
    """The class of every code point, as the merge library's own character classes have it."""
    every = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    text = "".join(map(chr, every))
    single = {bytes([i]): i for i in range(256)}
    table = np.zeros(0x110000, np.uint8)
    for pattern, kind in ((r"\p{L}", LETTER), (r"\p{N}", NUMBER), (r"\s", SPACE)):
        probe = tiktoken.Encoding("probe", pat_str=pattern, mergeable_ranks=single, special_tokens={})
        found = bytes(probe.encode_ordinary(text)).decode("utf-8")
        table[np.frombuffer(found.encode("utf-32-le"), np.uint32)] = kind
    return table


def code_points(text: str) -> np.ndarray:
    if text.isascii():
        return np.frombuffer(text.encode("ascii"), np.uint8)
    return np.frombuffer(text.encode("utf-32-le"), np.uint32)


#: Symbols beyond the classes OTHER, LETTER and NUMBER: white space before more of it (or the end), the
#: last white space of a run, the same if it is a blank, and an apostrophe with an ending of one or two
#: letters.
WHITE, EDGE, BLANK, QUOTE_1, QUOTE_2 = 3, 4, 5, 6, 7
#: States beyond those named after the runs (OTHER, LETTER, NUMBER, WHITE): a blank that what follows
#: joins, a token that has ended (also the initial state), and one or two letters of an ending to come.
JOIN, ENDED, ENDING_1, ENDING_2 = 4, 5, 6, 7
STATES = SYMBOLS = 8


def step(state: int, symbol: int) -> tuple[int, bool]:
    """The next state, and whether the symbol's code point starts a token."""
    if state in (ENDING_1, ENDING_2) and symbol == LETTER:  # no other symbol follows there
        return (ENDED, False) if state == ENDING_1 else (ENDING_1, False)
    if symbol in (EDGE, BLANK):
        return (ENDED if symbol == EDGE else JOIN), True
    run = OTHER if symbol in (QUOTE_1, QUOTE_2) else symbol
    if state in (run, JOIN):
        return run, False
    return {QUOTE_1: ENDING_1, QUOTE_2: ENDING_2}.get(symbol, symbol), True


@lru_cache(1)
def automaton() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The transition functions that symbols generate, by number (symbols come first): the table of their
    compositions (left one first), which are constant, where they lead from the initial state, and for
    each state and symbol whether a token starts."""
    functions = [tuple(step(state, symbol)[0] for state in range(STATES)) for symbol in range(SYMBOLS)]
    number = {f: i for i, f in enumerate(functions)}
    table: dict[tuple[int, int], int] = {}
    at = 0
    while at < len(functions):
        for other in range(at + 1):
            for i, j in ((at, other), (other, at)):
                made = tuple(functions[j][state] for state in functions[i])
                if made not in number:
                    number[made] = len(functions)
                    functions.append(made)
                table[i, j] = number[made]
        at += 1
    composed = np.empty((len(functions), len(functions)), np.int32)
    for (i, j), k in table.items():
        composed[i, j] = k
    constant = np.array([len(set(f)) == 1 for f in functions])
    reached = np.array([f[ENDED] for f in functions])
    starts = np.array([[step(state, symbol)[1] for symbol in range(SYMBOLS)] for state in range(STATES)])
    return composed, constant, reached, starts


def symbols(points: np.ndarray) -> np.ndarray:
    out = class_table()[points].astype(np.int32)
    white = out == SPACE
    edge = np.flatnonzero(white[:-1] & ~white[1:])
    out[edge] = np.where(points[edge] == 32, BLANK, EDGE)
    quote = np.flatnonzero(points[:-1] == 39)
    if len(quote):
        first, second = points[quote + 1], points[np.minimum(quote + 2, len(points) - 1)]
        short, long = np.isin(first, list(map(ord, ONE_LETTER_ENDINGS))), np.zeros(len(quote), bool)
        for a, b in TWO_LETTER_ENDINGS:
            long |= (first == ord(a)) & (second == ord(b)) & (quote + 2 < len(points))
        out[quote[short]], out[quote[long]] = QUOTE_1, QUOTE_2
    return out


def token_starts(points: np.ndarray) -> np.ndarray:
    """Positions, in code points, at which pre-tokens start."""
    if not len(points):
        return np.empty(0, np.int64)
    composed, constant, reached, starts = automaton()
    own = symbols(points)
    scan, reach = own, 1  # scan[i] composes the functions of the last ``reach`` symbols up to i
    while reach < len(own) and not constant[scan[reach:]].all():
        scan = np.concatenate((scan[:reach], composed[scan[:-reach], scan[reach:]]))
        reach *= 2
    before = np.concatenate(([ENDED], reached[scan[:-1]]))
    return np.flatnonzero(starts[before, own])


def pre_tokens(text: str) -> list[str]:
    starts = token_starts(code_points(text)).tolist()
    return [text[a:b] for a, b in zip(starts, [*starts[1:], len(text)], strict=False)]


class Codec:
    """Encodes and decodes by a table of ranks (token bytes to rank)."""

    def __init__(self, ranks: dict[bytes, int]):
        most = max(ranks.values(), default=-1) + 1
        self.decimal = {rank: str(rank) for rank in ranks.values()}
        # All tokens' bytes in a row, and where each rank's begin.
        self.sizes, self.begins = np.zeros(most, np.int64), np.zeros(most, np.int64)
        ordered = sorted(ranks.items(), key=lambda x: x[1])
        names = [rank for _, rank in ordered]
        self.sizes[names] = [len(token) for token, _ in ordered]
        self.begins[names] = np.cumsum(self.sizes[names]) - self.sizes[names]
        self.flat = np.frombuffer(b"".join(token for token, _ in ordered), np.uint8)
        # The library merges a slice; its own pattern takes all it is given as one.
        self._merge = tiktoken.Encoding("slices", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self._cache: dict[str, list[int]] = {}

    @classmethod
    def from_rank_file(cls, path: str) -> Codec:
        with open(path, "rb") as lines:
            return cls({base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())})

    def slice_ids(self, piece: str) -> list[int]:
        ids = self._cache.get(piece)
        if ids is None:
            ids = self._merge(piece)
            if len(piece) <= CACHED_LENGTH:
                if len(self._cache) >= CACHE_SLICES:
                    self._cache.clear()
                self._cache[piece] = ids
        return ids

    def encode(self, text: str) -> list[int]:
        pieces = pre_tokens(text)
        try:
            return list(chain.from_iterable(map(self._cache.__getitem__, pieces)))
        except KeyError:
            return list(chain.from_iterable(map(self.slice_ids, pieces)))

    def offsets(self, ids: list[int] | np.ndarray) -> np.ndarray:
        """The UTF-8 offset of every token, and of the end."""
        return np.concatenate(([0], np.cumsum(self.sizes[np.asarray(ids, np.int64)])))

    def decode(self, ids: list[int] | np.ndarray, offsets: np.ndarray | None = None, begin: int = 0, end: int | None = None) -> bytes:
        """The bytes from ``begin`` to ``end`` of what ``ids`` encode; only tokens that lie there, by their
        ``offsets``, are looked at."""
        ids = np.asarray(ids, np.int64)
        offsets = self.offsets(ids) if offsets is None else np.asarray(offsets, np.int64)
        end = int(offsets[-1]) if end is None else min(end, int(offsets[-1]))
        if begin >= end:
            return b""
        first, last = int(np.searchsorted(offsets, begin, "right")) - 1, int(np.searchsorted(offsets, end, "left"))
        own, place = ids[first:last], offsets[first : last + 1]
        # Byte i of the result is byte i + (where its token begins in the table - where it lies here).
        spot = np.repeat(self.begins[own] - place[:-1], np.diff(place)) + np.arange(place[0], place[-1])
        return self.flat[spot[begin - place[0] : end - place[0]]].tobytes()


@lru_cache(4)
def codec(path: str) -> Codec:
    return Codec.from_rank_file(path)


ENCODED = T.StructType([
    T.StructField("ids", T.ArrayType(T.IntegerType(), False), False),
    T.StructField("offsets", T.ArrayType(T.LongType(), False), False),
])


def encode_documents(df: DataFrame, ranks_path: str, text_col: str = "text") -> DataFrame:
    """``df`` with ``ids`` (array<int>) and ``offsets`` (array<long>, one more than ids: UTF-8
    offsets of the tokens and the end).  Columns of those names in ``df`` are replaced."""
    ship(df.sparkSession)

    @F.pandas_udf(ENCODED)
    def encode(texts):
        import pandas as pd

        own = codec(ranks_path)
        ids = [own.encode(t or "") for t in texts]
        return pd.DataFrame({"ids": ids, "offsets": [own.offsets(x) for x in ids]})

    name = free_name(df.columns, "encoded")
    made = df.withColumn(name, encode(F.col(text_col).cast("string")))
    return made.withColumns({"ids": F.col(name)["ids"], "offsets": F.col(name)["offsets"]}).drop(name)


def decode_documents(df: DataFrame, ranks_path: str, ids_col: str = "ids", offsets_col: str = "offsets") -> DataFrame:
    """``df`` with ``decoded`` (binary): the bytes of its ids, each at its offset; null ids decode to no
    bytes."""
    ship(df.sparkSession)

    @F.pandas_udf(T.BinaryType())
    def decode(ids, offsets):
        import pandas as pd

        own = codec(ranks_path)
        return pd.Series([own.decode(x, at) if x is not None else b"" for x, at in zip(ids, offsets, strict=True)])

    return df.withColumn("decoded", decode(ids_col, offsets_col))


def round_trip(df: DataFrame, ranks_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode every text, decode its ids, and return what identifies both: id, ``n_tokens``,
    ``ids_sha256`` and ``decoded_sha256``.  One pass, narrow output, no shuffle."""
    ship(df.sparkSession)
    source = df.select(F.col(id_col), F.col(text_col).cast("string").alias(free_name([id_col], "text")))
    id_field = source.schema[0]
    out = T.StructType([id_field, T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(ranks_path)
        decimal = own.decimal
        for batch in batches:
            counts, id_hashes, byte_hashes = [], [], []
            for value in batch.column(1):
                ids = own.encode(value.as_py() or "")
                offsets = own.offsets(ids)
                counts.append(len(ids))
                id_hashes.append(hashlib.sha256(",".join(map(decimal.__getitem__, ids)).encode()).hexdigest())
                byte_hashes.append(hashlib.sha256(own.decode(ids, offsets)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(id_hashes, pa.string()), pa.array(byte_hashes, pa.string())], names=out.names)

    return source.mapInArrow(run, out)
