"""Bound-certified best-fit packing of documents into fixed-length sequences.

A document is its token ids and an end id.  Only longer ones are cut: into whole sequences, with
the shorter rest as the first piece.  The rests and the short documents are dealt over partitions
of a bounded number of pieces.  Each partition packs best-fit decreasing and computes a lower
bound on its bins with dual-feasible functions.  A partition whose bins equal the bound is
certified: it keeps all of them but its emptiest.  A partition with a gap keeps its fullest bins
and offers several for each missing certificate.  Bins on offer move, whole, into new partitions
that pack them again, so documents change places between partitions; a new packing counts only if
it needs fewer bins.  Rounds end when a single partition has seen all offers or none improves.

Null texts count as empty; every document, even an empty one, has at least its end id.  Repeated
rows are packed each for itself.  An empty table gives an empty result.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm import bpe
from tessera.llm.shared import materialize, ship

CAPACITY = 1024
END_ID = 2
#: Pieces of a partition, on average.
PARTITION_PIECES = 2048
#: Bins that a partition offers for each bin above its bound, and rounds at most.
OFFERED, ROUNDS = 8, 6


def byte_alphabet() -> dict[str, int]:
    """The public byte-level alphabet: printable bytes stand for themselves, others for the code
    points from 256 up."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class JsonEncoder:
    """Ids by a byte-level tokenizer file, through the faster merge library.

    The library matches its pattern with a bounded stack and gives up on very long runs of white space;
    such a text goes through the slices of ``bpe``, which give the same ids without a pattern.  Ids equal
    those of the file's own library if merges are ranked as their results' ids; that is checked, and
    otherwise the file's own library encodes.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        self._own = None
        alphabet, vocab = byte_alphabet(), spec["model"]["vocab"]
        added = {x["content"]: x["id"] for x in spec.get("added_tokens", [])}
        merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        made = [vocab["".join(m)] for m in merges]
        pre = spec["pre_tokenizer"] or {}
        plain = pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True) and spec["normalizer"] is None
        plain = plain and all(a < b for a, b in zip(made, made[1:], strict=False)) and not any(x["lstrip"] or x["rstrip"] or x["single_word"] for x in spec.get("added_tokens", []))
        if plain:
            import public_tokenizers

            ranks = {bytes(alphabet[c] for c in token): i for token, i in vocab.items() if token not in added}
            self._encoding = tiktoken.Encoding("json", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=added)
            self._codec, self._special = bpe.Codec(ranks), added
            longest_first = sorted(added, key=len, reverse=True)
            self._parts = re.compile(f"({'|'.join(map(re.escape, longest_first))})") if added else None
        else:
            from tokenizers import Tokenizer

            self._own = Tokenizer.from_file(path)

    def encode(self, text: str) -> list[int]:
        if self._own is not None:
            return self._own.encode(text, add_special_tokens=False).ids
        try:
            return self._encoding.encode(text, allowed_special="all")
        except ValueError:
            return self.encode_slices(text)

    def encode_slices(self, text: str) -> list[int]:
        parts = self._parts.split(text) if self._parts else [text]
        return [*chain.from_iterable([self._special[part]] if part in self._special else self._codec.encode(part) for part in parts)]


@lru_cache(4)
def encoder(path: str) -> JsonEncoder:
    return JsonEncoder(path)


def cut(n: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document of n ids."""
    first = n % capacity or min(n, capacity)
    return [(0, first), *((start, capacity) for start in range(first, n, capacity))]


def pieces(df: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, piece, start, length, ids_crc32) of all documents."""
    ship(df.sparkSession)
    source = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    out = T.StructType([source.schema["id"], T.StructField("piece", T.IntegerType()), T.StructField("start", T.LongType()), T.StructField("length", T.LongType()), T.StructField("ids_crc32", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(tokenizer_path)
        for batch in batches:
            of, piece, start, length, crc = [], [], [], [], []
            for row, text in enumerate(batch.column(1)):
                ids = np.array([*own.encode(text.as_py()), end_id], "<u4")
                for k, (a, n) in enumerate(cut(len(ids), capacity)):
                    of.append(row)
                    piece.append(k)
                    start.append(a)
                    length.append(n)
                    crc.append(zlib.crc32(ids[a : a + n].tobytes()))
            arrays = [pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(of, pa.int64())), *arrays], names=out.names)

    return source.mapInArrow(run, out)


def best_fit_decreasing(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of each item: the longest first, each into the fullest bin that has room.
    ``open_at`` holds the bins by room left, ``mask`` has a bit for each room that occurs."""
    of, at = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    open_at: list[list[int]] = [[] for _ in range(capacity + 1)]
    mask, bins = 0, 0
    for item in np.argsort(-lengths, kind="stable").tolist():
        size = int(lengths[item])
        fits = mask >> size
        if fits:
            room = size + (fits & -fits).bit_length() - 1
            own = open_at[room].pop()
            if not open_at[room]:
                mask &= ~(1 << room)
        else:
            room, own, bins = capacity, bins, bins + 1
        of[item], at[item] = own, capacity - room
        if room > size:
            open_at[room - size].append(own)
            mask |= 1 << (room - size)
    return of, at


def bin_bound(lengths: np.ndarray, capacity: int = CAPACITY) -> int:
    """The best lower bound on the number of bins from two families of dual-feasible functions:
    those that round items above 1 - e up to a bin and items below e down to nothing, and those
    that round to the multiples of 1 / k."""
    count = np.bincount(lengths, minlength=capacity + 1).astype(np.int64)
    size = np.arange(capacity + 1)
    weight = np.cumsum(count * size)
    e = np.arange(1, capacity // 2 + 1)
    above = len(lengths) - np.cumsum(count)[capacity - e]
    best = int((above + -(-(weight[capacity - e] - weight[e - 1]) // capacity)).max(initial=0))
    best = max(best, -(-int(weight[-1]) // capacity))
    for k in range(1, 64):
        scaled = (k + 1) * size
        value = np.where(scaled % capacity == 0, k * size, scaled // capacity * capacity)
        best = max(best, -(-int((count * value).sum()) // (k * capacity)))
    return best


def repack(frame: pd.DataFrame, last: bool, capacity: int = CAPACITY) -> pd.DataFrame:
    """Pack a partition (uid, length, bin, offset) again; ``offer`` marks the bins it gives away."""
    frame = frame.sort_values("uid", kind="stable").reset_index(drop=True)
    lengths, uid = frame["length"].to_numpy(np.int64), frame["uid"].to_numpy(np.int64)
    of, at = best_fit_decreasing(lengths, capacity)
    bins = int(of.max()) + 1
    if frame["bin"].isna().any() or bins < frame["bin"].nunique():
        name = np.full(bins, np.iinfo(np.int64).max)
        np.minimum.at(name, of, uid)
        frame["bin"], frame["offset"] = name[of], at
    bound = bin_bound(lengths, capacity)
    names, inverse = np.unique(frame["bin"].to_numpy(np.int64), return_inverse=True)
    used = np.bincount(inverse, weights=lengths).astype(np.int64)
    gap = len(names) - bound
    offered = np.zeros(len(names), bool)
    if not last:
        offered[np.argsort(used, kind="stable")[: 1 + OFFERED * gap]] = True
        offered &= used < capacity
    return frame.assign(bin=frame["bin"].astype("int64"), offset=frame["offset"].astype("int64"), offer=offered[inverse], gap=np.int64(gap))


def _packer(last: bool, capacity: int):
    def run(frame: pd.DataFrame) -> pd.DataFrame:
        return repack(frame[["uid", "length", "bin", "offset"]], last, capacity)

    return run


PLACED = "uid long, length long, bin long, offset long, offer boolean, gap long"


def pack(items: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``items`` (uid, length below ``capacity``) to (uid, bin, offset); a bin is named by its
    smallest uid."""
    spark = items.sparkSession
    ship(spark)
    open_items = items.select("uid", "length", F.lit(None).cast("long").alias("bin"), F.lit(None).cast("long").alias("offset"))
    left, closed = items.count(), None
    for turn in range(ROUNDS):
        if not left:
            break
        parts = -(-left // PARTITION_PIECES)
        last = parts == 1 or turn == ROUNDS - 1
        # Bins move as a whole, so that what a partition gets is a packing it can compare with.
        part = F.pmod(F.xxhash64(F.coalesce("bin", "uid"), F.lit(turn)), F.lit(parts))
        run = _packer(last, capacity)
        placed = open_items.withColumn("part", part).groupBy("part").applyInPandas(run, PLACED)
        placed = materialize(placed, "packed")
        kept = placed.filter("not offer").select("uid", "bin", "offset")
        closed = kept if closed is None else closed.unionAll(kept)
        open_items = placed.filter("offer").select("uid", "length", "bin", "offset")
        left = 0 if last else open_items.count()
    if closed is None:
        return items.select("uid", F.lit(0).cast("long").alias("bin"), F.lit(0).cast("long").alias("offset"))
    return closed


def pack_documents(df: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, piece, start, length, ids_crc32, sequence_id, offset): where every piece of every
    document lies; a whole piece is a sequence by itself."""
    every = pieces(df, tokenizer_path, capacity, end_id, id_col, text_col).withColumn("uid", F.monotonically_increasing_id())
    every = materialize(every, "pieces")
    whole = every.filter(F.col("length") == capacity).select("*", F.col("uid").alias("bin"), F.lit(0).cast("long").alias("offset"))
    short = every.filter(F.col("length") < capacity)
    short = short.join(pack(short.select("uid", "length"), capacity), "uid").select(*every.columns, "bin", "offset")
    both = whole.unionAll(short)
    return both.select(F.col("id").alias(id_col), "piece", "start", "length", "ids_crc32", F.col("bin").alias("sequence_id"), "offset")
