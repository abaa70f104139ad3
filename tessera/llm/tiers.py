"""Packing of documents into training sequences of several lengths, without padding.

A document is its token ids and an end id.  Sequences have the length of a tier, a power of two.  What
fills the longest tier's windows by itself is cut off whole; the rest of a document goes to the shortest
tier that holds it.  Tiers are packed from the longest down.  In a tier, the longest rest opens a window;
its gap is filled with the longest rests of shorter tiers that fit, then with the head of a longer one,
whose tail goes back to its own tier.  When shorter tiers run out, rests of the same tier fill the gap.
So every window of every tier is full, and documents are cut only where a gap is left that none fits.

All this happens where the documents are read: a task packs its tokens in stretches of a bounded number,
so token ids never travel.  What does not fill a window goes into the next stretch, and at the end of a
task on to a further round, where the ends of many tasks are packed together in the same way.  The last
round's last window, the only one in the whole output, is cut into shorter tiers as far as it fills them.

Sequences are then dealt to step groups: the sequences of a tier, in order of their attention cost (the sum
of the squares of their pieces), are dealt back and forth over as many groups as make up a step's tokens,
so that all steps of a tier take the same tokens and nearly the same time.

Null texts count as empty; every document, even an empty one, has its end id.  Repeated rows are documents
of their own, and null ids are kept.  An empty table gives an empty result.
"""

from __future__ import annotations

import json
import re
import unicodedata
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.order import numbered
from tessera.llm.packing import byte_alphabet
from tessera.llm.shared import broadcast_if_small, materialize, ship

TIERS = (256, 512, 1024, 2048)
END_ID = 1
#: Tokens that a task packs at a time.
STRETCH = 1 << 20
#: Tokens of a step.
STEP_TOKENS = 1 << 16
#: Words that a worker keeps the ids of.
CACHED_WORDS = 300_000
#: (Tier) rows that may be broadcast: one a tier.
SMALL_TIERS = 64

#: What the tokenizer's file must say for the faster way to give its ids.
NORMALIZERS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Texts of characters below this go the faster way; no character there composes with another.
SIMPLE = 0x250
#: What the file's own library takes for white space, below ``SIMPLE``.
SPACE = "\t\n\x0b\x0c\r \x85\xa0"
#: Stands for the end of a word; texts that have it go the slower way.
END_OF_WORD = "\x01"


def _class(kinds: str) -> str:
    """The plain characters, lowered or not, of these kinds."""
    known = {x for c in range(SIMPLE) for x in chr(c) + chr(c).lower()}
    return "".join(re.escape(c) for c in sorted(known) if unicodedata.category(c)[0] in kinds)


class WordIds(dict):
    """The ids of words, worked out when first asked for."""

    def __init__(self, encoding: tiktoken.Encoding):
        super().__init__()
        self.encoding = encoding

    def __missing__(self, word: str) -> bytes:
        if len(self) >= CACHED_WORDS:
            self.clear()
        self[word] = ids = np.array(self.encoding.encode_ordinary(word + END_OF_WORD), "<u4").tobytes()
        return ids


class WordEncoder:
    """Ids by a tokenizer file that lowers its texts and marks the ends of words.

    Words of plain texts are found by an equal pattern and looked up in a cache; the merge library encodes
    those that are not there, with the mark of a word's end as one more byte, which merges first as the
    file's ids of marked bytes come before those of all merges.  Texts with other characters, with the
    mark or with a special token, and files of another form, go through the file's own library.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        self._own = Tokenizer.from_file(path)
        model, alphabet = spec["model"], byte_alphabet()
        mark, vocab = model.get("end_of_word_suffix"), model["vocab"]
        added = {x["content"]: x["id"] for x in spec.get("added_tokens", [])}
        self.fast = mark == "</w>" and (spec["normalizer"] or {}).get("normalizers") == NORMALIZERS
        parts = (spec["pre_tokenizer"] or {}).get("pretokenizers", [])
        self.fast = self.fast and len(parts) == 2 and parts[0] == {"type": "Split", "pattern": {"Regex": SPLIT}, "behavior": "Removed", "invert": True} and parts[1]["type"] == "ByteLevel" and not parts[1]["add_prefix_space"] and not parts[1]["use_regex"]
        merges = ["".join(m.split(" ") if isinstance(m, str) else m) for m in model["merges"]]
        made = [vocab[m] for m in merges]
        self.fast = self.fast and made == list(range(512, 512 + len(made))) and not model.get("ignore_merges")
        if not self.fast:
            return
        self._slow = re.compile("|".join([f"[^\x00-{chr(SIMPLE - 1)}]", re.escape(END_OF_WORD), *map(re.escape, sorted(added))]))
        letter, number = _class("L"), _class("N")
        self._words = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{letter}]+|[{number}]|[^{SPACE}{letter}{number}]+").findall
        end = END_OF_WORD.encode()
        ranks = {}
        for token, i in vocab.items():
            if token in added:
                continue
            body = token.removesuffix("</w>")
            ranks[bytes(alphabet[c] for c in body) + (end if body != token else b"")] = i
        self._cache = WordIds(tiktoken.Encoding("words", pat_str=r"(?s).+", mergeable_ranks=ranks, special_tokens={}))

    def encode(self, text: str) -> bytes:
        """The ids as little-endian 32-bit numbers."""
        if not self.fast or self._slow.search(text):
            return np.array(self._own.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        return b"".join(map(self._cache.__getitem__, self._words(text.lower())))


@lru_cache(4)
def encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


class Rests:
    """Rests of documents by length; ``mask`` has a bit for each length that occurs."""

    def __init__(self, longest: int):
        self.of: list[list[tuple[int, int]]] = [[] for _ in range(longest + 1)]
        self.mask = 0

    def put(self, doc: int, start: int, length: int) -> None:
        self.of[length].append((doc, start))
        self.mask |= 1 << length

    def longest(self, most: int) -> int:
        """The longest length of at most ``most``, or 0."""
        return (self.mask & ((1 << (most + 1)) - 1)).bit_length() - 1 if self.mask & ((1 << (most + 1)) - 1) else 0

    def take(self, length: int) -> tuple[int, int]:
        doc, start = self.of[length].pop()
        if not self.of[length]:
            self.mask &= ~(1 << length)
        return doc, start


Piece = tuple[int, int, int]  # document, start, length


def pack_stretch(rests: list[Piece], tiers: tuple[int, ...] = TIERS) -> tuple[list[tuple[int, list[Piece]]], list[Piece]]:
    """Pack rests of documents, none longer than the longest tier, into full windows: (tier, pieces) of
    each, and the pieces left over, which fill no window."""
    held = Rests(tiers[-1])
    for piece in rests:
        held.put(*piece)
    windows, left = [], []
    for nth in reversed(range(len(tiers))):
        size, shorter = tiers[nth], tiers[nth - 1] if nth else 0
        while (length := held.longest(size)) > shorter:
            doc, start = held.take(length)
            pieces, gap = [(doc, start, length)], size - length
            while gap and held.mask:
                # What fits, the longest first; of a shorter tier if there is one.
                if fit := held.longest(gap):
                    doc, start = held.take(fit)
                    pieces.append((doc, start, fit))
                    gap -= fit
                    continue
                # Nothing fits: the head of a longer one, of the longest of a shorter tier or else of this.
                cut = held.longest(shorter) or held.longest(size)
                doc, start = held.take(cut)
                pieces.append((doc, start, gap))
                held.put(doc, start + gap, cut - gap)
                gap = 0
            if gap:
                left += pieces
            else:
                windows.append((size, pieces))
    return windows, left


def pack_end(pieces: list[Piece], tiers: tuple[int, ...] = TIERS) -> list[tuple[int, list[Piece]]]:
    """The last pieces of all, cut into the longest tiers they fill; at most one window stays open."""
    windows, pieces = [], sorted(pieces, key=lambda p: -p[2])
    for size in reversed(tiers):
        while sum(n for *_, n in pieces) >= size:
            own, room = [], size
            while room:
                doc, start, n = pieces.pop(0)
                own.append((doc, start, min(n, room)))
                if n > room:
                    pieces.insert(0, (doc, start + room, n - room))
                room -= min(n, room)
            windows.append((size, own))
    return [*windows, (tiers[0], pieces)] if pieces else windows


PLACED = T.StructType().add("start", "long").add("length", "long").add("ids_crc32", "long").add("doc_tokens", "long").add("sequence_id", "long").add("offset", "long").add("window", "integer").add("ids", "binary")


def _packed(rows: Iterator[tuple[object, int, int, bytes]], numbers: Iterator[int], tiers: tuple[int, ...], last: bool, stretch: int) -> Iterator[list[tuple]]:
    """Rows (id, start, tokens of its document, ids) to lists of (id, *PLACED).  What is left over has no
    sequence, unless this is the last round."""
    docs: list[tuple[object, int, int, bytes]] = []
    rests: list[Piece] = []
    longest, held = tiers[-1], 0

    def placed(size: int, pieces: list[Piece], number: int | None) -> Iterator[tuple]:
        at = 0
        for doc, start, n in pieces:
            of, base, tokens, ids = docs[doc]
            own = ids[4 * start : 4 * (start + n)]
            yield of, base + start, n, zlib.crc32(own), tokens, number, at, size, own
            at += n

    def packed() -> list[tuple]:
        nonlocal docs, rests, held
        windows, left = pack_stretch(rests, tiers)
        out = [row for size, pieces in windows for row in placed(size, pieces, next(numbers))]
        # The pieces left over become documents of the next stretch.
        docs = [(docs[d][0], docs[d][1] + a, docs[d][2], docs[d][3][4 * a : 4 * (a + n)]) for d, a, n in left]
        rests = [(i, 0, len(x[3]) // 4) for i, x in enumerate(docs)]
        held = sum(n for *_, n in rests)
        return out

    for row in rows:
        n = len(row[3]) // 4
        docs.append(row)
        whole = n // longest * longest
        if whole:
            yield [x for a in range(0, whole, longest) for x in placed(longest, [(len(docs) - 1, a, longest)], next(numbers))]
        if n > whole:
            rests.append((len(docs) - 1, whole, n - whole))
        held += n
        if held >= stretch:
            yield packed()
    yield packed()
    if last:
        yield [row for size, pieces in pack_end(rests, tiers) for row in placed(size, pieces, next(numbers))]
    else:
        yield [row for p in rests for row in placed(0, [p], None)]


def _task_numbers(turn: int) -> Iterator[int]:
    """Numbers that no other task of any round gives: round, task, count."""
    first = (turn << 56) + (TaskContext.get().partitionId() << 32)
    count = 0
    while True:
        yield first + count
        count += 1


def _batches(placed: Iterator[list[tuple]], schema: pa.Schema, with_ids: bool, rows: int = 4096) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for some in placed:
        # The ids travel on only where the piece still needs a place, or where they are asked for.
        held += [x if with_ids or x[5] is None else (*x[:8], None) for x in some]
        for at in range(0, len(held) - rows + 1, rows):
            yield _batch(held[at : at + rows], schema)
        held = held[len(held) // rows * rows :]
    yield _batch(held, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [[]] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(list(c), kind.type) for c, kind in zip(columns, schema, strict=True)], schema=schema)


def attention_cost(lengths: Column) -> Column:
    return F.sum(lengths * lengths)


def pack_documents(
    df: DataFrame, tokenizer_path: str, tiers: tuple[int, ...] = TIERS, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text", *,
    step_tokens: int = STEP_TOKENS, stretch: int = STRETCH, with_ids: bool = False,
) -> DataFrame:
    """(id, start, length, ids_crc32, doc_tokens, sequence_id, offset, window, step_group [, ids]): where every
    piece of every document lies.  ``window`` is the length of its sequence's tier; ``ids`` are little-endian
    32-bit numbers."""
    from pyspark.sql.pandas.types import to_arrow_schema

    spark = df.sparkSession
    ship(spark)
    source = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    schema = T.StructType([source.schema["id"], *PLACED])
    arrow = to_arrow_schema(schema)
    end = np.array([end_id], "<u4").tobytes()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(tokenizer_path)

        def rows() -> Iterator[tuple[object, int, int, bytes]]:
            for batch in batches:
                for of, text in zip(batch.column(0), batch.column(1), strict=True):
                    ids = own.encode(text.as_py()) + end
                    yield of.as_py(), 0, len(ids) // 4, ids

        yield from _batches(_packed(rows(), _task_numbers(0), tiers, False, stretch), arrow, with_ids)

    def again(turn: int, last: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            rows = ((r["id"], r["start"], r["doc_tokens"], r["ids"]) for batch in batches for r in batch.to_pylist())
            yield from _batches(_packed(rows, _task_numbers(turn), tiers, last, stretch), arrow, with_ids)

        return run

    made = materialize(source.mapInArrow(encode, schema), "packed")
    done, turn = made.filter("sequence_id is not null"), 0
    while True:
        rest = made.filter("sequence_id is null")
        tokens = rest.agg(F.sum("length")).first()[0] or 0
        if not tokens:
            break
        # Each round leaves less than a window a task; the last one is a single task's stretch.
        turn, parts = turn + 1, -(-tokens // stretch)
        rest = rest.select("id", "start", "doc_tokens", "ids")
        dealt = rest.coalesce(1) if parts == 1 else rest.repartition(parts)
        made = materialize(dealt.mapInArrow(again(turn, parts == 1), schema), "packed")
        done = done.unionAll(made.filter("sequence_id is not null"))
    sequences = materialize(done.groupBy("sequence_id", "window").agg(attention_cost(F.col("length")).alias("cost")), "sequences")
    steps = materialize(step_groups(sequences, step_tokens), "step-groups")
    out = done.join(steps.select("sequence_id", "step_group"), "sequence_id")
    return out.select(F.col("id").alias(id_col), "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "window", "step_group", *(["ids"] if with_ids else []))


def step_groups(sequences: DataFrame, step_tokens: int = STEP_TOKENS) -> DataFrame:
    """(sequence_id, window, cost) with ``step_group``: groups of one tier, of at most the sequences that a
    step's tokens make, all of a tier equal in number but for one and dealt by cost back and forth."""
    placed = numbered(sequences, "window", ["cost", "sequence_id"])
    groups = F.ceil(F.col("total") * F.col("window") / step_tokens)
    tiers = placed.groupBy("window").agg(F.max(groups).cast("long").alias("groups"))
    # A tier's groups are numbered after those of shorter tiers: one row a tier.
    tiers = materialize(tiers, "tier-groups")
    shorter = Window.orderBy("window").rowsBetween(Window.unboundedPreceding, -1)
    first = tiers.withColumn("first", F.coalesce(F.sum("groups").over(shorter), F.lit(0)))
    rows = placed.join(broadcast_if_small(first, SMALL_TIERS), "window")
    turn, nth = F.floor(F.col("place") / F.col("groups")), F.col("place") % F.col("groups")
    group = F.when(turn % 2 == 0, nth).otherwise(F.col("groups") - 1 - nth)
    return rows.select("sequence_id", "window", "cost", (F.col("first") + group).cast("long").alias("step_group"))
