"""Exact ranked lexical search over all documents: impact-ordered, score at a time.

A term of a document has an impact, a whole number made of the term's weight, how often it occurs and
how long the document is.  A document's score for an item is the sum of the impacts of the item's terms.

The documents of a task go into blocks.  A block holds, for every term that some item asks for, the
documents that have it and how often; text leaves the first pass in no other form.  Counts over all
documents (how many, how long, how many have a term) come from the blocks.  Then each block orders its
postings by term and exact impact, and answers the items one by one: postings of all terms of an item are
taken by groups of one impact, highest first, and added to the scores of their documents.  After a
number of postings that doubles, the bounds are looked at: what a document can still gain is, for every
term it has not met, the impact of that term's next group.  Once documents that met no term cannot
reach the k best, no new ones are taken in; the documents that still can are the candidates, and their
scores are completed by looking up the terms they lack.

A task keeps the k best of each item over its blocks, so that later blocks stop sooner.  It starts
from cutoffs of a first share of the blocks: the score of the k-th best document there is one that k
documents reach.  Cutoffs and the k best only ever prove that a document is not among the k best;
equal scores go on.

Terms are runs of ASCII letters, digits and all characters beyond ASCII; only A-Z are lowered.  Null
texts have no term, and documents without one count for nothing.  Rows of equal ids (null too, which
come first in ties) are documents of their own.  Items of equal ids are one item with the terms of all;
an item without terms, or without a match, has no rows.  Empty inputs give an empty result.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.shared import materialize, parallelism, ship

K = 50
#: Documents and postings of a block, at most (a single document may have more postings).
BLOCK_DOCUMENTS, BLOCK_POSTINGS = 16_384, 1 << 20
#: Terms of a batch of items; every batch goes through all documents, and its terms to all tasks.
BATCH_TERMS = 200_000
#: One block in so many gives the first cutoffs.
FIRST_SHARE = 32
#: Postings whose groups are taken before the bounds are looked at, doubling from this number on.
FIRST_POSTINGS = 256
#: A byte of a term to its lower form, all others to a space.
TERM_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
LONG = np.iinfo(np.int64)
BLOCKS = "block long, ids array<long>, lengths binary, terms binary, ends binary, spots binary, times binary"
FOUND = "item int, id long, score long"


def terms(text: str | None) -> list[bytes]:
    """The terms of a text as UTF-8, in order, repeats included."""
    return text.encode("utf-8", "surrogatepass").translate(TERM_BYTES).split() if text else []


def term_column(text: Column) -> Column:
    """The same as a column."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.regexp_extract_all(F.translate(text, upper, upper.lower()), F.lit(r"([^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+)"), F.lit(1))


def weights(n: int, df: np.ndarray) -> np.ndarray:
    return np.floor(1000 * np.log((2 * n + 2) / (2 * df + 1))).astype(np.int64)


def impacts(weight: np.ndarray, times: np.ndarray, lengths: np.ndarray, n: int, total: int) -> np.ndarray:
    """What a term adds to a document's score; 64-bit whole numbers."""
    m = 50 + 50 * lengths * n // total
    return weight * (1_000_000_000 * times // (1000 * times + 20 * m))


class Block:
    """Postings of some documents.  ``spots`` and ``times`` are by term and document; ``order`` lists them
    by term and falling impact, and ``groups`` cuts that list where the impact changes."""

    def __init__(self, row: dict, weight: np.ndarray, n: int, total: int):
        lengths = np.frombuffer(row["lengths"], np.int64)
        self.ids = row["ids"]
        self.count = len(lengths)
        self.terms, self.ends = np.frombuffer(row["terms"], np.int32), np.frombuffer(row["ends"], np.int64)
        self.starts = np.concatenate([[0], self.ends[:-1]])
        self.spots = np.frombuffer(row["spots"], np.int32)
        counts = self.ends - self.starts
        of = np.repeat(np.arange(len(self.terms)), counts)
        self.impact = impacts(weight[self.terms][of], np.frombuffer(row["times"], np.int32).astype(np.int64), lengths[self.spots], n, total)
        order = np.lexsort((-self.impact, of))
        self.by_impact, self.by_spot = self.impact[order], self.spots[order]
        new = np.ones(len(order), bool)
        new[1:] = (self.by_impact[1:] != self.by_impact[:-1]) | (of[order][1:] != of[order][:-1])
        self.groups = np.append(np.flatnonzero(new), len(order))
        self.group_at = np.searchsorted(self.groups, np.append(self.starts, len(order)))
        self.place = {int(t): i for i, t in enumerate(self.terms)}
        self.scores, self.met = np.zeros(self.count, np.int64), np.zeros(self.count, bool)

    def search(self, asked: list[int], k: int, cutoff: int) -> tuple[np.ndarray, np.ndarray, int]:
        """(spots, scores) of all documents that may be among the k best and reach ``cutoff``, their scores
        complete; and how many postings were taken."""
        held = np.array([self.place[t] for t in asked if t in self.place], np.int64)
        if not len(held) or not self.by_impact[self.starts[held]].any():
            return np.empty(0, np.int64), np.empty(0, np.int64), 0
        # All groups of the item's terms, the highest impact first.
        heads, last = self.group_at[held], self.group_at[held + 1]
        of = np.repeat(np.arange(len(held)), last - heads)
        nth = np.arange(len(of)) - np.repeat(np.cumsum(last - heads) - (last - heads), last - heads)
        groups = heads[of] + nth
        order = np.argsort(-self.by_impact[self.groups[groups]], kind="stable")
        order = order[: np.count_nonzero(self.by_impact[self.groups[groups]])]  # a term that all documents have weighs nothing
        groups, of, nth = groups[order], of[order], nth[order]
        size = self.groups[groups + 1] - self.groups[groups]
        upto = np.cumsum(size)
        left = int(size.sum())
        scores, met, taken, at, step = self.scores, self.met, 0, 0, FIRST_POSTINGS
        touched: list[np.ndarray] = []
        passed = np.zeros(len(held), np.int64)
        while at < len(groups):
            to = max(at + 1, int(np.searchsorted(upto, taken + step, "right")))
            step *= 2
            lengths = size[at:to]
            flat = np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths) + np.repeat(self.groups[groups[at:to]], lengths)
            taken += len(flat)
            spots = self.by_spot[flat]
            np.add.at(scores, spots, self.by_impact[flat])
            fresh = np.unique(spots[~met[spots]])
            met[fresh] = True
            touched.append(fresh)
            np.maximum.at(passed, of[at:to], nth[at:to] + 1)
            at = to
            # The next impact of each term: no document can gain more from a term it has not met.
            following = np.minimum(heads + passed, last - 1)
            rest = np.where(heads + passed < last, self.by_impact[self.groups[following]], 0)
            known = np.concatenate(touched)
            reached = max(cutoff, 1, int(np.partition(scores[known], len(known) - k)[len(known) - k]) if len(known) >= k else 1)
            # New documents are out.  Those known that are not may still be more than what is left to take.
            if rest.sum() < reached and np.count_nonzero(scores[known] + rest.sum() >= reached) * np.count_nonzero(rest) <= left - taken:
                break
        known = np.concatenate(touched)
        rest_sum = int(rest.sum())
        candidates = known[scores[known] + rest_sum >= reached]
        complete = scores[candidates].copy()
        scores[known], met[known] = 0, False
        if rest_sum:
            # Complete the candidates: of each term, the postings that were not taken.
            order = np.argsort(candidates)
            candidates, complete = candidates[order], complete[order]
            for i, t in enumerate(held):
                if not rest[i]:
                    continue
                own = self.spots[self.starts[t] : self.ends[t]]
                found = np.minimum(np.searchsorted(own, candidates), len(own) - 1)
                gain = self.impact[self.starts[t] + found]
                complete += np.where((own[found] == candidates) & (gain <= rest[i]), gain, 0)
        keep = complete >= max(cutoff, 1)
        return candidates[keep], complete[keep], taken


class Best:
    """The k best of each item so far: by score, then by id with null first."""

    def __init__(self, k: int, cutoffs: np.ndarray):
        self.k, self.cutoffs = k, cutoffs
        self.held: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}

    def add(self, item: int, ids: np.ndarray, known: np.ndarray, scores: np.ndarray) -> None:
        if item in self.held:
            ids, known, scores = (np.concatenate(x) for x in zip(self.held[item], (ids, known, scores), strict=True))
        order = np.lexsort((ids, known, -scores))[: self.k]
        self.held[item] = ids[order], known[order], scores[order]
        if len(order) == self.k:
            self.cutoffs[item] = max(self.cutoffs[item], int(scores[order[-1]]))

    def batches(self) -> Iterator[pa.RecordBatch]:
        for item, (ids, known, scores) in self.held.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), item, np.int32)), pa.array(ids, mask=~known), pa.array(scores)], names=["item", "id", "score"])


def _blocks(docs: DataFrame, vocabulary, documents: int = BLOCK_DOCUMENTS, postings: int = BLOCK_POSTINGS) -> DataFrame:
    """``docs`` (id, text) as blocks of postings of the terms in ``vocabulary`` (a broadcast term to number)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = vocabulary.value
        ids, lengths, spots, found, times = [], [], [], [], []

        def block() -> pa.RecordBatch:
            term, spot = np.array(found, np.int32), np.array(spots, np.int32)
            order = np.lexsort((spot, term))
            term = term[order]
            ends = np.append(np.flatnonzero(term[1:] != term[:-1]) + 1, len(term)) if len(term) else np.empty(0, np.int64)
            parts = [np.array(lengths, np.int64), term[ends - 1] if len(ends) else term, ends.astype(np.int64), spot[order], np.array(times, np.int32)[order]]
            row = [pa.array([0], pa.int64()), pa.array([ids], pa.list_(pa.int64())), *(pa.array([x.tobytes()], pa.binary()) for x in parts)]
            for column in (ids, lengths, spots, found, times):
                column.clear()
            return pa.RecordBatch.from_arrays(row, names=["block", "ids", "lengths", "terms", "ends", "spots", "times"])

        for batch in batches:
            for of, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                own = terms(text.as_py())
                if not own:
                    continue
                for term, n in Counter(filter(number.__contains__, own)).items():
                    found.append(number[term])
                    spots.append(len(ids))
                    times.append(n)
                ids.append(of)
                lengths.append(len(own))
                if len(ids) >= documents or len(found) >= postings:
                    yield block()
        if ids:
            yield block()

    return docs.mapInArrow(run, BLOCKS).withColumn("block", F.monotonically_increasing_id())


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per task: (term, how many documents have it); term -1: how many documents, -2: how many terms."""
    counts: Counter = Counter()
    for batch in batches:
        for row in batch.to_pylist():
            ends = np.frombuffer(row["ends"], np.int64)
            counts.update(dict(zip(np.frombuffer(row["terms"], np.int32).tolist(), np.diff(ends, prepend=0).tolist(), strict=True)))
            lengths = np.frombuffer(row["lengths"], np.int64)
            counts.update({-1: len(lengths), -2: int(lengths.sum())})
    yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.int32()), pa.array(list(counts.values()), pa.int64())], names=["term", "n"])


def _searched(asked, weight, n: int, total: int, k: int, cutoffs, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The k best documents of a task's blocks for each item."""
    best = Best(k, np.array(cutoffs.value, np.int64))
    for batch in batches:
        for i in range(batch.num_rows):
            row = {name: batch.column(name)[i].as_py() for name in ("lengths", "terms", "ends", "spots", "times")}
            given = batch.column("ids")[i].values
            known = ~np.asarray(given.is_null())
            ids = given.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            held = Block(row | {"ids": ids}, weight.value, n, total)
            for item, own in asked.value.items():
                spots, scores, _ = held.search(own, k, int(best.cutoffs[item]))
                if len(spots):
                    best.add(item, ids[spots], known[spots], scores)
    yield from best.batches()


def ranked(docs: DataFrame, items: DataFrame, k: int = K, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(item, rank from 1, id, score): the k best documents of each item, those that score above zero.  Ids of
    documents are whole numbers."""
    spark = docs.sparkSession
    ship(spark)
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    told = items.select(F.col(item_col).alias("name"), F.explode(term_column(F.col(item_text_col))).alias("term")).distinct()
    # Items get numbers, and batches of a bounded number of terms.
    names = told.groupBy("name").agg(F.count("*").alias("n"))
    names = materialize(names.withColumn("nth", F.monotonically_increasing_id()), "items")
    every = materialize(told.join(names, told["name"].eqNullSafe(names["name"])).select("nth", "term", "n"), "item-terms")
    total = every.count()
    parts = -(-total // BATCH_TERMS)
    found = None
    for part in range(parts):
        own = every.filter(F.pmod(F.xxhash64("nth"), F.lit(parts)) == part) if parts > 1 else every
        rows = _batch(source, own, k)
        found = rows if found is None else found.unionAll(rows)
    if found is None:
        found = source.select(F.lit(0).cast("long").alias("nth"), "id", F.lit(0).cast("long").alias("score"), F.lit(0).alias("rank")).filter("false")
    named = found.join(names.drop("n"), "nth")
    return named.select(F.col("name").alias(item_col), "rank", F.col("id").alias(id_col), "score")


def _batch(source: DataFrame, every: DataFrame, k: int) -> DataFrame:
    """(nth, id, score, rank) of the items of a batch, whose terms are few enough for every task."""
    spark = source.sparkSession
    sc = spark.sparkContext
    rows = every.select("nth", "term").collect()  # at most about BATCH_TERMS
    vocabulary = {t: i for i, t in enumerate(sorted({r["term"].encode() for r in rows}))}
    items = {x: i for i, x in enumerate(sorted({r["nth"] for r in rows}))}
    asked: dict[int, list[int]] = {}
    for r in rows:
        asked.setdefault(items[r["nth"]], []).append(vocabulary[r["term"].encode()])
    blocks = materialize(_blocks(source, sc.broadcast(vocabulary)), "posting-blocks")
    counts = {r["term"]: r["n"] for r in blocks.select("lengths", "terms", "ends").mapInArrow(_frequencies, "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()}  # a row a term of the batch
    n, total = counts.pop(-1, 0), counts.pop(-2, 0)
    df = np.zeros(len(vocabulary), np.int64)
    df[list(counts)] = list(counts.values())
    given = partial(_searched, sc.broadcast(asked), sc.broadcast(weights(n, df)), n, total, k)

    def best(of: DataFrame, cutoffs: np.ndarray) -> DataFrame:
        made = of.drop("block").mapInArrow(partial(given, sc.broadcast(cutoffs)), FOUND)
        rank = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), F.col("id").asc_nulls_first()))
        return made.withColumn("rank", rank).filter(F.col("rank") <= k)

    first = F.pmod(F.xxhash64("block"), F.lit(FIRST_SHARE)) == 0
    cutoffs = np.ones(len(items), np.int64)
    opened = materialize(best(blocks.filter(first), cutoffs), "first-ranking")
    for r in opened.filter(F.col("rank") == k).select("item", "score").collect():  # a row an item of the batch
        cutoffs[r["item"]] = r["score"]
    both = best(blocks.filter(~first), cutoffs).drop("rank").unionAll(opened.drop("rank"))
    rank = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), F.col("id").asc_nulls_first()))
    final = both.withColumn("rank", rank).filter(F.col("rank") <= k)
    numbers = F.broadcast(spark.createDataFrame([(i, int(x)) for x, i in items.items()], "item int, nth long"))  # a row an item of the batch
    return final.join(numbers, "item").select("nth", "id", "score", "rank")
