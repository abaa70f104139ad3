"""Exact top-k search by a three-phase uniform threshold.

The components of the vectors are split into m slices; a vector's score is the sum of its m slice
scores, and each slice is a table of its own, so that its score lists come from who holds the slice
and nothing else.  Vectors lie in packs, queries in blocks; a block meets a slice of a pack as one
matrix product.

Phase 1 gathers local score lists: each slice of each pack lists its k + 1 best vectors for a query,
the best of these lists over all packs stay, and the listed vectors' full scores are worked out.
The k-th best of them is a safe cutoff t for the query: k vectors reach it.  Phase 2 hands t to all
slices.  A score of at least t needs a slice score of at least t / m somewhere, so each slice sends
just the entries that reach t / m, as a list of places or, where they are many, a bit for each.  Phase 3 joins the entries of
a block and a pack with their whole vectors and works out the scores of these alone, exactly; all
other vectors are never scored.  The best k that reach t are the answer.

Components are floor(scale * x), as whole numbers however large x is.  Vectors that are null or hold
null or non-finite components take no part, nor do rows with a null id.  A vec_id that occurs again
is one vector, its smallest embedding in array order.  Vectors are compared with those of equal
length only.  Scores are exact; beyond the range of a long they are clamped to it, and ranked as
clamped.  Ties go to the smaller id.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from fractions import Fraction
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.shared import broadcast_if_small, materialize, parallelism, ship

SLICES = 4
PACK, BLOCK = 1024, 512
#: Sums of products below these are exact as floats and as doubles.
EXACT_FLOAT, EXACT_DOUBLE = 2.0**24, 2.0**53
LONG = np.iinfo(np.int64)
#: Bytes of all query vectors that may be broadcast to the packs; more meet them by exchange.
SMALL_QUERIES = 64 << 20
#: Lists (of a block of queries and a slice, about 100 kB each) that a task of phase 1 merges into.
HELD_LISTS = 256
#: Pairs of queries and vectors whose vectors phase 3 gathers at once.
GATHERED = 1 << 14
PACKED = "dim int, ids binary, vectors binary"


def usable(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, vector): one row per vector that takes part."""
    vector = F.transform(F.col(vector_col), lambda x: x.cast("double"))
    rows = df.select(F.col(id_col).cast("long").alias("id"), vector.alias("vector"))
    finite = ~F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return rows.filter(F.col("id").isNotNull() & F.col("vector").isNotNull() & finite).groupBy("id").agg(F.min("vector").alias("vector"))


def pack_rows(rows: DataFrame, size: int) -> DataFrame:
    """Rows (id, vector) as matrices of at most ``size`` rows of one length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[list, list]] = {}

        def full(dim: int) -> pa.RecordBatch:
            ids, vectors = held.pop(dim)
            matrix = np.array(vectors, np.float64).reshape(len(ids), dim)
            return pa.RecordBatch.from_arrays([pa.array([dim], pa.int32()), pa.array([np.array(ids, np.int64).tobytes()], pa.binary()), pa.array([matrix.tobytes()], pa.binary())], names=["dim", "ids", "vectors"])

        for batch in batches:
            for i, v in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                v = v.values.to_numpy(zero_copy_only=False)
                ids, vectors = held.setdefault(len(v), ([], []))
                ids.append(i)
                vectors.append(v)
                if len(ids) == size:
                    yield full(len(v))
        for dim in sorted(held):
            yield full(dim)

    return rows.mapInArrow(run, PACKED)


def sliced(packs: DataFrame, slices: int) -> DataFrame:
    """(dim, slice, pack, n, vectors): the components of each slice of each pack."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                vectors = matrix(row["vectors"], row["dim"])
                cuts = slice_cuts(row["dim"], slices)
                parts = [np.ascontiguousarray(vectors[:, a:b]).tobytes() for a, b in pairwise(cuts)]
                m = len(parts)
                columns = [pa.array([row["dim"]] * m, pa.int32()), pa.array(range(m), pa.int32()), pa.array([row["pack"]] * m, pa.int64()), pa.array([len(vectors)] * m, pa.int32()), pa.array(parts, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["dim", "slice", "pack", "n", "vectors"])

    return packs.select("dim", "pack", "vectors").mapInArrow(run, "dim int, slice int, pack long, n int, vectors binary")


def slice_cuts(dim: int, slices: int) -> list[int]:
    return np.linspace(0, dim, slices + 1).astype(int).tolist()


def matrix(data: bytes, dim: int, n: int | None = None) -> np.ndarray:
    held = np.frombuffer(data)
    return held.reshape(n if n is not None else len(held) // max(dim, 1), dim)


def whole_numbers(vectors: np.ndarray, scale: float) -> np.ndarray:
    """floor(scale * x), as doubles, or as Python integers where doubles cannot hold it."""
    with np.errstate(over="ignore"):
        made = np.floor(vectors * scale)
    if np.isfinite(made).all():
        return made
    exact = [[int(y) if math.isfinite(y) else math.floor(Fraction(x) * Fraction(scale)) for x, y in zip(*rows, strict=True)] for rows in zip(vectors.tolist(), made.tolist(), strict=True)]
    return np.array(exact, object).reshape(made.shape)


def integers(values: np.ndarray) -> np.ndarray:
    return np.array([[int(x) for x in row] for row in values.tolist()], object).reshape(values.shape)


def exact_type(queries: np.ndarray, vectors: np.ndarray) -> type:
    """The cheapest type in which every sum of their products is exact."""
    if queries.dtype == object or vectors.dtype == object:
        return object
    largest = float(np.abs(queries).max(initial=0)) * float(np.abs(vectors).max(initial=0)) * max(queries.shape[1], 1)
    return np.float32 if largest < EXACT_FLOAT else np.float64 if largest < EXACT_DOUBLE else object


def products(queries: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """All inner products, exact."""
    kind = exact_type(queries, vectors)
    if kind is object:
        queries, vectors = (m if m.dtype == object else integers(m) for m in (queries, vectors))
        return queries @ vectors.T if queries.shape[1] else np.zeros((len(queries), len(vectors)))
    return queries.astype(kind) @ vectors.astype(kind).T


def pair_scores(queries: np.ndarray, vectors: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The scores of the pairs (i, j) alone, exact, clamped to longs."""
    kind = exact_type(queries, vectors)
    out = np.empty(len(i), np.int64)
    if kind is object:
        queries, vectors = (m if m.dtype == object else integers(m) for m in (queries, vectors))
    for at in range(0, len(i), GATHERED):
        p, q = i[at : at + GATHERED], j[at : at + GATHERED]
        if kind is object:
            out[at : at + GATHERED] = [min(max(int(sum(a * b for a, b in zip(queries[x], vectors[y], strict=True))), LONG.min), LONG.max) for x, y in zip(p, q, strict=True)]
        else:
            out[at : at + GATHERED] = np.einsum("nd,nd->n", queries[p].astype(kind), vectors[q].astype(kind)).astype(np.int64)
    return out


def listed(queries: np.ndarray, vectors: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Phase 1 of a block and a slice of a pack: the k best slice scores of each query, rounded to doubles,
    and their places."""
    scores = products(queries, vectors)
    if scores.dtype == object:
        most = float(np.finfo(np.float64).max)
        scores = np.array([[max(min(x, most), -most) for x in row] for row in scores.tolist()], np.float64).reshape(scores.shape)
    k = min(k, scores.shape[1])
    at = np.argpartition(-scores, k - 1, axis=1)[:, :k] if k < scores.shape[1] else np.tile(np.arange(k), (len(scores), 1))
    return np.take_along_axis(scores, at, 1).astype(np.float64), at.astype(np.int32)


def merged(one: tuple[np.ndarray, ...], other: tuple[np.ndarray, ...], k: int) -> tuple[np.ndarray, ...]:
    """The k best of two lists (query ids, scores, packs, places) of the same queries."""
    own, scores, *rest = one[0], *(np.concatenate((a, b), axis=1) for a, b in zip(one[1:], other[1:], strict=True))
    if scores.shape[1] <= k:
        return own, scores, *rest
    at = np.argpartition(-scores, k - 1, axis=1)[:, :k]
    return own, *(np.take_along_axis(x, at, 1) for x in (scores, *rest))


def reaching(queries: np.ndarray, vectors: np.ndarray, cutoffs: np.ndarray, slices: int) -> np.ndarray:
    """Phase 2 of a block and a slice of a pack: whether each slice score reaches its query's cutoff over
    the number of slices.  The least long is no cutoff: all reach it, also what is clamped to it."""
    scores = products(queries, vectors)
    if scores.dtype == object:
        reach = np.array([[x * slices >= int(t) for x in row] for row, t in zip(scores.tolist(), cutoffs.tolist(), strict=True)], bool).reshape(scores.shape)
    else:
        # Both sides are exact: a cutoff is a long, and slice scores are at most 2**53.
        reach = scores >= np.ceil(cutoffs / slices)[:, None] if np.abs(cutoffs).max(initial=0) < EXACT_DOUBLE else scores.astype(np.float64) * slices >= np.nextafter(cutoffs.astype(np.float64), -np.inf)[:, None]
    return reach | (cutoffs == LONG.min)[:, None]


def entries_sent(reach: np.ndarray) -> bytes:
    """Which entries are true: their places, or a bit for each if that is shorter."""
    places = np.flatnonzero(reach)
    return b"P" + places.astype("<u4").tobytes() if 32 * len(places) < reach.size else b"B" + np.packbits(reach).tobytes()


def entries_read(sent: list[bytes], size: int) -> np.ndarray:
    """Which entries some slice sent."""
    out = np.zeros(size, bool)
    for data in sent:
        if data[:1] == b"P":
            out[np.frombuffer(data, "<u4", offset=1)] = True
        else:
            out |= np.unpackbits(np.frombuffer(data, np.uint8, offset=1), count=size).astype(bool)
    return out


def resolved(own: np.ndarray, queries: np.ndarray, ids: np.ndarray, vectors: np.ndarray, entries: np.ndarray, cutoffs: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Phase 3 of a block and a pack: (query id, vector id, score) of the best k that reach the cutoff,
    scores worked out for the ``entries`` alone."""
    i, j = np.nonzero(entries.reshape(len(own), len(ids)) & (ids[None, :] != own[:, None]))
    scores = pair_scores(queries, vectors, i, j)
    keep = scores >= cutoffs[i]
    i, j, scores = i[keep], j[keep], scores[keep]
    order = np.lexsort((ids[j], -scores.astype(object) if (scores == LONG.min).any() else -scores, i))
    i, j, scores = i[order], j[order], scores[order]
    nth = np.arange(len(i)) - np.searchsorted(i, i)
    first = nth < k
    return own[i[first]], ids[j[first]], scores[first]


def exact_top_k(df: DataFrame, is_query: Column, k: int = 10, scale: float = 1024.0, id_col: str = "vec_id", vector_col: str = "embedding", slices: int = SLICES) -> DataFrame:
    """(query_id, rank from 1, vec_id, score): for every vector whose row meets ``is_query`` (an
    expression over ``id``), its k best among all others."""
    spark = df.sparkSession
    ship(spark)
    vectors = materialize(usable(df, id_col, vector_col), "vectors")
    packs = materialize(pack_rows(vectors, PACK).withColumn("pack", F.monotonically_increasing_id()), "packs")
    holders = materialize(sliced(packs, slices), "slices")
    asked = vectors.filter(is_query)
    blocks = -(-asked.count() // BLOCK)
    blocks = pack_rows(asked.repartition(max(1, blocks), "id"), BLOCK).withColumnsRenamed({"ids": "query_ids", "vectors": "queries"})
    blocks = materialize(blocks.withColumn("block", F.monotonically_increasing_id()), "query-blocks")

    def met(given: DataFrame, held: DataFrame) -> DataFrame:
        """Every block with every row of ``held`` of its length: by broadcast, or by exchange, where salts
        spread the packs of one length."""
        small = broadcast_if_small(given, SMALL_QUERIES, F.length("queries"))
        if small is not given:
            return held.join(small, "dim")
        salt = F.pmod(F.xxhash64("pack"), F.lit(4 * parallelism(spark))).cast("int")
        every = F.explode(F.sequence(F.lit(0), F.lit(4 * parallelism(spark) - 1))).alias("salt")
        return given.select("*", every).join(held.withColumn("salt", salt), ["dim", "salt"])

    def parts(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Query ids, and the slice of the queries and of the vectors that a row of ``holders`` meets."""
        own = np.frombuffer(row["query_ids"], np.int64)
        a, b = slice_cuts(row["dim"], slices)[row["slice"] : row["slice"] + 2]
        queries = matrix(row["queries"], row["dim"], len(own))[:, a:b]
        return own, whole_numbers(queries, scale), whole_numbers(matrix(row["vectors"], b - a, row["n"]), scale)

    def phase_1(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Lists of the packs of a task merge before they leave it; blocks of queries held at once are few.
        held: dict[tuple[int, int], tuple[np.ndarray, ...]] = {}

        def lists() -> Iterator[pa.RecordBatch]:
            for (_, nth), (own, scores, pack, place) in held.items():
                width = scores.shape[1]
                columns = [pa.array(np.repeat(own, width)), pa.array(np.full(scores.size, nth, np.int32)), pa.array(pack.ravel()), pa.array(place.ravel()), pa.array(scores.ravel())]
                yield pa.RecordBatch.from_arrays(columns, names=["query_id", "slice", "pack", "place", "score"])
            held.clear()

        for batch in batches:
            for row in batch.to_pylist():
                own, queries, vectors = parts(row)
                scores, place = listed(queries, vectors, k + 1)
                made = (own, scores, np.full(place.shape, row["pack"], np.int64), place)
                key = row["block"], row["slice"]
                held[key] = merged(held[key], made, k + 1) if key in held else made
                if len(held) > HELD_LISTS:
                    yield from lists()
        yield from lists()

    def score_listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                one, other = (whole_numbers(np.array([row[x]], np.float64), scale) for x in ("one", "other"))
                yield pa.RecordBatch.from_arrays([pa.array([row["query_id"]], pa.int64()), pa.array(pair_scores(one, other, np.zeros(1, int), np.zeros(1, int)))], names=["query_id", "score"])

    def phase_2(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                _, queries, held = parts(row)
                reach = reaching(queries, held, np.frombuffer(row["cutoffs"], np.int64), slices)
                if reach.any():
                    yield pa.RecordBatch.from_arrays([pa.array([row["block"]], pa.int64()), pa.array([row["pack"]], pa.int64()), pa.array([entries_sent(reach)], pa.binary())], names=["block", "pack", "sent"])

    def phase_3(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                own, ids = np.frombuffer(row["query_ids"], np.int64), np.frombuffer(row["ids"], np.int64)
                queries, held = (whole_numbers(matrix(row[x], row["dim"], n), scale) for x, n in (("queries", len(own)), ("vectors", len(ids))))
                entries = entries_read(row["entries"], len(own) * len(ids))
                made = resolved(own, queries, ids, held, entries, np.frombuffer(row["cutoffs"], np.int64), k)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in made], names=["query_id", "vec_id", "score"])

    # Phase 1: the best of each slice's lists, their full scores, and the k-th best of these.
    lists = met(blocks, holders).mapInArrow(phase_1, "query_id long, slice int, pack long, place int, score double")
    place = F.row_number().over(Window.partitionBy("query_id", "slice").orderBy(F.desc("score"), "pack", "place"))
    lists = materialize(lists.withColumn("nth", place).filter(F.col("nth") <= k + 1).select("query_id", "pack", "place").distinct(), "score-lists")
    spots = packs.select("pack", "ids").mapInArrow(_spots, "pack long, place int, vec_id long")
    named = lists.join(spots, ["pack", "place"]).filter(F.col("vec_id") != F.col("query_id")).select("query_id", "vec_id")
    both = named.join(vectors.select(F.col("id").alias("query_id"), F.col("vector").alias("one")), "query_id").join(vectors.select(F.col("id").alias("vec_id"), F.col("vector").alias("other")), "vec_id")
    scored = both.select("query_id", "one", "other").mapInArrow(score_listed, "query_id long, score long")
    nth = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score")))
    cutoffs = scored.withColumn("nth", nth).filter(F.col("nth") <= k).filter(F.col("nth") == k).select("query_id", F.col("score").alias("cutoff"))
    told = materialize(_with_cutoffs(blocks, cutoffs), "query-cutoffs")
    # Phase 2: entries that reach the cutoff's share.  Phase 3: their scores.
    sent = materialize(met(told, holders).mapInArrow(phase_2, "block long, pack long, sent binary"), "entries")
    sent = sent.groupBy("block", "pack").agg(F.collect_list("sent").alias("entries"))  # one for each slice
    found = sent.join(told, "block").join(packs.drop("dim"), "pack").mapInArrow(phase_3, "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _spots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The id at each place of a pack."""
    for batch in batches:
        for row in batch.to_pylist():
            ids = np.frombuffer(row["ids"], np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), row["pack"], np.int64)), pa.array(np.arange(len(ids), dtype=np.int32)), pa.array(ids)], names=["pack", "place", "vec_id"])


def _with_cutoffs(blocks: DataFrame, cutoffs: DataFrame) -> DataFrame:
    """``blocks`` with ``cutoffs``: a long per query, in the order of its ids; the least one where fewer than
    k vectors are listed, which are all there are."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids = np.frombuffer(row["query_ids"], np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(np.full(len(ids), row["block"], np.int64)), pa.array(np.arange(len(ids)))], names=["query_id", "block", "nth"])

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.to_pylist()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([np.array(r["values"], np.int64).tobytes() for r in rows], pa.binary())], names=["block", "cutoffs"])

    spots = blocks.select("query_ids", "block").mapInArrow(spread, "query_id long, block long, nth long")
    told = spots.join(cutoffs, "query_id", "left").select("block", "nth", F.coalesce("cutoff", F.lit(LONG.min).cast("long")).alias("cutoff"))
    told = told.groupBy("block").agg(F.array_sort(F.collect_list(F.struct("nth", "cutoff"))).alias("x"))  # a block's queries
    told = told.select("block", F.transform("x", lambda s: s["cutoff"]).alias("values")).mapInArrow(gather, "block long, cutoffs binary")
    return blocks.join(told, "block")
