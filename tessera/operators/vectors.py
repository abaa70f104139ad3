"""Vectors in packs of neighbours, and exact top-k search that visits few of them.

A pack holds up to ``PACK`` unit vectors of one scope that lie close together, their centre and the widest
angle between it and one of them.  For a question the angle to a pack's centre, less that width, bounds
the cosine of all its vectors.  A search first visits, for each question, the packs whose centres lie
nearest; the k-th best score there is one that k vectors reach, and of all packs those are visited whose
bound reaches it.  For that, groups of packs meet blocks of questions, both of a bounded number, in tasks that
hold bounds and scores: what moves grows with the blocks and groups, not with the visits.  Scores are exact,
and rows equal those of a search that visits every pack.

Packs come from two steps: vectors of a scope that is large go to the nearest of a bounded number of
pivots, drawn from the scope, and in parts of a bounded number into local clusters.  Pivots and clusters
only decide how tight the bounds are, never what is found.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.operators.durable import broadcast_if_small, materialize, spread
from tessera.operators.postings import DIGITS, SLACK, apart

PACK = 256
#: Vectors of a part that is clustered in one task, on average, and pivots of all scopes that need more parts.
PART, PIVOTS = 16_384, 4096
ROUNDS = 4
#: Packs that each question visits first.
FIRST_PACKS = 4
#: Centres, and questions, that meet in a task.
CENTRES, QUESTIONS = 8192, 512
#: Vectors, and questions, that meet in a task where scores are taken; questions go by ``QUESTIONS`` there.
VECTORS, ASKED = 16_384, 4096
#: Rows that may be broadcast.
SMALL = 200_000
#: Rounding of angles.
ANGLE_SLACK = 1e-7


def clusters(units: np.ndarray, size: int = PACK) -> Iterator[np.ndarray]:
    """Places of ``units`` in groups of at most ``size`` that lie close together."""
    count = min(len(units), -(-4 * len(units) // size))
    centres = units[np.random.default_rng(0).choice(len(units), count, replace=False)]
    for _ in range(ROUNDS if count > 1 else 0):
        own = (units @ centres.T).argmax(1)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, units)
        norms = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(norms > 1e-12, sums / np.maximum(norms, 1e-12), centres)
    near = units @ centres.T
    own = near.argmax(1)
    order = np.lexsort((-near[np.arange(len(units)), own], own))
    for group in np.split(order, np.flatnonzero(np.diff(own[order])) + 1):
        for at in range(0, len(group), size):
            yield group[at : at + size]


def pack_vectors(vectors: DataFrame, key: str = "key", extra: tuple[str, ...] = ()) -> DataFrame:
    """(scope, dim, pack, n, centre, width, keys, units, *extra) of ``vectors`` (key: long, unit, scope: string,
    *extra: long); ``pack`` is unique.  Vectors of other lengths are other scopes."""
    rows = vectors.select(F.coalesce("scope", F.lit("")).alias("scope"), F.size("unit").alias("dim"), F.col(key).cast("long").alias("key"), "unit", *extra)
    rows = materialize(rows, "vector-units")
    sizes = rows.groupBy("scope", "dim").agg(F.count("*").alias("count"))
    sizes = materialize(sizes.withColumn("parts", F.ceil(F.col("count") / PART).cast("int")), "vector-scopes")
    rows = rows.join(broadcast_if_small(sizes, SMALL), ["scope", "dim"])
    # Pivots of large scopes: the least hashes, a share of all for each.
    total = sizes.filter("parts > 1").agg(F.sum("parts")).first()[0] or 0
    rows = rows.withColumn("pivot", F.lit(0))
    if total:
        most = F.greatest(F.lit(1), F.least(F.col("parts"), F.floor(F.lit(PIVOTS) * F.col("parts") / total).cast("int")))
        nth = F.row_number().over(Window.partitionBy("scope", "dim").orderBy(F.xxhash64("key"), "key"))
        drawn = rows.filter("parts > 1").withColumn("nth", nth).filter(F.col("nth") <= PIVOTS).filter(F.col("nth") <= most)
        held = {}
        for r in drawn.select("scope", "dim", "unit").collect():  # at most about PIVOTS
            held.setdefault((r["scope"], r["dim"]), []).append(r["unit"])
        pivots = vectors.sparkSession.sparkContext.broadcast({k: np.array(v) for k, v in held.items()})
        schema = rows.schema

        def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                scopes, dims = batch.column("scope").to_pylist(), batch.column("dim").to_pylist()
                pivot = np.zeros(batch.num_rows, np.int32)
                groups: dict[tuple[str, int], list[int]] = {}
                for i, name in enumerate(zip(scopes, dims, strict=True)):
                    if name in pivots.value:
                        groups.setdefault(name, []).append(i)
                for name, at in groups.items():
                    units = batch.column("unit").take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).reshape(len(at), name[1])
                    pivot[at] = (units @ pivots.value[name].T).argmax(1)
                yield batch.set_column(batch.schema.get_field_index("pivot"), batch.schema.field("pivot"), pa.array(pivot))

        rows = materialize(rows.mapInArrow(nearest, schema), "vector-pivots")
        parts = rows.groupBy("scope", "dim", "pivot").agg(F.ceil(F.count("*") / PART).cast("int").alias("split"))
        rows = rows.join(broadcast_if_small(materialize(parts, "vector-parts"), SMALL), ["scope", "dim", "pivot"])
    else:
        rows = rows.withColumn("split", F.lit(1))
    rows = rows.withColumn("part", F.pmod(F.xxhash64("key"), "split").cast("int")).select("scope", "dim", "pivot", "part", "key", "unit", *extra)
    schema = T.StructType().add("scope", "string").add("dim", "integer").add("n", "integer").add("centre", "binary").add("width", "double").add("keys", T.ArrayType(T.LongType())).add("units", "binary")
    for name in extra:
        schema.add(name, T.ArrayType(T.LongType()))

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("key").combine_chunks()
        dim = table.column("dim")[0].as_py()
        units = table.column("unit").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(table.num_rows, dim)
        out: list[list] = [[] for _ in schema]
        for group in clusters(units):
            own = units[group]
            centre = own.sum(0)
            norm = np.linalg.norm(centre)
            centre = centre / norm if norm > 1e-12 else own[0]
            width = float(np.arccos(np.clip(own @ centre, -1, 1)).max()) + ANGLE_SLACK
            told = [table.column(c).take(pa.array(group)).to_pylist() for c in ("key", *extra)]
            for column, value in zip(out, (table.column("scope")[0].as_py(), dim, len(group), centre.tobytes(), width, told[0], own.tobytes(), *told[1:]), strict=True):
                column.append(value)
        return pa.table([pa.array(c, t) for c, t in zip(out, (pa.string(), pa.int32(), pa.int32(), pa.binary(), pa.float64(), *[pa.list_(pa.int64()), pa.binary()], *[pa.list_(pa.int64())] * len(extra)), strict=True)], names=schema.names)

    made = spread(rows, "scope", "dim", "pivot", "part").groupBy("scope", "dim", "pivot", "part").applyInArrow(run, schema)
    return made.withColumn("pack", F.monotonically_increasing_id())


def dense_search(queries: DataFrame, packs: DataFrame, k: int, key: str = "key", visits: list[DataFrame] | None = None) -> DataFrame:
    """(qid, key, score, rank): cosine top k, equal scores by key.  ``queries``: (qid: long, unit [, scopes]);
    ``packs``: a written table of ``pack_vectors``, where a column ``live`` (array of booleans) tells which
    vectors count.  A question without scopes sees all.  ``visits`` gets the table of visits (qid, pack)."""
    scoped = "scopes" in queries.columns
    asked = queries.select(F.col("qid").cast("long").alias("qid"), "unit", F.size("unit").alias("dim"), *([F.explode(F.array_distinct("scopes")).alias("scope")] if scoped else []))
    asked = materialize(asked, "dense-asked")
    by = ["scope", "dim"] if scoped else ["dim"]
    heads = packs.select(*by, "pack", "n", "centre", "width")
    # Centres in groups of a bounded number, questions in blocks: every block meets every group of its scope.
    count = materialize(heads.groupBy(*by).agg(F.ceil(F.count("*") / CENTRES).cast("int").alias("groups")), "centre-groups")
    grouped = heads.join(broadcast_if_small(count, SMALL), by).withColumn("group", F.pmod(F.xxhash64("pack"), "groups").cast("int")).drop("groups")
    blocks = asked.groupBy(*by).agg(F.ceil(F.count("*") / QUESTIONS).cast("int").alias("blocks"))
    blocked = asked.join(broadcast_if_small(materialize(blocks, "question-blocks"), SMALL), by).withColumn("block", F.pmod(F.xxhash64("qid"), "blocks").cast("int")).drop("blocks")
    keys = [*by, "group", "block"]
    told = count.join(broadcast_if_small(blocks, SMALL), by).select(*by, F.explode(F.sequence(F.lit(0), F.col("groups") - 1)).alias("group"), "blocks")
    told = materialize(told.select(*by, "group", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block")), "dense-meetings")
    left = grouped.join(broadcast_if_small(told, SMALL), [*by, "group"])

    def pairs(questions: DataFrame, first: bool) -> DataFrame:
        """(qid, pack, near): the first packs of each question, or all whose bound reaches its cutoff."""
        right = questions.join(broadcast_if_small(told, SMALL), [*by, "block"])

        def run(centres: pa.Table, own: pa.Table) -> pa.Table:
            names = ["qid", "pack", "near"]
            if not own.num_rows or not centres.num_rows:
                return pa.table([pa.array([], pa.int64()), pa.array([], pa.int64()), pa.array([], pa.float64())], names=names)
            dim = own.column("dim")[0].as_py()
            units = own.column("unit").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(own.num_rows, dim)
            middle = np.frombuffer(b"".join(centres.column("centre").to_pylist())).reshape(-1, dim)
            near = np.clip(units @ middle.T, -1, 1)
            if first:
                m = min(FIRST_PACKS, near.shape[1])
                j = np.argpartition(-near, m - 1, axis=1)[:, :m] if m < near.shape[1] else np.tile(np.arange(m), (len(near), 1))
                i = np.repeat(np.arange(len(near)), m)
                j = j.ravel()
            else:
                bound = np.cos(np.maximum(np.arccos(near) - np.asarray(centres.column("width").to_numpy())[None, :], 0))
                i, j = np.nonzero(bound + SLACK >= own.column("cutoff").to_numpy()[:, None])
            return pa.table([own.column("qid").take(pa.array(i)), centres.column("pack").take(pa.array(j)), pa.array(near[i, j])], names=names)

        return spread(left, *keys).groupBy(*keys).cogroup(spread(apart(right), *keys).groupBy(*keys)).applyInArrow(run, "qid long, pack long, near double")

    def visited(some: DataFrame, questions: DataFrame) -> DataFrame:
        """(qid, key, score) of the best k of every pack for each question that visits it."""
        asking = some.join(questions.select("qid", "unit").dropDuplicates(["qid"]), "qid")
        turn = F.pmod(F.xxhash64("qid"), F.lit(turns)).cast("int")
        asking = asking.groupBy("pack", turn.alias("turn")).agg(F.collect_list("qid").alias("qids"), F.collect_list("unit").alias("asked"))
        live = ["live"] if "live" in packs.columns else []
        # What a pack is asked is larger than estimated from the visits: no broadcast.
        met = packs.select("pack", "dim", "keys", "units", *live).join(asking.hint("merge"), "pack")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for row in range(batch.num_rows):
                    dim = batch.column("dim")[row].as_py()
                    qids = batch.column("qids")[row].values.to_numpy(zero_copy_only=False)
                    held = batch.column("keys")[row].values.to_numpy(zero_copy_only=False)
                    units = np.frombuffer(batch.column("units")[row].as_py()).reshape(len(held), dim)
                    matrix = batch.column("asked")[row].values.flatten().to_numpy(zero_copy_only=False).reshape(len(qids), dim)
                    if live and batch.column("live")[row].is_valid:
                        keep = np.asarray(batch.column("live")[row].values.to_numpy(zero_copy_only=False), bool)
                        held, units = held[keep], units[keep]
                    scores = np.round(matrix @ units.T, DIGITS)
                    order = np.lexsort((np.broadcast_to(held, scores.shape), -scores))[:, :k] if scores.size else np.empty((len(qids), 0), np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(np.repeat(qids, order.shape[1])), pa.array(held[order].ravel()), pa.array(np.take_along_axis(scores, order, 1).ravel())], names=["qid", "key", "score"])

        return met.select("pack", "dim", "keys", "units", "qids", "asked", *live).mapInArrow(run, "qid long, key long, score double")

    def scored(questions: DataFrame) -> DataFrame:
        """(qid, key, score): of each question (with its cutoff) and group of packs, the best k among the packs
        whose bound reaches the cutoff."""
        live = ["live"] if "live" in packs.columns else []
        meet = packs.groupBy(*by).agg(F.ceil(F.sum("n") / VECTORS).cast("int").alias("groups"))
        meet = meet.join(asked.groupBy(*by).agg(F.ceil(F.count("*") / ASKED).cast("int").alias("turns")), by)
        meet = broadcast_if_small(materialize(meet, "score-meetings"), SMALL)
        each = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
        held = packs.select(*by, "pack", "centre", "width", "keys", "units", *live).join(meet, by)
        held = held.withColumn("group", F.pmod(F.xxhash64("pack"), "groups").cast("int")).withColumn("turn", each("turns")).drop("pack", "groups", "turns")
        own = questions.select(*by, "qid", "unit", "cutoff").join(meet, by)
        own = own.withColumn("turn", F.pmod(F.xxhash64("qid"), "turns").cast("int")).withColumn("group", each("groups")).drop("groups", "turns")
        met = [*by, "group", "turn"]

        def run(table: pa.Table, asking: pa.Table) -> pa.Table:
            out: list[list[np.ndarray]] = [[np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0)]]
            if table.num_rows and asking.num_rows:
                dim = asking.column("dim")[0].as_py()
                keys = table.column("keys").combine_chunks()
                ends = np.cumsum(pc.list_value_length(keys).to_numpy(zero_copy_only=False))
                keys = keys.flatten().to_numpy(zero_copy_only=False)
                units = np.frombuffer(b"".join(table.column("units").to_pylist())).reshape(-1, dim)
                middle, width = np.frombuffer(b"".join(table.column("centre").to_pylist())).reshape(-1, dim), table.column("width").to_numpy()
                dead = np.concatenate([np.full(n, False) if x is None else ~np.array(x, bool) for x, n in zip(table.column("live").to_pylist(), np.diff(ends, prepend=0), strict=True)]) if live else None
                qids, cutoffs = asking.column("qid").to_numpy(), asking.column("cutoff").to_numpy()
                matrix = asking.column("unit").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(qids), dim)
                for at in range(0, len(qids), QUESTIONS):
                    some, cutoff = matrix[at : at + QUESTIONS], cutoffs[at : at + QUESTIONS, None]
                    bound = np.cos(np.maximum(np.arccos(np.clip(some @ middle.T, -1, 1)) - width, 0))
                    visit = bound + SLACK >= cutoff
                    scores = np.full((len(some), len(keys)), -np.inf)
                    for pack in np.flatnonzero(visit.any(0)):
                        rows, span = np.flatnonzero(visit[:, pack]), slice(ends[pack - 1] if pack else 0, ends[pack])
                        scores[rows, span] = some[rows] @ units[span].T
                    if dead is not None:
                        scores[:, dead] = -np.inf
                    np.round(scores, DIGITS, out=scores)
                    least = max(0, len(keys) - k)
                    kth = np.partition(scores, least, axis=1)[:, least, None]
                    i, j = np.nonzero((scores >= np.maximum(kth, cutoff - SLACK)) & (scores > -np.inf))
                    order = np.lexsort((keys[j], -scores[i, j], i))
                    i, j = i[order], j[order]
                    keep = np.arange(len(i)) - np.searchsorted(i, i) < k
                    for column, value in zip(out, (qids[at + i[keep]], keys[j[keep]], scores[i[keep], j[keep]]), strict=True):
                        column.append(value)
            return pa.table([pa.array(np.concatenate(c)) for c in out], names=["qid", "key", "score"])

        return spread(held, *met).groupBy(*met).cogroup(spread(apart(own), *met).groupBy(*met)).applyInArrow(run, "qid long, key long, score double")

    turns = max(1, -(-asked.count() // QUESTIONS))
    by_near = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("near"), "pack"))
    opened = pairs(blocked, True).withColumn("nth", by_near).filter(F.col("nth") <= FIRST_PACKS).select("qid", "pack")
    opened = materialize(opened, "first-visits")
    best = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "key"))
    start = visited(opened, asked).withColumn("nth", best).filter(F.col("nth") <= k)
    cutoffs = materialize(start.filter(F.col("nth") == k).select("qid", F.col("score").alias("cutoff")), "dense-cutoffs")
    told_cutoff = blocked.join(cutoffs, "qid", "left").withColumn("cutoff", F.coalesce("cutoff", F.lit(-2.0)))
    if visits is not None:
        visits.append(materialize(pairs(told_cutoff, False).select("qid", "pack"), "visits"))
    found = scored(told_cutoff).withColumn("rank", best).filter(F.col("rank") <= k)
    return found.select("qid", F.col("key").alias(key), "score", "rank")
