"""Packed postings with block maxima, and exact top-k search that skips blocks.

The chunks of a scope lie in shards of a bounded number.  In a shard, chunks that share their most frequent
token are neighbours, and every ``RANGE`` of them are a range.  A token's postings in a shard are one row:
places and frequencies, and for each range that has the token the highest frequency and the least length
there, from which follows, whatever the statistics of the corpus, the most the token can add to a score in
that range.  A row with an empty token tells of the shard's chunks.

A search brings the rows of the tokens that questions ask for together with the questions of the scope, by
shard, so that a posting moves once however many questions want it.  For a question, the bounds of a range
are the sums of its tokens' maxima.  Ranges are scored from the highest bound down; when the k-th best
score beats the next bound, no other range can hold a result and all of them are skipped.  Where there are
many shards, a first share of them gives each question a score that k chunks reach, with which the others
start.  Scores are exact, and rows equal those of a search that scores everything.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions import text as X
from tessera.operators.durable import broadcast_if_small, materialize, spread
from tessera.schema import RETRIEVAL, Retrieval

SHARD_CHUNKS, RANGE = 4096, 32
#: Scores are compared after rounding, so that the order does not hang on the last bit.
DIGITS = 6
#: What sums of maxima may fall short of by rounding.
SLACK = 1e-5
#: Ranges that a search scores first, and then twice as many each time.
FIRST_RANGES = 4
#: Shards up to which a search starts without cutoffs; beyond, one shard in so many gives them.
FEW_SHARDS, FIRST_SHARE = 64, 16
#: Rows (a scope, or a token asked for) that may be broadcast.
SMALL = 200_000
SCOPE = ("project", "build")


def packed_schema(chunks: DataFrame, extra: tuple[str, ...] = ()) -> T.StructType:
    """(project, build, shard, token, n, total, packed, keys, places, *extra): ``keys``, ``places`` and
    ``extra`` are of the row with the empty token alone."""
    out = T.StructType().add("project", "string").add("build", "string").add("shard", "long").add("token", "string").add("n", "integer").add("total", "long").add("packed", "binary").add("keys", T.ArrayType(T.LongType()))
    out.add("places", T.ArrayType(chunks.schema["pos"].dataType))
    for name in extra:
        out.add(name, T.ArrayType(chunks.schema[name].dataType))
    return out


def packed(chunks: DataFrame, key: str, text_col: str = "content", extra: tuple[str, ...] = (), first_shard: int = 0) -> DataFrame:
    """Packed postings of ``chunks`` (key: long, pos, project, build, text, *extra); shards of a scope are
    numbered from ``first_shard``."""
    sizes = chunks.groupBy(*SCOPE).agg(F.ceil(F.count("*") / SHARD_CHUNKS).cast("int").alias("shards"))
    rows = chunks.select(*SCOPE, F.col(key).cast("long").alias("key"), "pos", F.coalesce(F.col(text_col), F.lit("")).alias("text"), *extra)
    rows = rows.join(broadcast_if_small(materialize(sizes, "scope-sizes"), SMALL), [*SCOPE])
    rows = rows.withColumn("shard", F.pmod(F.xxhash64("key"), "shards") + F.lit(first_shard).cast("long")).drop("shards")
    # Texts move, tokens do not: the second grouping is by the same keys.
    rows = spread(rows, *SCOPE, "shard").select(*SCOPE, "shard", "key", "pos", X.tokens(F.col("text")).alias("tokens"), *extra)
    schema = packed_schema(chunks, extra)

    def run(table: pa.Table) -> pa.Table:
        return pack_shard(table, extra)

    return rows.groupBy(*SCOPE, "shard").applyInArrow(run, schema)


def pack_shard(table: pa.Table, extra: tuple[str, ...] = ()) -> pa.Table:
    table = table.combine_chunks().sort_by("pos")
    n = table.num_rows
    lists = table.column("tokens").chunk(0) if table.column("tokens").num_chunks else table.column("tokens").combine_chunks()
    counts = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
    counts = np.nan_to_num(counts.astype(float)).astype(np.int64)
    flat = lists.flatten().dictionary_encode()
    words, codes = flat.dictionary, flat.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    both, tf = np.unique(codes * n + np.repeat(np.arange(n), counts), return_counts=True)
    code, doc = both // n, both % n
    # Chunks by their most frequent token, then by place.
    leading = np.full(n, -1)
    by_doc = np.lexsort((code, -tf, doc))
    first = np.flatnonzero(np.diff(doc[by_doc], prepend=-1))
    leading[doc[by_doc][first]] = code[by_doc][first]
    order = np.lexsort((np.arange(n), leading))
    spot_of = np.empty(n, np.int64)
    spot_of[order] = np.arange(n)
    spot = spot_of[doc]
    by_code = np.lexsort((spot, code))
    code, spot, tf = code[by_code], spot[by_code], tf[by_code]
    length = counts[order]
    of = spot // RANGE
    ranges = np.flatnonzero(np.r_[True, (np.diff(code) != 0) | (np.diff(of) != 0)]) if len(code) else np.empty(0, np.int64)
    most, least = (np.maximum.reduceat(tf, ranges), np.minimum.reduceat(length[spot], ranges)) if len(ranges) else (ranges, ranges)
    starts = np.flatnonzero(np.diff(code, prepend=-1))
    ends = np.r_[starts[1:], len(code)][: len(starts)]  # none if all texts are empty
    cuts = np.searchsorted(ranges, np.r_[starts, len(code)])
    spot, tf, of, most, least = (x.astype("<i4") for x in (spot, tf, of[ranges], most, least))
    data = []
    for a, b, c, d in zip(starts.tolist(), ends.tolist(), cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        data.append(b"".join((np.array([b - a, d - c], "<i4").tobytes(), spot[a:b].tobytes(), tf[a:b].tobytes(), of[c:d].tobytes(), most[c:d].tobytes(), least[c:d].tobytes())))
    own = table.take(pa.array(order))
    m = len(data)
    names = words.take(pa.array(code[starts])).to_pylist() if m else []
    told = [table.column(c)[:1].to_pylist() * (m + 1) for c in (*SCOPE, "shard")]

    def of_chunks(name: str) -> pa.Array:
        column = own.column(name)
        return pa.array([column.to_pylist(), *[None] * m], pa.list_(column.type))

    columns = [
        *(pa.array(x, t) for x, t in zip(told, (pa.string(), pa.string(), pa.int64()), strict=True)), pa.array(["", *names], pa.string()), pa.array([n, *(ends - starts).tolist()], pa.int32()),
        pa.array([int(length.sum()), *[None] * m], pa.int64()), pa.array([length.astype("<i4").tobytes(), *data], pa.binary()), of_chunks("key"), of_chunks("pos"), *map(of_chunks, extra),
    ]
    return pa.table(columns, names=[*SCOPE, "shard", "token", "n", "total", "packed", "keys", "places", *extra])


@dataclass
class Postings:
    """A token's row."""

    spots: np.ndarray
    times: np.ndarray
    ranges: np.ndarray
    most: np.ndarray
    least: np.ndarray

    @classmethod
    def read(cls, data: bytes) -> Postings:
        held = np.frombuffer(data, "<i4")
        n, r = held[:2].tolist()
        cuts = np.cumsum([2, n, n, r, r, r])
        return cls(*(held[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)))


def impact(times: np.ndarray, length: np.ndarray, avgdl: float, config: Retrieval) -> np.ndarray:
    """What a unit of weight adds: grows with the frequency and falls with the length."""
    return times * (config.k1 + 1) / (times + config.k1 * (1 - config.b + config.b * length / avgdl))


class Shard:
    """A shard's chunks and the postings of some tokens, ready for many questions."""

    def __init__(self, lengths: np.ndarray, rows: dict[str, Postings], avgdl: float, config: Retrieval, live: np.ndarray | None = None):
        self.n, self.live = len(lengths), live
        self.names = {token: i for i, token in enumerate(rows)}
        held = list(rows.values())
        join = lambda parts, kind: np.concatenate(parts) if parts else np.empty(0, kind)
        self.spots = join([p.spots for p in held], np.int32)
        self.impact = impact(join([p.times for p in held], np.int32).astype(float), lengths[self.spots].astype(float), avgdl, config)
        self.ranges = join([p.ranges for p in held], np.int32)
        self.most = impact(join([p.most for p in held], np.int32).astype(float), join([p.least for p in held], np.int32).astype(float), avgdl, config)
        first = np.cumsum([0, *(len(p.spots) for p in held)])
        self.starts = join([first[i] + np.searchsorted(p.spots, p.ranges.astype(np.int64) * RANGE) for i, p in enumerate(held)], np.int64)
        self.ends = np.r_[self.starts[1:], len(self.spots)] if len(held) else self.starts
        self.cuts = np.cumsum([0, *(len(p.ranges) for p in held)])

    def search(self, tokens: list[str], weights: list[float], k: int | None, cutoff: float = 0.0) -> tuple[np.ndarray, np.ndarray, int]:
        """(places, scores) of the k best chunks that share a token, equal scores by place, and how many
        postings were scored.  Without k, and where fewer than k score above zero, these are all that do."""
        known = [(self.names[t], w) for t, w in zip(tokens, weights, strict=True) if t in self.names]
        if not known:
            return np.empty(0, np.int64), np.empty(0), 0
        blocks = np.concatenate([np.arange(self.cuts[t], self.cuts[t + 1]) for t, _ in known])
        weight = np.repeat([w for _, w in known], [self.cuts[t + 1] - self.cuts[t] for t, _ in known])
        of = self.ranges[blocks]
        size = -(-self.n // RANGE)
        bounds = np.bincount(of, np.maximum(weight, 0) * self.most[blocks], size)
        asked = np.unique(of)
        asked = asked[np.argsort(-bounds[asked], kind="stable")]
        scores, met, scored, at, step = np.zeros(self.n), np.zeros(self.n, bool), 0, 0, FIRST_RANGES
        kth = cutoff
        while at < len(asked):
            if k is not None and kth > 0 and bounds[asked[at]] + SLACK < kth:
                break
            now = np.zeros(size, bool)
            now[asked[at : at + step]] = True
            at, step = at + step, step * 2
            mine = now[of]
            starts, lengths = self.starts[blocks[mine]], self.ends[blocks[mine]] - self.starts[blocks[mine]]
            flat = np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths) + np.repeat(starts, lengths)
            spots = self.spots[flat]
            scores += np.bincount(spots, np.repeat(weight[mine], lengths) * self.impact[flat], self.n)
            met[spots] = True
            scored += len(flat)
            if k is not None:
                found = np.flatnonzero(met if self.live is None else met & self.live)
                if len(found) >= k:
                    kth = max(kth, round(float(np.partition(scores[found], len(found) - k)[len(found) - k]), DIGITS))
        found = np.flatnonzero(met if self.live is None else met & self.live)
        rounded = np.round(scores[found], DIGITS)
        if k is None:
            return found, rounded, scored
        keep = rounded >= kth if kth > 0 else np.ones(len(found), bool)
        return found[keep], rounded[keep], scored


def apart(rows: DataFrame) -> DataFrame:
    """``rows`` with columns of their own, for a cogroup with rows of the same origin."""
    return rows.select(*(F.col(c).alias(c) for c in rows.columns))


def search(packs: DataFrame, asked: DataFrame, avgdl: DataFrame, k: int | None, config: Retrieval = RETRIEVAL, key: str = "chunk_key") -> DataFrame:
    """(qid, tier, key, pos, score): of each question and tier, the chunks of its scopes that may be among
    the k best (all that share a token, if ``k`` is null).

    ``asked``: (qid, tier, project, build, tokens, weights), a written table; ``avgdl``: one row.  A column
    ``live`` of the row of a shard, an array of booleans, tells which of its chunks count."""
    size = asked.agg(F.coalesce(F.sum(F.size("tokens")), F.lit(0)).alias("tokens"), F.count("*").alias("rows")).first()
    shards = packs.filter("token = ''").select(*SCOPE, "shard")
    n_shards = shards.count()

    def small(rows: DataFrame, most: int) -> DataFrame:
        return F.broadcast(rows) if most <= SMALL else rows

    tokens = asked.select(F.explode("tokens").alias("token")).unionAll(asked.sparkSession.range(1).select(F.lit("").alias("token"))).distinct()
    own = packs.join(F.broadcast(avgdl), F.lit(True)).join(small(tokens, size["tokens"]), "token", "left_semi")  # avgdl: one row
    own = own.join(small(asked.select(*SCOPE).distinct(), size["rows"]), [*SCOPE], "left_semi")
    wanted = asked.join(small(shards, n_shards), [*SCOPE]).select(*SCOPE, "shard", "qid", "tier", "tokens", "weights")
    place = packs.schema["places"].dataType.elementType
    schema = T.StructType().add("qid", asked.schema["qid"].dataType).add("tier", "integer").add(key, "long").add("pos", place).add("score", "double")

    def run(rows: pa.Table, questions: pa.Table) -> pa.Table:
        held = {token: i for i, token in enumerate(rows.column("token").to_pylist())}
        out = {name: [] for name in ("of", key, "pos", "score")}
        if questions.num_rows and "" in held:
            me, data = held.pop(""), rows.column("packed")
            keys, places = rows.column("keys")[me].values, rows.column("places")[me].values
            live = np.asarray(rows.column("live")[me].values.to_numpy(zero_copy_only=False), bool) if "live" in rows.column_names and rows.column("live")[me].is_valid else None
            shard = Shard(np.frombuffer(data[me].as_py(), "<i4"), {t: Postings.read(data[i].as_py()) for t, i in held.items()}, rows.column("avgdl")[0].as_py(), config, live)
            rank = np.empty(shard.n, np.int64)  # of each place in corpus order
            rank[pc.array_sort_indices(places).to_numpy()] = np.arange(shard.n)
            words, weights = questions.column("tokens").to_pylist(), questions.column("weights").to_pylist()
            cutoffs = questions.column("cutoff").to_pylist() if "cutoff" in questions.column_names else [0.0] * len(words)
            for i, (t, w) in enumerate(zip(words, weights, strict=True)):
                spots, scores, _ = shard.search(t, w, k, cutoffs[i] or 0.0)
                if k is not None and len(spots) > k and np.partition(scores, len(scores) - k)[len(scores) - k] > 0:
                    order = np.lexsort((rank[spots], -scores))[:k]
                    spots, scores = spots[order], scores[order]
                out["of"].append(np.full(len(spots), i))
                out["score"].append(scores)
                out["pos"].append(spots)
        join = lambda parts, kind: np.concatenate(parts).astype(kind) if parts else np.empty(0, kind)
        of, spots = pa.array(join(out["of"], np.int64)), pa.array(join(out["pos"], np.int64))
        told = [questions.column(c).take(of) for c in ("qid", "tier")]
        found = [x.take(spots) for x in (keys, places)] if len(spots) else [pa.array([], pa.int64()), pa.array([], rows.schema.field("places").type.value_type)]
        return pa.table([*told, *found, pa.array(join(out["score"], np.float64))], names=schema.names)

    def found(some: DataFrame, questions: DataFrame) -> DataFrame:
        keys = (*SCOPE, "shard")
        return spread(some, *keys).groupBy(*keys).cogroup(spread(apart(questions), *keys).groupBy(*keys)).applyInArrow(run, schema)

    if k is None or n_shards <= FEW_SHARDS:
        return found(own, wanted)
    first = F.pmod(F.xxhash64(*SCOPE, "shard"), F.lit(FIRST_SHARE)) == 0
    opened = materialize(found(own.filter(first), wanted.filter(first)), "first-found")
    nth = F.row_number().over(Window.partitionBy("qid", "tier").orderBy(F.desc("score")))
    reached = opened.withColumn("nth", nth).filter(F.col("nth") <= k).filter(F.col("nth") == k).select("qid", "tier", F.col("score").alias("cutoff"))
    told = materialize(reached, "first-cutoffs").withColumnsRenamed({"qid": "of", "tier": "at"})
    rest = wanted.filter(~first)
    rest = rest.join(broadcast_if_small(told, SMALL), rest["qid"].eqNullSafe(F.col("of")) & (rest["tier"] == F.col("at")), "left").drop("of", "at")
    return opened.unionAll(found(own.filter(~first), rest))


def read_shard(rows: pa.Table) -> tuple[int, pa.Array, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of a shard's rows: which one tells of its chunks, the other rows' tokens and how many postings each has; of
    all postings the places and frequencies; of the chunks the lengths and which of them count.  All rows are
    read at once."""
    rows = rows.combine_chunks()
    tokens, packed = (rows.column(c).chunk(0) for c in ("token", "packed"))
    me = pc.index(tokens, "").as_py()
    wide = np.int64 if pa.types.is_large_binary(packed.type) else np.int32
    at = np.frombuffer(packed.buffers()[1], wide)[packed.offset : packed.offset + len(packed) + 1].astype(np.int64) // 4
    data = np.frombuffer(packed.buffers()[2], "<i4", int(at[-1]))
    lengths = data[at[me] : at[me + 1]].astype(np.int64)
    live = rows.column("live")[me] if "live" in rows.column_names else None
    live = np.asarray(live.values.to_numpy(zero_copy_only=False), bool) if live is not None and live.is_valid else np.ones(len(lengths), bool)
    others = np.delete(np.arange(len(tokens)), me)
    n = data[at[others]].astype(np.int64)
    spot = np.repeat(at[others] + 2 - (np.cumsum(n) - n), n) + np.arange(n.sum())
    return me, tokens.take(pa.array(others)), n, data[spot], data[spot + np.repeat(n, n)].astype(np.int64), lengths, live


def unpacked(packs: DataFrame, key: str = "chunk_key") -> DataFrame:
    """(token, key, pos, length, tf) of all postings of live chunks."""
    place = packs.schema["places"].dataType.elementType
    schema = T.StructType().add("token", "string").add(key, "long").add("pos", place).add("length", "long").add("tf", "long")

    def run(rows: pa.Table) -> pa.Table:
        me, tokens, n, spots, times, lengths, live = read_shard(rows)
        keep = live[spots]
        at = pa.array(spots[keep])
        names = tokens.take(pa.array(np.repeat(np.arange(len(n)), n)[keep]))
        columns = [names, rows.column("keys")[me].values.take(at), rows.column("places")[me].values.take(at), pa.array(lengths[spots[keep]]), pa.array(times[keep])]
        return pa.table(columns, names=schema.names)

    return spread(packs, *SCOPE, "shard").groupBy(*SCOPE, "shard").applyInArrow(run, schema)


def totals(packs: DataFrame) -> DataFrame:
    """(token, df, tf, chars): of each token that live chunks have, how many of them, how often they have it, and
    their tokens in all.  Postings are added up where they are read, and leave as a row a shard and token."""
    held = packs.select(*SCOPE, "shard", "token", "packed", *(["live"] if "live" in packs.columns else []))
    schema = T.StructType().add("token", "string").add("df", "long").add("tf", "long").add("chars", "long")

    def run(rows: pa.Table) -> pa.Table:
        _, tokens, n, spots, times, lengths, live = read_shard(rows)
        if not len(n):
            return pa.table([pa.array([], f.type) for f in (pa.field("token", pa.string()), *[pa.field(c, pa.int64()) for c in ("df", "tf", "chars")])], names=schema.names)
        alive, first = live[spots], np.cumsum(n) - n
        df, tf, chars = (np.add.reduceat(x * alive, first) for x in (np.ones(len(spots), np.int64), times, lengths[spots]))
        return pa.table([tokens, pa.array(df), pa.array(tf), pa.array(chars)], names=schema.names).filter(pa.array(df > 0))

    found = spread(held, *SCOPE, "shard").groupBy(*SCOPE, "shard").applyInArrow(run, schema)
    return found.groupBy("token").agg(*(F.sum(c).alias(c) for c in ("df", "tf", "chars")))
