"""SimHash near-duplicates by vantage-point trees.

Fingerprints are compared, not documents: equal fingerprints collapse first, by map-side
aggregation, to one row with their smallest id.  A vantage-point tree deals the fingerprints into
shards by Hamming distance.  At each node the closer half and the farther half part; a fingerprint
whose distance lies so near the parting line that the triangle inequality allows a partner on the
other side visits that side too.  Of two close fingerprints on different sides the closer one
visits, so every pair meets in exactly one shard.  The tree grows in rounds of ``LEVELS`` levels:
each shard of a round gets a tree of its own, built in a task from a sample of those that live
there, so the sample as a whole grows with the fingerprints and neither it nor the tree is ever in
one place.  A shard of the last round runs the same search on, down to small blocks, and reports a
spanning forest of the pairs it found, so that a dense group costs rows in proportion to its
members, not its pairs.  Components of all forests give the groups.

Null and word-less texts have fingerprint zero, linked like any other.  Repeated rows get the same
group.  Rows with a null id take part, and join others, but never name a group, unless all of it is
null: then the group is null.  An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.components import LocalComponents, connected_components
from tessera.llm.shared import materialize, ship

SEED = 42
BITS = 64
#: Fingerprints that a shard holds on average, at most.
SHARD_SIZE = 8192
#: Levels of a tree, and fingerprints from which one is built, on average (16 for each leaf).
LEVELS = 8
SAMPLE = 16 << LEVELS
#: Visits of one shard that travel as one row.
CHUNK = 8192
#: Below this many members a shard compares directly.
BLOCK = 192


def fingerprint(text: str | None, words: int = 3) -> int:
    """Majority of the bits of the XXH64 hashes of all word shingles, repeats included."""
    tokens = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not tokens:
        return 0
    if len(tokens) <= words:
        return xxhash.xxh64_intdigest(b" ".join(tokens), SEED)
    line = b" ".join(tokens)
    ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    digest = xxhash.xxh64_intdigest
    n = len(tokens) - words + 1
    hashes = np.fromiter((digest(line[a:b], SEED) for a, b in zip(starts[:n].tolist(), ends[words - 1 :].tolist(), strict=True)), np.uint64, n)
    ones = np.zeros(BITS, np.int64)
    for at in range(0, n, 1 << 15):
        part = hashes[at : at + (1 << 15)]
        ones += np.unpackbits(part.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n, bitorder="little").tobytes(), "little")


def fingerprints(df: DataFrame, words: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp) per row of ``df``; fp is the fingerprint as a signed long."""
    ship(df.sparkSession)
    source = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    out = T.StructType([source.schema["id"], T.StructField("fp", T.LongType(), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = np.array([fingerprint(x.as_py(), words) for x in batch.column(1)], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made.view(np.int64))], names=["id", "fp"])

    return source.mapInArrow(run, out)


def distances(values: np.ndarray, point: np.uint64) -> np.ndarray:
    return np.bitwise_count(values ^ point)


class Tree:
    """Node i has vantage point ``points[i]`` and line ``lines[i]``; its closer half (distance at most
    the line) is node 2i + 1 and its farther half 2i + 2.  Leaves are numbered from 0."""

    def __init__(self, sample: np.ndarray, depth: int):
        self.depth = depth
        self.points = np.zeros(2**depth - 1, np.uint64)
        self.lines = np.full(2**depth - 1, BITS // 2, np.int64)
        held = {0: sample}
        for node in range(2**depth - 1):
            own = held.pop(node)
            if len(own):
                # Of a few candidates the one with the widest spread of distances parts best.
                tried = own[np.linspace(0, len(own) - 1, min(8, len(own))).astype(int)]
                spread = [distances(own, p).std() for p in tried]
                self.points[node] = tried[int(np.argmax(spread))]
                self.lines[node] = int(np.median(distances(own, self.points[node])))
            near = distances(own, self.points[node]) <= self.lines[node]
            held[2 * node + 1], held[2 * node + 2] = own[near], own[~near]

    def saved(self) -> tuple[bytes, bytes]:
        return self.points.tobytes(), self.lines.tobytes()

    @classmethod
    def loaded(cls, points: bytes, lines: bytes) -> Tree:
        tree = cls.__new__(cls)
        tree.points, tree.lines = np.frombuffer(points, np.uint64), np.frombuffer(lines, np.int64)
        tree.depth = int(len(tree.points) + 1).bit_length() - 1
        return tree

    def deal(self, values: np.ndarray, radius: int, resident: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(index into ``values``, leaf, whether it lives there) for all visits; who is no ``resident`` of
        the whole tree lives in no leaf."""
        index, node = np.arange(len(values)), np.zeros(len(values), np.int64)
        home = np.ones(len(values), bool) if resident is None else resident
        for _ in range(self.depth):
            far = np.bitwise_count(values[index] ^ self.points[node]).astype(np.int64) - self.lines[node]
            lives = np.where(far <= 0, 2 * node + 1, 2 * node + 2)
            # A resident of the closer half visits the farther one; a guest looks into both.
            cross = np.where(far <= 0, far > -radius, ~home & (far <= radius))
            other = np.where(far <= 0, 2 * node + 2, 2 * node + 1)
            index = np.concatenate((index, index[cross]))
            node = np.concatenate((lives, other[cross]))
            home = np.concatenate((home, np.zeros(int(cross.sum()), bool)))
        return index, node - (2**self.depth - 1), home


def close_pairs(asked: np.ndarray, held: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Arrays (index into asked, index into held) of all pairs within ``radius``, by a
    vantage-point tree over ``held`` that is walked as it is built."""
    todo = [(np.arange(len(asked)), np.arange(len(held)))]
    while todo:
        q, m = todo.pop()
        if not len(q) or not len(m):
            continue
        reach = distances(held[m], held[m[0]])
        line = int(np.median(reach))
        near = reach <= line
        if near.all():
            line = int(reach.max()) - 1
            near = reach <= line
        if len(m) <= BLOCK or not near.any():
            step = max(1, (1 << 18) // len(m))
            for at in range(0, len(q), step):
                part = q[at : at + step]
                i, j = np.nonzero(np.bitwise_count(asked[part][:, None] ^ held[m][None, :]) <= radius)
                if len(i):
                    yield part[i], m[j]
            continue
        seen = distances(asked[q], held[m[0]]).astype(np.int64)
        for side in (near, ~near):
            inner, outer = int(reach[side].min()), int(reach[side].max())
            todo.append((q[(seen >= inner - radius) & (seen <= outer + radius)], m[side]))


VISIT = "shard long, home boolean, fp long"


def visit_rows(tree: Tree, shard: int, fps: np.ndarray, home: np.ndarray, radius: int) -> pa.RecordBatch:
    """The visits of a shard's fingerprints to the leaves of its tree."""
    index, leaf, stays = tree.deal(fps.view(np.uint64), radius, home)
    return pa.RecordBatch.from_arrays([pa.array((shard << tree.depth) + leaf), pa.array(stays), pa.array(fps[index])], names=["shard", "home", "fp"])


def in_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Visits in the order of their shards to rows (shard, fps, homes) of at most ``CHUNK`` visits."""
    for batch in batches:
        shard, home, fps = (np.asarray(batch.column(k).to_numpy(zero_copy_only=False)) for k in range(3))
        cuts = np.flatnonzero(np.diff(shard, prepend=-1) != 0).tolist()
        spans = [(at, min(at + CHUNK, end)) for begin, end in zip(cuts, [*cuts[1:], len(shard)], strict=False) for at in range(begin, end, CHUNK)]
        columns = [pa.array(shard[[a for a, _ in spans]], pa.int64()), pa.array([fps[a:b].tobytes() for a, b in spans], pa.binary()), pa.array([home[a:b].tobytes() for a, b in spans], pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, names=["shard", "fps", "homes"])


def next_round(visits: DataFrame, turn: int, levels: int, share: float, radius: int) -> DataFrame:
    """Visits of the shards of a round to those of the next: ``share`` of the residents of each shard make
    its tree, and the shard's visits, in chunks, meet that tree."""

    def grow(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        points, lines = Tree(np.sort(frame["fp"].to_numpy(np.int64)).view(np.uint64), levels).saved()
        return pd.DataFrame({"shard": [key[0]], "points": [points], "lines": [lines]})

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                tree = Tree.loaded(row["points"], row["lines"]) if row["points"] is not None else Tree(np.empty(0, np.uint64), levels)
                yield visit_rows(tree, row["shard"], np.frombuffer(row["fps"], np.int64), np.frombuffer(row["homes"], bool), radius)

    drawn = visits.filter(F.col("home") & (F.pmod(F.xxhash64("fp", F.lit(turn)), F.lit(1_000_003)) < share * 1_000_003))
    trees = drawn.select("shard", "fp").groupBy("shard").applyInPandas(grow, "shard long, points binary, lines binary")
    ordered = visits.repartitionByRange("shard", "fp").sortWithinPartitions("shard")
    chunks = ordered.mapInArrow(in_chunks, "shard long, fps binary, homes binary")
    return chunks.join(materialize(trees, "vantage-trees"), "shard", "left").mapInArrow(deal, VISIT)


def shard_visits(values: DataFrame, radius: int) -> DataFrame:
    """(shard, home, fp): every fingerprint of ``values`` (distinct fp) once with ``home`` where it lives,
    and in the other shards where one of its partners may live."""
    count = values.count()
    left, done = max(0, int(np.ceil(np.log2(max(1, count) / SHARD_SIZE)))), 0
    levels = min(left, LEVELS)
    sample = values.select("fp").orderBy(F.xxhash64("fp")).limit(16 << levels).collect() if levels else []
    tree = Tree(np.array([row[0] for row in sample], np.int64).view(np.uint64), levels)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.asarray(batch.column(0).to_numpy(zero_copy_only=False), np.int64)
            yield visit_rows(tree, 0, fps, np.ones(len(fps), bool), radius)

    visits = values.select("fp").mapInArrow(deal, VISIT)
    while (left := left - levels) > 0:
        done, levels = done + levels, min(left, LEVELS)
        share = (16 << levels) * 2.0**done / count
        visits = next_round(materialize(visits, "visits"), done, levels, share, radius)
    return visits


def near_links(values: DataFrame, radius: int = 3) -> DataFrame:
    """``values`` (fp: distinct longs) to links (a, b) between fingerprints that connect all within
    ``radius`` bits."""
    ship(values.sparkSession)

    def search(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("fp", kind="stable")
        names = frame["fp"].to_numpy(np.int64)
        fps, home = names.view(np.uint64), np.flatnonzero(frame["home"].to_numpy())
        found = LocalComponents(len(fps))
        for i, j in close_pairs(fps, fps[home], radius):
            found.link(i, home[j])
        child, root = found.forest()
        return pd.DataFrame({"a": names[child], "b": names[root]})

    return shard_visits(values, radius).groupBy("shard").applyInPandas(search, "a long, b long")


def near_duplicates(df: DataFrame, words: int = 3, radius: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp, component_id) per row of ``df``: component_id is the smallest id whose fingerprint
    is reachable by links of at most ``radius`` bits."""
    docs = materialize(fingerprints(df, words, id_col, text_col), "fingerprints")
    values = materialize(docs.groupBy("fp").agg(F.min("id").alias("id")), "fingerprint-values")
    groups = connected_components(near_links(values, radius))
    named = values.join(groups, values["fp"] == groups["node"], "left").select("fp", "id", F.coalesce("component", "fp").alias("component"))
    named = materialize(named, "fingerprint-groups")
    least = materialize(named.groupBy("component").agg(F.min("id").alias("component_id")), "fingerprint-names")
    named = materialize(named.join(least, "component").select("fp", "component_id"), "named-fingerprints")
    return docs.join(named, "fp").select(F.col("id").alias(id_col), "fp", "component_id")


def hexadecimal(fp) -> object:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
