"""Near-duplicate documents at a given similarity, by SimHash sketches and banded minima.

Three bits of a 64-bit fingerprint link only texts that are nearly equal.  At a similarity of 0.8 of
the shingle sets, about 15 % of the bits differ, and distances between unrelated texts all lie near
half the bits: so wide a radius is more than the triangle inequality can prune, and trees would look
at all pairs.  Trees therefore find what is nearly equal, banded minima of the shingle hashes find
the rest, sketches of 256 bits sort the candidates, and every link is decided exactly:

1. Texts with equal sets of word shingles collapse to a class.  A class has a sketch (majority bits),
   whose first 64 bits are its fingerprint, and ``bands``: each a hash of the minima of ``ROWS``
   orderings of its shingles, of which sets as similar as asked share at least one, but for a share
   of ``MISS``.
2. One link a class is verified first: to its partner in the vantage-point trees of operator 5, or
   else to the smallest class with which it shares most bands.  Verified means that the Jaccard
   similarity of the two shingle sets reaches ``similarity``.  That already joins most of any large
   group of copies, at one link a member.
3. Groups of classes with a band in common (equal groups only once) that still hold several
   components meet: pairs in different components whose sketches lie within their radius are links
   to verify, if the group is small; of larger groups, the ends of such pairs are open classes.  A
   group of any size is met in blocks of a bounded size.
4. Open classes of meetings that have classes in common form one group, so that each text is read once.
   They go to tasks with their shingles, in chunks of a bounded size, and every link between different
   components is verified there.  Components of all verified links are the groups.

So the work follows the classes that share a band, not the square of all.  The radius of a pair of
sketches follows from its two numbers of shingles, so that another ``MISS`` of the pairs that similar
lie beyond it.

Null texts and texts without words form one class.  Repeated rows are in the same group.  Null ids
take part.  An empty table gives an empty result.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.components import LocalComponents, connected_components
from tessera.llm.shared import broadcast_if_small, free_name, materialize, ship
from tessera.llm.simhash import SEED, near_links

WORDS_64 = 4
#: Orderings whose minima make a band.
ROWS = 4
#: Classes of a block, on average, of a group too large to be compared at once.
BLOCK = 6144
#: Of pairs at the similarity asked for, the share that no band finds; also the share that lies beyond
#: the radius, for all bits and once more for the first ones, which are looked at first.
MISS = 1e-9
FIRST_WORDS = 2
#: Up to so many shingles, a pair's radius is that of its two numbers; beyond, the share of differing
#: bits only falls, and the radius is the largest from half this number on.
FEW = 64
#: Rows of ids and versions (about 40 bytes each) that may be broadcast.
SMALL_ROWS = 500_000
#: Classes of a group whose close pairs are handed on one by one.
TINY = 8
#: Shingles (8 bytes each) of a chunk of open classes; two chunks meet in a task.
CHUNK_SHINGLES = 2_000_000
#: Shingle sets that verification keeps at hand.
KEPT_SETS = 256


def shingle_hashes(text: str | None, words: int) -> np.ndarray:
    """XXH64 hashes of all word shingles (of the whole line if it is shorter), repeats included."""
    tokens = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not tokens:
        return np.empty(0, np.uint64)
    line = b" ".join(tokens)
    digest = xxhash.xxh64_intdigest
    if len(tokens) <= words:
        return np.array([digest(line, SEED)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = len(tokens) - words + 1
    return np.fromiter((digest(line[a:b], SEED) for a, b in zip(starts[:n].tolist(), ends[words - 1 :].tolist(), strict=True)), np.uint64, n)


def mixed(hashes: np.ndarray, nth: int) -> np.ndarray:
    """Another hash of each hash (the public SplitMix64 finaliser); the 0th is the hash itself."""
    if nth == 0:
        return hashes
    with np.errstate(over="ignore"):
        z = hashes + np.uint64((nth * 0x9E3779B97F4A7C15) & (2**64 - 1))
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return z ^ (z >> np.uint64(31))


def sketch(hashes: np.ndarray) -> bytes:
    """256 majority bits over the distinct shingles of a text; zero bits if it has none."""
    out = np.zeros(WORDS_64, np.uint64)
    for nth in range(WORDS_64 if len(hashes) else 0):
        ones = np.zeros(64, np.int64)
        for at in range(0, len(hashes), 1 << 15):
            part = mixed(hashes[at : at + (1 << 15)], nth).astype("<u8")
            ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        out[nth] = np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0]
    return out.astype("<u8").tobytes()


def band_count(similarity: float) -> int:
    return math.ceil(math.log(MISS) / math.log1p(-(similarity**ROWS))) if similarity < 1 else 1


def bands(hashes: np.ndarray, count: int) -> np.ndarray:
    """A key for each band: a hash of its number and of the least distinct shingles in ``ROWS`` orderings."""
    if not len(hashes):
        return np.empty(0, np.int64)
    # An ordering multiplies the hashes, which are random already, by an odd number.
    factors = mixed(np.arange(count * ROWS, dtype=np.uint64), 1) | np.uint64(1)
    least = np.full(count * ROWS, np.iinfo(np.uint64).max)
    for at in range(0, len(hashes), 512):
        np.minimum(least, np.minimum.reduce(hashes[at : at + 512, None] * factors, axis=0), out=least)
    key = np.arange(1, count + 1, dtype=np.uint64)
    for row in least.reshape(count, ROWS).T:
        key = mixed(key ^ row, 1)
    return key.view(np.int64)


SKETCHED = [
    T.StructField("version", T.LongType(), False), T.StructField("shingles", T.BinaryType(), False), T.StructField("n", T.LongType(), False),
    T.StructField("fp", T.LongType(), False), T.StructField("sketch", T.BinaryType(), False), T.StructField("bands", T.ArrayType(T.LongType(), False), False),
]


def sketches(df: DataFrame, words: int, similarity: float, id_col: str, text_col: str) -> DataFrame:
    """(id, version, shingles, n, fp, sketch, bands) per row: version is a hash of the text, which with
    the id names a row, shingles a hash of the set of its n distinct shingles, fp the sketch's first bits."""
    ship(df.sparkSession)
    text, count = F.col(text_col).cast("string"), band_count(similarity)
    source = df.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("version"), text.alias("text"))
    out = T.StructType([source.schema["id"], *SKETCHED])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            every = [np.unique(shingle_hashes(text.as_py(), words)) for text in batch.column(2)]
            made = [sketch(hashes) for hashes in every]
            columns = [
                pa.array([xxhash.xxh3_128_digest(hashes.tobytes()) for hashes in every], pa.binary()), pa.array([len(hashes) for hashes in every], pa.int64()),
                pa.array(matrix(made)[:, 0].view(np.int64) if made else [], pa.int64()), pa.array(made, pa.binary()), pa.array([bands(hashes, count) for hashes in every], pa.list_(pa.field("element", pa.int64(), False))),
            ]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], names=out.names)

    return source.mapInArrow(run, out)


def matrix(sketched: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(sketched), "<u8").reshape(-1, WORDS_64)


def differing(shared: int, more: int, other: int) -> float:
    """The probability that a bit differs between two texts with so many shingles in common and on
    either side alone: each shingle sets it or not, at even odds, and the strict majority decides."""

    def odds(n: int) -> np.ndarray:
        return np.array([math.comb(n, k) / 2**n for k in range(n + 1)])

    def one(alone: int) -> np.ndarray:
        ones = np.arange(shared + 1)[:, None] + np.arange(alone + 1)
        return (2 * ones > shared + alone) @ odds(alone)

    a, b = one(more), one(other)
    return float(odds(shared) @ (a + b - 2 * a * b))


def tail_bound(probability: float, bits: int) -> int:
    """The least number that at most ``MISS`` of all draws of ``bits`` bits exceed."""
    chance = [math.comb(bits, k) * probability**k * (1 - probability) ** (bits - k) for k in range(bits + 1)]
    above = np.cumsum(chance[::-1])[::-1]
    return int(np.flatnonzero(np.append(above[1:], 0.0) <= MISS)[0])


@functools.lru_cache(maxsize=8)
def radii(similarity: float) -> np.ndarray:
    """The radius over all bits and over the first ones, by the numbers of shingles of two texts (more
    than ``FEW`` count as one more); -1 where only equal sets are that similar."""
    worst = np.full((FEW + 2, FEW + 2), -1.0)
    for a in range(1, FEW + 1):
        for b in range(a, FEW + 1):
            for shared in range(a, 0, -1):
                if shared / (a + b - shared) < similarity:
                    break
                if shared < b:
                    worst[a, b] = worst[b, a] = max(worst[a, b], differing(shared, a - shared, b - shared))
    many = worst[FEW // 2 : FEW + 1, FEW // 2 : FEW + 1].max()
    reach = np.arange(FEW + 2) >= similarity * (FEW + 1)
    worst[FEW + 1, reach] = worst[reach, FEW + 1] = many
    out = np.full((2, *worst.shape), -1, np.int64)
    for p in np.unique(worst[worst >= 0]):
        out[:, worst == p] = np.array([[tail_bound(p, 64 * WORDS_64)], [tail_bound(p, 64 * FIRST_WORDS)]])
    return out


def close(one: np.ndarray, n_one: np.ndarray, other: np.ndarray, n_other: np.ndarray, same: bool, radius: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(index into one, index into other, distance) of the pairs within their ``radii``; ``n_one`` and
    ``n_other`` are the numbers of shingles."""
    few_one, few_other = np.minimum(n_one, FEW + 1), np.minimum(n_other, FEW + 1)
    first_radius = int(radius[1][np.ix_(np.unique(few_one), np.unique(few_other))].max(initial=-1))
    if first_radius < 0:
        return
    first = [np.ascontiguousarray(other[:, w]) for w in range(FIRST_WORDS)]
    for at in range(0, len(one), 64):
        part = one[at : at + 64]
        seen = np.bitwise_count(part[:, :1] ^ first[0][None, :])
        for w in range(1, FIRST_WORDS):
            seen += np.bitwise_count(part[:, w : w + 1] ^ first[w][None, :])
        spots = np.flatnonzero(seen <= first_radius)
        i, j = spots // len(other), spots % len(other)
        if same:
            later = j > i + at
            i, j = i[later], j[later]
        for cut in range(0, len(i), 1 << 18):
            p, q = i[cut : cut + (1 << 18)], j[cut : cut + (1 << 18)]
            far = np.bitwise_count(part[p] ^ other[q]).sum(axis=1, dtype=np.int64)
            near = far <= radius[0][few_one[p + at], few_other[q]]
            yield p[near] + at, q[near], far[near]


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Of two arrays of distinct hashes."""
    shared = len(np.intersect1d(a, b, assume_unique=True))
    return shared / (len(a) + len(b) - shared) if len(a) + len(b) else 1.0


def band_groups(classes: DataFrame) -> DataFrame:
    """(key, size, times, class): the members of every group of two or more classes that share a band;
    ``times`` is how many bands the same classes share."""
    keys = classes.select("class", F.explode("bands").alias("key"))
    groups = keys.groupBy("key").agg(F.count("*").alias("size"), F.bit_xor(F.xxhash64("class")).alias("members")).filter("size > 1")
    groups = groups.groupBy("size", "members").agg(F.min("key").alias("key"), F.count("*").alias("times")).select("key", "size", "times")
    return keys.join(broadcast_if_small(materialize(groups, "band-groups"), SMALL_ROWS), "key").select("key", "size", "times", "class")


def first_links(classes: DataFrame, members: DataFrame) -> DataFrame:
    """(a, b): one link for each class that may have one, to its partner in the trees or to the least class
    with which it shares most bands."""
    leads = materialize(classes.filter("n > 0").groupBy("fp").agg(F.min("class").alias("lead")), "fingerprint-leads")
    near = materialize(near_links(leads.select("fp")), "fingerprint-links")
    one, other = leads.select(F.col("fp").alias("a"), F.col("lead").alias("class")), leads.select(F.col("fp").alias("b"), F.col("lead").alias("near"))
    treed = near.join(one, "a").join(other, "b").select("class", "near")
    treed = treed.unionAll(classes.join(leads, "fp").filter("n > 0 and class <> lead").select("class", F.col("lead").alias("near")))
    least = materialize(members.groupBy("key").agg(F.min("class").alias("least")), "band-leads")
    shared = members.join(least, "key").filter("class <> least").groupBy("class", "least").agg(F.sum("times").alias("times"))
    most = shared.groupBy("class").agg(F.max_by("least", F.struct("times", -F.col("least"))).alias("least"))
    both = most.join(treed, "class", "full_outer").select("class", F.coalesce("near", "least").alias("other"))
    return both.select(F.least("class", "other").alias("a"), F.greatest("class", "other").alias("b")).distinct()


def with_components(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """``rows`` (class, ...) with ``component``."""
    return rows.join(groups, rows["class"] == groups["node"], "left").select(*rows.columns, F.coalesce("component", "class").alias("component"))


def of_several(rows: DataFrame, *by: str) -> DataFrame:
    """The rows of groups that hold several components."""
    several = rows.groupBy(*by).agg(F.min("component").alias("least"), F.max("component").alias("most")).filter("least < most")
    return rows.join(materialize(several.select(*by), "of-several"), [*by], "left_semi")


MEETING = ("key", "one", "other")
FOUND = "key long, one int, other int, second boolean, a long, b long"


def meetings(members: DataFrame, classes: DataFrame) -> DataFrame:
    """Members with their sketches, by meeting (key, one, other): a group as it is, or two of its blocks,
    where ``second`` tells the members of the second."""
    blocks = F.ceil(F.col("size") / BLOCK).cast("int")
    rows = members.withColumn("block", F.pmod(F.xxhash64("class", "key"), blocks).cast("int")).withColumn("partner", F.explode(F.sequence(F.lit(0), blocks - 1)))
    rows = rows.select("key", F.least("block", "partner").alias("one"), F.greatest("block", "partner").alias("other"), (F.col("block") > F.col("partner")).alias("second"), "size", "class", "component")
    return rows.join(classes.select("class", "n", "sketch"), "class")


def close_links(met: DataFrame, similarity: float) -> DataFrame:
    """(key, one, other, second, a, b): links between components whose sketches are close, where b is not
    null; otherwise ``a`` is an open class of the meeting."""
    radius = radii(similarity)
    ship(met.sparkSession)

    def found(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        key, one, other, names, component, n = (rows[x].to_numpy() for x in (*MEETING, "class", "component", "n"))
        second, values = rows["second"].to_numpy(zero_copy_only=False), matrix(rows["sketch"].to_pylist())
        begins = np.flatnonzero(np.r_[True, (np.diff(key) != 0) | (np.diff(one) != 0) | (np.diff(other) != 0)])
        sizes = np.diff(np.r_[begins, len(key)])
        group, few, tiny = np.repeat(np.arange(len(begins)), sizes), np.minimum(n, FEW + 1), np.repeat(sizes <= TINY, sizes)
        links = []
        for apart in range(1, min(TINY, len(key))):  # members of small groups, by their distance in the table
            i = np.flatnonzero((group[:-apart] == group[apart:]) & tiny[:-apart] & (component[:-apart] != component[apart:]))
            far = np.bitwise_count(values[i] ^ values[i + apart]).sum(axis=1, dtype=np.int64)
            i = i[far <= radius[0][few[i], few[i + apart]]]
            links.append(np.stack((names[i], names[i + apart])))
        a, b = np.concatenate(links, axis=1) if links else np.empty((2, 0), np.int64)
        nothing = pa.array(np.zeros(len(a), np.int32))
        yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(a), np.int64)), nothing, nothing, pa.array(np.zeros(len(a), bool)), pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=names_found)
        for k in np.flatnonzero(sizes > TINY).tolist():
            at = slice(begins[k], begins[k] + sizes[k])
            open_ = np.zeros(sizes[k], bool)
            for i, j in paired(second[at], component[at], values[at], n[at], radius):
                open_[i] = open_[j] = True
            own = np.flatnonzero(open_) + begins[k]
            columns = [pa.array(x[own]) for x in (key, one, other, second, names)]
            yield pa.RecordBatch.from_arrays([*columns, pa.nulls(len(own), pa.int64())], names=names_found)

    names_found = ["key", "one", "other", "second", "a", "b"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            held = rows if held is None else pa.concat_tables([held, rows]).combine_chunks()
            # The last meeting may go on in the next batch.
            last = [held[x].to_numpy() for x in MEETING]
            same = np.logical_and.reduce([x == x[-1] for x in last]) if len(held) else np.empty(0, bool)
            whole = int(np.argmax(same)) if len(held) else 0
            if whole:
                yield from found(held.slice(0, whole).combine_chunks())
                held = held.slice(whole).combine_chunks()
        if held is not None and len(held):
            yield from found(held)

    ordered = met.select(*MEETING, "second", "class", "component", "n", "sketch").repartition(*MEETING).sortWithinPartitions(*MEETING, "second", "class")
    return ordered.mapInArrow(run, FOUND)


def verified(links: DataFrame, texts: DataFrame, words: int, similarity: float) -> DataFrame:
    """The links (a, b) whose texts, by class, reach ``similarity``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[int, np.ndarray] = {}

        def shingles(name: int, text: pa.Scalar) -> np.ndarray:
            if name not in kept:
                if len(kept) >= KEPT_SETS:
                    kept.clear()
                kept[name] = np.unique(shingle_hashes(text.as_py(), words))
            return kept[name]

        for batch in batches:
            a, b = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            keep = [jaccard(shingles(i, x), shingles(j, y)) >= similarity for i, j, x, y in zip(a, b, batch.column(2), batch.column(3), strict=True)]
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(mask), batch.column(1).filter(mask)], names=["a", "b"])

    one = texts.select(F.col("class").alias("a"), F.col("text").alias("text_a"))
    other = texts.select(F.col("class").alias("b"), F.col("text").alias("text_b"))
    return links.join(one, "a").join(other, "b").select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long")


def paired(second: np.ndarray, component: np.ndarray, values: np.ndarray, n: np.ndarray, radius: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of close classes in different components: of the first and the ``second`` block or chunk, or
    of the first alone if it meets itself."""
    one, other = np.flatnonzero(~second), np.flatnonzero(second)
    same = not len(other)
    other = one if same else other
    for i, j, _ in close(values[one], n[one], values[other], n[other], same, radius):
        a, b = one[i], other[j]
        apart = component[a] != component[b]
        yield a[apart], b[apart]


def paired_rows(frame: pd.DataFrame, radius: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    return paired(frame["second"].to_numpy(bool), frame["component"].to_numpy(np.int64), matrix(frame["sketch"].tolist()), frame["n"].to_numpy(np.int64), radius)


def chunked(frame: pd.DataFrame, radius: np.ndarray) -> pd.DataFrame:
    """The open classes of a meeting that still have a link to another component, once for each pair of
    chunks with such links that they belong to."""
    frame = frame.sort_values(["second", "class"], kind="stable", ignore_index=True)
    chunk = (frame["n"].cumsum().to_numpy(np.int64) - 1) // CHUNK_SHINGLES
    second = frame["second"].to_numpy(bool)
    if second.any():  # no chunk reaches over both blocks
        chunk = np.where(second, chunk + 1, chunk)
    _, chunk = np.unique(chunk, return_inverse=True)
    meets = np.zeros((len(frame), int(chunk.max()) + 1), bool)
    for a, b in paired_rows(frame, radius):
        meets[a, chunk[b]] = meets[b, chunk[a]] = True
    row, partner = np.nonzero(meets)
    own = chunk[row]
    out = frame.iloc[row].assign(low=np.minimum(own, partner), high=np.maximum(own, partner), second=own > partner)
    return out[[*MEETING, "low", "high", "second", "class", "component", "n", "sketch"]]


def settled(frame: pd.DataFrame, words: int, similarity: float, radius: np.ndarray) -> pd.DataFrame:
    """Verified links (a, b) that join all components of two chunks that verified links can join."""
    sets = [np.unique(shingle_hashes(text, words)) for text in frame["text"]]
    n = np.array([len(x) for x in sets], np.int64)
    every, place = np.unique(np.concatenate(sets), return_inverse=True)
    ends = np.cumsum(n)
    names, first = frame["class"].to_numpy(np.int64), np.unique(frame["component"].to_numpy(np.int64), return_inverse=True)[1]
    joined, held, kept = LocalComponents(int(first.max()) + 1), np.zeros(len(every), bool), []
    for a, b in paired_rows(frame, radius):
        for i in np.unique(a):
            own = place[ends[i] - n[i] : ends[i]]
            todo = b[a == i]
            todo = todo[(joined.root[first[todo]] != joined.root[first[i]]) & (np.minimum(n[todo], n[i]) > 0)]
            if not len(todo):
                continue
            held[own] = True
            starts = np.cumsum(n[todo]) - n[todo]
            shared = np.add.reduceat(held[np.concatenate([place[ends[j] - n[j] : ends[j]] for j in todo])], starts, dtype=np.int64)
            held[own] = False
            good = todo[shared / (n[todo] + n[i] - shared) >= similarity]
            joined.link(np.full(len(good), first[i]), first[good])
            kept.append(np.stack((np.full(len(good), names[i]), names[good])))
    a, b = np.concatenate(kept, axis=1) if kept else np.empty((2, 0), np.int64)
    return pd.DataFrame({"a": a, "b": b})


def open_clusters(left: DataFrame) -> DataFrame:
    """Open classes (key, one, other, class, component) as members (key, size, class, component) of one group
    for all meetings that have classes in common, so that a text is read once and not once a band."""
    leads = left.groupBy(*MEETING).agg(F.min("class").alias("lead"))
    links = left.join(materialize(leads, "open-leads"), [*MEETING]).select(F.col("class").alias("a"), F.col("lead").alias("b"))
    clusters = connected_components(links).select(F.col("node").alias("class"), F.col("component").alias("key"))
    members = materialize(left.select("class", "component").distinct().join(clusters, "class"), "open-members")
    return members.join(members.groupBy("key").agg(F.count("*").alias("size")), "key").select("key", "size", "class", "component")


def class_texts(df: DataFrame, classes: DataFrame, wanted: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(class, text) for the classes in ``wanted``."""
    wanted = wanted.select("class").distinct().join(classes.select("class", "least.id", "least.version"), "class")
    wanted = broadcast_if_small(materialize(wanted.withColumnsRenamed({"id": "of", "version": "at"}), "sketch-wanted"), SMALL_ROWS)
    text = F.col(text_col).cast("string")
    source = df.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("version"), text.alias("text"))
    texts = source.join(wanted, (source["version"] == wanted["at"]) & source["id"].eqNullSafe(wanted["of"])).groupBy("class").agg(F.first("text").alias("text"))
    return materialize(texts, "sketch-texts")


def similar_documents(df: DataFrame, words: int = 5, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, version, component_id, kept) per distinct (id, version): kept is true for one row of
    each group, that with the smallest id (and, of those, the smallest version)."""
    rows = materialize(sketches(df, words, similarity, id_col, text_col), "sketches")
    name = F.struct(F.col("id").isNull().alias("last"), "id", "version")
    classes = rows.groupBy("shingles").agg(F.min(name).alias("least"), *[F.first(x).alias(x) for x in ("n", "fp", "sketch", "bands")])
    classes = materialize(classes.withColumn("class", F.monotonically_increasing_id()), "sketch-classes")
    members = materialize(band_groups(classes), "band-members")

    def checked(links: DataFrame, tag: str) -> DataFrame:
        texts = class_texts(df, classes, links.select(F.explode(F.array("a", "b")).alias("class")), id_col, text_col)
        return materialize(verified(links, texts, words, similarity), tag)

    first = materialize(first_links(classes, members), "first-links")
    good = checked(first, "first-verified")
    placed = of_several(materialize(with_components(members, connected_components(good)), "placed-members"), "key")
    found = materialize(close_links(meetings(placed, classes), similarity), "close-links")
    more = found.filter("b is not null").select("a", "b").distinct().join(first, ["a", "b"], "left_anti")
    good = good.unionAll(checked(materialize(more, "more-links"), "more-verified"))
    groups = connected_components(good)
    # Open classes matter only between components.
    left = found.filter("b is null").select(*MEETING, F.col("a").alias("class"))
    left = materialize(of_several(materialize(with_components(left, groups), "open-classes"), *MEETING), "left-open")
    if left.limit(1).count():
        left = open_clusters(left)
        radius = radii(similarity)
        met = meetings(left, classes).drop("size")
        chunks = met.groupBy(*MEETING).applyInPandas(lambda frame: chunked(frame, radius), "key long, one int, other int, low long, high long, second boolean, class long, component long, n long, sketch binary")
        chunks = materialize(chunks, "sketch-chunks")
        texts = class_texts(df, classes, chunks, id_col, text_col)
        late = chunks.join(texts, "class").groupBy(*MEETING, "low", "high").applyInPandas(lambda frame: settled(frame, words, similarity, radius), "a long, b long")
        groups = connected_components(good.unionAll(materialize(late, "sketch-settled")))
    named = materialize(with_components(classes.select("class", "shingles", "least"), groups), "sketch-groups")
    least = materialize(named.groupBy("component").agg(F.min("least").alias("first")), "sketch-firsts")
    named = materialize(named.join(least, "component").select("shingles", "first"), "sketch-named")
    kept = F.col("id").eqNullSafe(F.col("first.id")) & (F.col("version") == F.col("first.version"))
    out = rows.select("id", "version", "shingles").distinct().join(named, "shingles").select("id", "version", F.col("first.id").alias("component_id"), kept.alias("kept"))
    return out.withColumnRenamed("id", id_col)


def deduplicated(df: DataFrame, words: int = 5, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``df`` with one row of each group of near-duplicates; all its columns stay as they are."""
    of = free_name(df.columns, "near_id")
    at = free_name([*df.columns, of], "near_version")
    found = materialize(similar_documents(df, words, similarity, id_col, text_col), "similar")
    lost = materialize(found.filter("not kept").select(F.col(id_col).alias(of), F.col("version").alias(at)), "lost")
    lost = broadcast_if_small(lost, SMALL_ROWS)
    version = F.xxhash64(F.col(text_col).cast("string"))
    left = df.join(lost, df[id_col].eqNullSafe(F.col(of)) & (version == F.col(at)), "left_anti")
    # Rows that repeat both id and text share a name; only those are looked at again.
    names = df.select(F.col(id_col).alias(of), version.alias(at)).groupBy(of, at).agg(F.count("*").alias("near_rows")).filter("near_rows > 1")
    names = materialize(names.select(of, at), "repeated")
    if not names.limit(1).count():
        return left
    on = left[id_col].eqNullSafe(F.col(of)) & (version == F.col(at))
    once = left.join(names, on, "left_semi").withColumn(at, version)
    return left.join(names, on, "left_anti").unionByName(once.dropDuplicates([id_col, at]).drop(at))
