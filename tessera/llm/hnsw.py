"""Embedding near-duplicates by navigable small-world graphs.

Vectors are compared within a label.  Equal vectors of a label collapse to one class first.  Each
label's classes are dealt over shards of a bounded size, and each shard builds a hierarchical
navigable small-world graph.  Every two shards of a label (and each with itself) then meet: the
vectors of either are looked up in the graph of the other.  All look-ups of a block walk the graph in step,
as array operations.

Beams widen until audits pass: a fixed sample of look-ups is compared with all vectors of the
shard, and if too few of their links or nearest neighbours were found, all look-ups run again with
a beam twice as wide.  A look-up whose whole beam would link may have more links than the beam is
wide, so it too runs again wider.  The widest beam is the shard itself, as a matrix product, so a
dense cluster gets all its links and a failed audit never stands.

Pairs are verified by cosine in double precision.  A meeting of two shards hands on, per class, how
many vectors it linked to, and a spanning forest of its links; components join the forests.

Vectors that are null, empty, zero or hold null or non-finite components, and rows with a null
label, link with nothing.  Vectors of unequal length never link.  Repeated rows are vectors of
their own: they link with each other as equal vectors do.  A row with a null id takes part but does
not name a component, unless it is alone: then the component is null.  An empty table gives an
empty result.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.components import LocalComponents, connected_components
from tessera.llm.shared import materialize, ship

#: Vectors of a shard, on average, at most: bounds the memory of a meeting.
SHARD = 8192
#: Links of a node on the ground layer and above it; beam while building.
GROUND, UPPER, BUILD_BEAM = 24, 12, 40
#: Beams of look-ups; after the last comes the whole shard.
BEAMS = (48, 96, 192)
#: Look-ups that walk in step, and look-ups audited in a shard.
STEP, AUDITED = 512, 96
#: Shares of the audited links, and of the audited nearest neighbours, that must be found.
LINK_RECALL, NEAR_RECALL, NEAREST = 0.99, 0.9, 8


class Graph:
    """A hierarchical navigable small-world graph over unit vectors (float32)."""

    def __init__(self, vectors: np.ndarray, seed: int = 7):
        self.vectors = vectors
        n = len(vectors)
        rng = np.random.default_rng(seed)
        self.order = rng.permutation(n)
        level = np.minimum((-np.log(1 - rng.random(n)) / np.log(UPPER)).astype(int), 6)
        level[self.order[0]] = max(1, int(level.max(initial=0)))
        self.level = level
        self.layers = [np.full((n, GROUND if k == 0 else UPPER), -1, np.int32) for k in range(int(level.max(initial=0)) + 1)]
        self.entry = int(self.order[0])
        self._build()

    def _build(self) -> None:
        done, n = 1, len(self.vectors)
        while done < n:
            batch = self.order[done : done + min(STEP, max(8, done))]
            self._insert(batch)
            done += len(batch)

    def _insert(self, batch: np.ndarray) -> None:
        queries = self.vectors[batch]
        start = np.full((len(batch), 1), self.entry)
        mates = queries @ queries.T
        np.fill_diagonal(mates, -np.inf)
        for k in range(len(self.layers) - 1, -1, -1):
            own = np.flatnonzero(self.level[batch] >= k)
            ids, _ = self.walk(queries, start, k, BUILD_BEAM if k == 0 else 8)
            if len(own):
                # Candidates come from the graph and from the rest of the batch.
                near = mates[np.ix_(own, own)]
                width = min(8, len(own) - 1)
                peers = np.argpartition(-near, width - 1, axis=1)[:, :width] if width > 0 else np.empty((len(own), 0), int)
                both = np.concatenate((ids[own], batch[own][peers] if width > 0 else np.empty((len(own), 0), int)), axis=1)
                chosen = self.choose(batch[own], both, self.layers[k].shape[1])
                self.layers[k][batch[own]] = chosen
                self._link_back(k, batch[own], chosen)
            start = ids[:, :4]

    def _link_back(self, k: int, batch: np.ndarray, chosen: np.ndarray) -> None:
        source, target = np.repeat(batch, chosen.shape[1]), chosen.ravel()
        source, target = source[target >= 0], target[target >= 0]
        order = np.argsort(target, kind="stable")
        source, target = source[order], target[order]
        nodes, first, count = np.unique(target, return_index=True, return_counts=True)
        nth = np.arange(len(target)) - np.repeat(first, count)
        width = min(int(count.max(initial=0)), 2 * self.layers[k].shape[1])
        fresh = np.full((len(nodes), width), -1, np.int64)
        keep = nth < width
        fresh[np.repeat(np.arange(len(nodes)), count)[keep], nth[keep]] = source[keep]
        self.layers[k][nodes] = self.choose(nodes, np.concatenate((self.layers[k][nodes], fresh), axis=1), self.layers[k].shape[1])

    def choose(self, nodes: np.ndarray, candidates: np.ndarray, width: int) -> np.ndarray:
        """Up to ``width`` links per node: nearest first, skipping those nearer to a link already
        taken than to the node; places left over go to the nearest skipped ones."""
        out = np.full((len(nodes), width), -1, np.int32)
        for at in range(0, len(nodes), 256):
            own, cand = nodes[at : at + 256], candidates[at : at + 256]
            sims = np.einsum("bcd,bd->bc", self.vectors[cand], self.vectors[own])
            sims[(cand < 0) | (cand == own[:, None])] = -np.inf
            order = np.argsort(-sims, axis=1)[:, : 2 * width]
            cand, sims = np.take_along_axis(cand, order, 1), np.take_along_axis(sims, order, 1)
            repeat = np.zeros(cand.shape, bool)
            for j in range(1, cand.shape[1]):
                repeat[:, j] = (cand[:, :j] == cand[:, j : j + 1]).any(axis=1)
            sims[repeat] = -np.inf
            near = self.vectors[cand]
            among = np.matmul(near, near.transpose(0, 2, 1))
            taken = np.zeros(cand.shape, bool)
            for j in range(cand.shape[1]):
                free = taken.sum(axis=1) < width
                shaded = (np.where(taken, among[:, j, :], -np.inf) > sims[:, j : j + 1]).any(axis=1)
                taken[:, j] = free & ~shaded & np.isfinite(sims[:, j])
            rank = np.where(taken, 0, 1) * 1000 + np.arange(cand.shape[1])
            rank[~np.isfinite(sims)] = 10**6
            best = np.argsort(rank, axis=1, kind="stable")[:, :width]
            got = np.take_along_axis(cand, best, 1)
            got[np.take_along_axis(rank, best, 1) >= 10**6] = -1
            out[at : at + 256, : got.shape[1]] = got
        return out

    def walk(self, queries: np.ndarray, start: np.ndarray, k: int, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """Beam search on layer k for all queries in step: (ids, similarities), best first; -1
        fills up."""
        n, b, links = len(self.vectors), len(queries), self.layers[k]
        seen = np.zeros((b, n + 1), bool)
        seen[:, n] = True  # where missing links (-1) point
        ids = np.full((b, beam), -1, np.int64)
        sims = np.full((b, beam), -np.inf, np.float32)
        width = min(start.shape[1], beam)
        ids[:, :width] = start[:, :width]
        sims[:, :width] = np.where(ids[:, :width] >= 0, np.einsum("bcd,bd->bc", self.vectors[ids[:, :width]], queries), -np.inf)
        np.put_along_axis(seen, np.where(ids[:, :width] >= 0, ids[:, :width], n), True, 1)
        done = sims == -np.inf
        rows = np.arange(b)
        while True:
            waiting = np.where(done[rows], -np.inf, sims[rows])
            pick = waiting.argmax(axis=1)
            live = waiting[np.arange(len(rows)), pick] > -np.inf
            rows, pick = rows[live], pick[live]
            if not len(rows):
                break
            done[rows, pick] = True
            found = links[ids[rows, pick]]
            fresh = ~seen[rows[:, None], found]
            seen[rows[:, None], found] = True
            value = np.einsum("bcd,bd->bc", self.vectors[found], queries[rows]).astype(np.float32)
            value[~fresh] = -np.inf
            better = (value > sims[rows].min(axis=1)[:, None]).any(axis=1)
            if better.any():
                r = rows[better]
                all_sims = np.concatenate((sims[r], value[better]), axis=1)
                keep = np.argpartition(-all_sims, beam - 1, axis=1)[:, :beam]
                ids[r] = np.take_along_axis(np.concatenate((ids[r], found[better]), axis=1), keep, 1)
                sims[r] = np.take_along_axis(all_sims, keep, 1)
                done[r] = np.take_along_axis(np.concatenate((done[r], ~fresh[better]), axis=1), keep, 1) | (sims[r] == -np.inf)
        order = np.argsort(-sims, axis=1, kind="stable")
        ids, sims = np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)
        ids[sims == -np.inf] = -1
        return ids, sims

    def search(self, queries: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        start = np.full((len(queries), 1), self.entry)
        for k in range(len(self.layers) - 1, 0, -1):
            start = self.walk(queries, start, k, 8)[0][:, :4]
        return self.walk(queries, start, 0, beam)


def unit(vectors: np.ndarray) -> np.ndarray:
    return (vectors / np.sqrt((vectors * vectors).sum(axis=1, keepdims=True))).astype(np.float32)


def look_up(graph: Graph, vectors: np.ndarray, threshold: float, same: bool = False) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(index into ``vectors``, node) of links that look-ups in ``graph`` find; float32 decides with
    a margin, so callers verify.  ``same``: the vectors are the graph's own."""
    margin, n = np.float32(threshold - 1e-4), len(graph.vectors)

    def whole(part: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for at in range(0, len(part), STEP):
            i, j = np.nonzero(vectors[part[at : at + STEP]] @ graph.vectors.T >= margin)
            yield part[at : at + STEP][i], j

    todo = np.arange(len(vectors))
    audit = np.unique(np.linspace(0, len(vectors) - 1, min(AUDITED, len(vectors))).astype(int))
    truth = vectors[audit] @ graph.vectors.T
    linked = truth >= margin
    k = min(NEAREST, n)
    nearest = np.argpartition(-truth, k - 1, axis=1)[:, :k]
    for beam in BEAMS:
        beam = min(beam, n)
        ids, sims = np.full((len(vectors), beam), -1, np.int64), np.full((len(vectors), beam), -np.inf, np.float32)
        for at in range(0, len(todo), STEP):
            part = todo[at : at + STEP]
            ids[part], sims[part] = graph.search(vectors[part], beam)
        checked = np.intersect1d(audit, todo, return_indices=True)
        rows = checked[1]
        wide = (sims[:, -1] >= margin) & (beam < n)  # may have more links than the beam holds
        rows = rows[~wide[audit[rows]]]
        if len(rows):
            got = ids[audit[rows]]
            hit_links = sum(int(np.isin(np.flatnonzero(linked[r]), g).sum()) for r, g in zip(rows, got, strict=True))
            hit_near = sum(int(np.isin(nearest[r], g).sum()) for r, g in zip(rows, got, strict=True))
            if hit_links < LINK_RECALL * linked[rows].sum() or hit_near < NEAR_RECALL * k * len(rows):
                continue
        settled = todo[~wide[todo]]
        i, j = np.nonzero(sims[settled] >= margin)
        yield settled[i], ids[settled][i, j]
        todo = todo[wide[todo]]
        if not len(todo):
            return
    yield from whole(todo)


def saved(**arrays: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.savez(out, **arrays)
    return out.getvalue()


def build_shard(frame: pd.DataFrame) -> bytes:
    """Vectors, ids, multiplicities and the graph of a shard."""
    frame = frame.sort_values("id", kind="stable")
    vectors = np.array(frame["vector"].tolist(), np.float64)
    graph = Graph(unit(vectors))
    return saved(ids=frame["id"].to_numpy(np.int64), copies=frame["copies"].to_numpy(np.int64), vectors=vectors, order=graph.order, level=graph.level, **{f"layer{k}": x for k, x in enumerate(graph.layers)})


def load_shard(blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, Graph]:
    held = np.load(io.BytesIO(blob))
    graph = Graph.__new__(Graph)
    graph.vectors, graph.order, graph.level = unit(held["vectors"]), held["order"], held["level"]
    graph.layers = [held[f"layer{k}"] for k in range(sum(name.startswith("layer") for name in held.files))]
    graph.entry = int(graph.order[0])
    return held["ids"], held["copies"], held["vectors"], graph


def meet(one: bytes, other: bytes, same: bool, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Links between two shards: (ids, vectors linked to) and (a, b), a spanning forest."""
    ids_a, copies_a, exact_a, graph_a = load_shard(one)
    ids_b, copies_b, exact_b, graph_b = (ids_a, copies_a, exact_a, graph_a) if same else load_shard(other)
    linked = np.zeros((len(ids_a), len(ids_b)), bool)
    for i, j in look_up(graph_b, graph_a.vectors, threshold, same):
        linked[i, j] = True
    if same:
        linked |= linked.T
        np.fill_diagonal(linked, False)
    else:
        for j, i in look_up(graph_a, graph_b.vectors, threshold):
            linked[i, j] = True
    size_a, size_b = np.sqrt((exact_a * exact_a).sum(axis=1)), np.sqrt((exact_b * exact_b).sum(axis=1))
    found = LocalComponents(len(ids_a) if same else len(ids_a) + len(ids_b))
    count_a, count_b = np.zeros(len(ids_a), np.int64), np.zeros(len(ids_b), np.int64)
    for at in range(0, len(ids_a), 256):
        i, j = np.nonzero(linked[at : at + 256])
        i += at
        for part in range(0, len(i), 1 << 16):
            p, q = i[part : part + (1 << 16)], j[part : part + (1 << 16)]
            cosine = (exact_a[p] * exact_b[q]).sum(axis=1) / (size_a[p] * size_b[q])
            p, q = p[cosine >= threshold], q[cosine >= threshold]
            np.add.at(count_a, p, copies_b[q])
            if not same:
                np.add.at(count_b, q, copies_a[p])
            found.link(p, q if same else q + len(ids_a))
    child, root = found.forest()
    every = ids_a if same else np.concatenate((ids_a, ids_b))
    counts = count_a if same else np.concatenate((count_a, count_b))
    return every, counts, every[child], every[root]


def near_duplicates(df: DataFrame, threshold: float = 0.93, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", shard: int = SHARD) -> DataFrame:
    """(id, n_links, component_id, kept) per row of ``df``."""
    ship(df.sparkSession)
    vector = F.transform(F.col(vector_col), lambda x: x.cast("double"))
    rows = df.select(F.col(id_col).alias("id"), F.col(label_col).cast("string").alias("label"), vector.alias("vector"))
    unfit = F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) | ~F.exists("vector", lambda x: x != 0)
    fit = F.col("label").isNotNull() & F.col("vector").isNotNull() & ~F.coalesce(unfit, F.lit(True))
    # A class is named by what it holds; the lengths in front keep labels and components apart.
    text = F.concat_ws(",", F.length("label").cast("string"), F.size("vector").cast("string"), "label", F.array_join(F.transform("vector", lambda x: (x + 0.0).cast("string")), ","))
    rows = materialize(rows.withColumn("class", F.when(fit, F.sha2(text, 256))), "embeddings")
    classes = rows.filter("class is not null").groupBy("class").agg(F.first("label").alias("label"), F.first("vector").alias("vector"), F.min("id").alias("least"), F.count("*").alias("copies"))
    classes = materialize(classes.withColumn("id", F.monotonically_increasing_id()).withColumn("dim", F.size("vector")), "classes")
    sizes = classes.groupBy("label", "dim").agg(F.count("*").alias("n")).select("label", "dim", F.ceil(F.col("n") / shard).cast("int").alias("shards"))
    dealt = classes.join(sizes, ["label", "dim"]).withColumn("shard", F.pmod(F.xxhash64("id"), F.col("shards")).cast("int"))

    def build(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"label": [key[0]], "dim": [key[1]], "shards": [key[2]], "shard": [key[3]], "blob": [build_shard(frame)]})

    graphs = dealt.groupBy("label", "dim", "shards", "shard").applyInPandas(build, "label string, dim int, shards int, shard int, blob binary")
    graphs = materialize(graphs, "graphs")
    # Who meets whom is settled by names; graphs follow.
    pairs = graphs.select("label", "dim", "shard", F.explode(F.sequence("shard", F.col("shards") - 1)).alias("partner"))
    pairs = pairs.join(graphs.select("label", "dim", "shard", F.col("blob").alias("one")), ["label", "dim", "shard"])
    other = graphs.select("label", "dim", F.col("shard").alias("partner"), F.col("blob").alias("other"))
    met = pairs.join(other, ["label", "dim", "partner"])

    def search(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for row in frame.itertuples():
                ids, counts, a, b = meet(row.one, row.other, row.shard == row.partner, threshold)
                used = counts > 0
                nothing = np.full(int(used.sum()), -1)
                yield pd.DataFrame({"a": np.concatenate((ids[used], a)), "b": np.concatenate((nothing, b)), "n": np.concatenate((counts[used], np.zeros(len(a), np.int64)))})

    found = materialize(met.select("shard", "partner", "one", "other").mapInPandas(search, "a long, b long, n long"), "embedding-links")
    linked = found.filter("b = -1").groupBy(F.col("a").alias("id")).agg(F.sum("n").alias("links"))
    groups = connected_components(found.filter("b >= 0").select("a", "b"))
    named = classes.select("class", "id", "least", "copies").join(linked, "id", "left").join(groups, F.col("id") == groups["node"], "left")
    named = materialize(named.select("class", "least", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "id").alias("component")), "named-classes")
    least = materialize(named.groupBy("component").agg(F.min("least").alias("component_id")), "component-names")
    named = materialize(named.join(least, "component").select("class", "n_links", "component_id"), "linked-classes")
    out = rows.select("id", "class").join(named, "class", "left")
    component = F.coalesce("component_id", "id")
    return out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"))
