import numpy as np
import pytest
from conftest import SMALL, same_rows

from tessera.llm import hnsw, queries

SCHEMA = "vec_id long, embedding array<float>, label int, component_id string, kept string"


def brute(rows, threshold=0.93):
    """(id, n_links, component, kept) per row, by all pairs."""
    fit = [n for n, (i, v, label, *_) in enumerate(rows) if v and label is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    unit = {n: np.array(rows[n][1], np.float64) for n in fit}
    links = {n: [m for m in fit if m != n and rows[m][2] == rows[n][2] and len(unit[m]) == len(unit[n]) and unit[n] @ unit[m] / (np.linalg.norm(unit[n]) * np.linalg.norm(unit[m])) >= threshold] for n in fit}
    out = []
    for n, row in enumerate(rows):
        seen, todo = {n}, [n]
        while todo:
            new = [m for m in links.get(todo.pop(), []) if m not in seen]
            seen |= set(new)
            todo += new
        least = min((rows[m][0] for m in seen if rows[m][0] is not None), default=None)
        out.append((row[0], len(links.get(n, [])), least, row[0] == least if row[0] is not None else least is None))
    return sorted(out, key=str)


def got(df):
    return sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in df.collect()), key=str)


def test_query_equals_its_sql(spark, duck):
    same_rows(queries.op2_embeddings(spark, SMALL), duck, queries.OP2_SQL)


def clustered(n, dim=24, seed=0, spread=0.12):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(max(2, n // 12), dim))
    return (centres[rng.integers(len(centres), size=n)] + spread * rng.normal(size=(n, dim))).astype(np.float32)


def test_graph_finds_neighbours():
    vectors = hnsw.unit(clustered(3000).astype(np.float64))
    graph = hnsw.Graph(vectors)
    ids, _ = graph.search(vectors[:400], 48)
    truth = np.argsort(-(vectors[:400] @ vectors.T), axis=1)[:, :10]
    assert np.mean([np.isin(t, i).mean() for t, i in zip(truth, ids, strict=True)]) >= 0.95


def test_look_ups_find_all_links_of_a_dense_cluster():
    rng = np.random.default_rng(1)
    dense = rng.normal(size=24) + 0.02 * rng.normal(size=(900, 24))
    vectors = hnsw.unit(np.concatenate((dense, clustered(2500).astype(np.float64))))
    graph = hnsw.Graph(vectors)
    linked = np.zeros((len(vectors), len(vectors)), bool)
    for i, j in hnsw.look_up(graph, vectors, 0.93):
        linked[i, j] = True
    truth = vectors @ vectors.T >= 0.93
    assert (linked & truth).sum() >= 0.99 * truth.sum() and linked[:900, :900].sum() == truth[:900, :900].sum()


@pytest.mark.parametrize("shard", [8192, 60])
def test_shards_meet(spark, shard):
    vectors = clustered(400, seed=3)
    rows = [(i, v.tolist(), int(i % 2), "", "") for i, v in enumerate(vectors)]
    assert got(hnsw.near_duplicates(spark.createDataFrame(rows, SCHEMA), shard=shard)) == brute(rows)


def test_labels_do_not_run_into_vectors(spark):
    rows = [(1, [2.0], "x,1.0", "", ""), (2, [1.0, 2.0], "x", "", ""), (3, [0.0, 2.0], "1,x", "", ""), (4, [2.0], "1,x,0.0", "", "")]
    made = hnsw.near_duplicates(spark.createDataFrame(rows, SCHEMA.replace("label int", "label string")))
    assert got(made) == brute(rows)


def test_query_by_walks_of_the_graph(spark, tmp_path, monkeypatch):
    """2,200 vectors a label: look-ups come from beams, and links are compared with all pairs."""
    vectors = clustered(4400, seed=9, spread=0.2)
    rows = [(i, v.tolist(), int(i % 2), "", "") for i, v in enumerate(vectors)]
    spark.createDataFrame(rows, SCHEMA).repartition(4).write.parquet(f"{tmp_path}/embeddings.parquet")
    made = {r.vec_id: r for r in queries.op2_embeddings(spark, str(tmp_path)).collect()}
    wide = vectors.astype(np.float64)
    unit = wide / np.linalg.norm(wide, axis=1, keepdims=True)
    close = (unit @ unit.T >= 0.93) & (np.arange(4400)[:, None] % 2 == np.arange(4400) % 2)
    np.fill_diagonal(close, False)
    links = np.array([made[i].n_links for i in range(4400)])
    assert (links <= close.sum(axis=1)).all() and links.sum() >= 0.99 * close.sum() > 5_000
    half = hnsw.unit(vectors[::2].astype(np.float64))
    monkeypatch.setattr(hnsw, "AUDITED", 0)  # nothing but beams
    walked = sum(len(i) for i, _ in hnsw.look_up(hnsw.Graph(half), half, 0.93))
    assert walked >= 0.99 * (half @ half.T >= 0.93).sum()


@pytest.mark.parametrize("n", [1, 2, 30, 200])
def test_small_shards_walk_too(n, monkeypatch):
    vectors = hnsw.unit(clustered(n, seed=n).astype(np.float64))
    graph, calls = hnsw.Graph(vectors), []
    search = graph.search
    monkeypatch.setattr(graph, "search", lambda q, beam: calls.append(beam) or search(q, beam))
    linked = np.zeros((n, n), bool)
    for i, j in hnsw.look_up(graph, vectors, 0.93):
        linked[i, j] = True
    assert calls and (linked == (vectors @ vectors.T >= np.float32(0.93 - 1e-4))).all()


def test_edges(spark):
    rows = [(9, [1.0, 0.0], 1, "", ""), (4, [1.0, 0.0], 1, "", ""), (4, [1.0, 0.0], 1, "", ""), (5, [2.0, 0.0], 1, "", ""), (6, [1.0, 0.0], 2, "", ""), (7, [1.0, 0.0], None, "", ""), (8, None, 1, "", ""), (10, [0.0, 0.0], 1, "", ""), (11, [float("nan"), 1.0], 1, "", ""), (12, [1.0, None], 1, "", ""), (13, [1.0, 0.0, 0.0], 1, "", ""), (14, [], 1, "", ""), (None, [0.0, 1.0], 1, "", ""), (None, [1.0, 0.01], 1, "", "")]
    assert got(hnsw.near_duplicates(spark.createDataFrame(rows, SCHEMA))) == brute(rows)
    assert hnsw.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0


def test_failed_audits_widen_to_the_whole_shard(monkeypatch):
    vectors = hnsw.unit(clustered(1200, seed=5).astype(np.float64))
    graph = hnsw.Graph(vectors)
    monkeypatch.setattr(hnsw.Graph, "search", lambda self, q, beam: (np.zeros((len(q), beam), np.int64), np.full((len(q), beam), 0.5, np.float32)))
    linked = np.zeros((1200, 1200), bool)
    for i, j in hnsw.look_up(graph, vectors, 0.93):
        linked[i, j] = True
    assert (linked == (vectors @ vectors.T >= np.float32(0.93 - 1e-4))).all()
