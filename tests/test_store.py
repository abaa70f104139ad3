"""The index store: versions that change with what changed, compaction, conflicts, clean-up."""

import os

import pytest
from pyspark.sql import functions as F

from tessera.operators import index as I
from tessera.operators import postings as P
from tessera.operators import retrieve as R
from tessera.operators import vectors as W

CHUNK = "chunk_key long, target_file string, seq int, project string, build string, index_text string, embedding array<float>"


def chunk(i, text, seq=0):
    return (i * 10 + seq, f"d{i:04d}", seq, f"p{i % 3}", "b", text, [float(i % 7) - 3, float(seq) + 1, float(len(text) % 11)])


def tables(spark, rows):
    chunks = spark.createDataFrame(rows, CHUNK)
    return chunks, chunks.select("target_file").distinct().withColumn("readable", F.lit(True))


def state(store):
    """All that searches see, as of one fresh index of the live chunks."""
    index = store.lexical()
    sets = lambda df, *names: sorted(tuple(r[n] for n in names) for r in df.collect())
    stats = index.stats.first()
    return {
        "postings": sets(P.unpacked(index.packs), "token", "chunk_key", "pos", "length", "tf"), "tokens": [(t, n, round(w, 9)) for t, n, w in sets(index.weights(), "token", "df", "idf")],
        "stats": (stats.n, stats.total, round(stats.mean, 9)), "leads": sets(index.leads, "project", "build", "chunk_key", "pos"), "chunks": sets(store.load("chunks"), "chunk_key", "index_text"),
    }


def fresh(spark, tmp_path, rows, name):
    store = I.Store(spark, str(tmp_path / name))
    store.save(*tables(spark, rows))
    return state(store)


def vectors_found(spark, store):
    asked = spark.createDataFrame([(1, [0.6, 0.8, 0.0], [f"p{i}\x1fb" for i in range(3)])], "qid long, unit array<double>, scopes array<string>")
    return [(r.key, r.score) for r in W.dense_search(asked, store.load("vectors"), 7).orderBy("rank").collect()]


def changed(old, rows, gone):
    """Chunks after ``rows`` replace those of their documents and ``gone`` documents go."""
    named = {r[1] for r in rows} | {f"d{i:04d}" for i in gone}
    return [r for r in old if r[1] not in named] + rows


def step(spark, store, rows, gone):
    named = [r[1] for r in rows] + [f"d{i:04d}" for i in gone]
    return store.save(*tables(spark, rows) if rows else tables(spark, [chunk(0, "x")])[0:0] or empty(spark), store.load("manifest").filter(~F.col("target_file").isin(named)))


def empty(spark):
    return spark.createDataFrame([], CHUNK), spark.createDataFrame([], "target_file string, readable boolean")


def test_versions_equal_a_fresh_index(spark, tmp_path, monkeypatch):
    """Changes, removals and additions over many versions, with dead first chunks, then compaction."""
    monkeypatch.setattr(I, "LEADS", 4)
    monkeypatch.setattr(I, "CHANGES", 3)
    rows = [chunk(i, f"the word{i % 9} w{i} {'more ' * (i % 4)}", s) for i in range(60) for s in range(1 + i % 2)]
    store = I.Store(spark, str(tmp_path / "index"))
    store.save(*tables(spark, rows))
    first = state(store)
    for new, gone in (([chunk(3, "now the other text"), chunk(70, "added word1")], [0, 6, 9]), ([], [1, 2]), ([chunk(i, f"again w{i}") for i in range(12, 20)], []), ([chunk(0, "the back")], [70])):
        assert step(spark, store, new, gone) == store.versions()[-1]
        rows = changed(rows, new, gone)
    want = fresh(spark, tmp_path, rows, "fresh")
    assert state(store) == want
    alone = I.Store(spark, str(tmp_path / "fresh"))
    assert vectors_found(spark, store) == vectors_found(spark, alone)
    # Compaction changes nothing that a search sees, and readers of the version before go on.
    reader, before = store.lexical(), len(store.versions())
    assert store.compact() and state(store) == want and vectors_found(spark, store) == vectors_found(spark, alone)
    assert len(store.versions()) == before + 1 and reader.stats.first().n == want["stats"][0] and P.unpacked(reader.packs).count() == len(want["postings"])
    segments = {r.segment for r in store.load("manifest").select("segment").distinct().collect()}
    assert len(segments) < 5
    gone = store.vacuum(1)
    assert any(g.startswith("packs/segment=") for g in gone) and state(store) == want and store.versions() == [before + 1]
    assert first != want


def test_searches_see_live_chunks_alone(spark, tmp_path):
    store = I.Store(spark, str(tmp_path / "index"))
    store.save(*tables(spark, [chunk(i, f"alpha w{i}") for i in range(0, 30, 3)]))
    step(spark, store, [chunk(3, "beta only")], [6])
    asked = spark.createDataFrame([(1, "alpha")], "qid long, query string")
    pool = spark.createDataFrame([(1, 0, "p0", "b")], "qid long, tier int, project string, build string")
    found = R.sparse_recall(asked, pool, store.lexical(), 20)
    assert sorted(r.chunk_key for r in found.filter("score <> 0").collect()) == [0, *range(90, 300, 30)]
    assert [r.chunk_key for r in found.filter("score = 0").collect()] == [30]
    order = [r.chunk_key for r in R.sparse_recall(asked, pool, store.lexical(), 4).orderBy("rank").collect()]
    assert order == [0, 90, 120, 150]  # equal scores in the order of the corpus


def test_a_small_change_reads_little(spark, tmp_path, monkeypatch):
    """Of earlier segments, a save reads the chunks of documents that go, and nothing of the others."""
    store = I.Store(spark, str(tmp_path / "index"))
    store.save(*tables(spark, [chunk(i, f"w{i} " * 50) for i in range(300)]))
    step(spark, store, [chunk(400, "second segment")], [])
    read = []
    keep = I.Store._segments
    monkeypatch.setattr(I.Store, "_segments", lambda self, name, segments: read.append((name, tuple(segments))) or keep(self, name, segments))
    step(spark, store, [chunk(400, "third text")], [])
    assert {x for x in read if x[0] == "chunks"} == {("chunks", (2,)), ("chunks", (3,))} or ("chunks", (1,)) not in read
    assert all(1 not in segments for name, segments in read if name != "chunks")
    rows = store._rows("chunks", spark.createDataFrame([(I._named(store.load("manifest")).filter("segment = 1").first().document, 1)], "document long, segment int"))
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "segment=1" in plan or "PushedFilters" in plan and "In(document" in plan.replace("EqualTo(document", "In(document")


def test_saves_at_once(spark, tmp_path):
    store = I.Store(spark, str(tmp_path / "index"))
    store.save(*tables(spark, [chunk(1, "one")]))
    other = I.Store(spark, str(tmp_path / "index"))
    claimed = other._claim(1)
    assert claimed == 2 and store._claim(1) == 3  # never the same number
    assert step(spark, store, [chunk(2, "two")], []) == 4
    with pytest.raises(I.Conflict):
        other._finish(store.load("manifest"), claimed, 1)
    assert store.versions() == [1, 4] and not os.path.exists(tmp_path / "index/manifest/v2")
    assert step(spark, store, [chunk(3, "three")], []) == 5 and state(store)["stats"][0] == 3
