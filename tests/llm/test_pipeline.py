import subprocess
import sys
from pathlib import Path

import corpus_pipeline
import numpy as np
import public_tokenizers
import pytest
from conftest import ROOT, SMALL
from pyspark.sql import functions as F

from tessera.llm import langid, packing, secrets, similar

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def shingles(text, words=5):
    w = (text or "").encode().lower().split()
    return {b" ".join(w[i : i + words]) for i in range(max(1, len(w) - words + 1))} if w else set()


def groups(docs):
    """Smallest id reachable by texts of similarity 0.8 or more; docs: list of (id, text)."""
    root, sets = {i: i for i, _ in docs}, {i: shingles(t) for i, t in docs}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for n, (i, _) in enumerate(docs):
        for j, _ in docs[:n]:
            a, b = sets[i], sets[j]
            if a == b or (a | b and len(a & b) / len(a | b) >= 0.8):
                p, q = sorted((find(i), find(j)))
                root[q] = p
    return {i: find(i) for i in root}


def copies(n_groups=12, seed=0):
    """Documents with exact and near copies; every group's members are similar to its first."""
    rng = np.random.default_rng(seed)
    docs = []
    for g in range(n_groups):
        words = [f"w{rng.integers(3000)}" for _ in range(300)]
        for c in range(int(rng.integers(1, 6))):
            own = list(words)
            for at in rng.choice(300, int(rng.integers(0, 4)), replace=False):
                own[at] = f"n{g}x{c}y{at}"
            docs.append((len(docs), " ".join(own)))
    return docs


def test_similar_documents_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(similar, "BLOCK", 16)
    docs = copies()
    out = similar.similar_documents(spark.createDataFrame([(i, t, "", "", 0) for i, t in docs], SCHEMA)).collect()
    assert {r.doc_id: r.component_id for r in out} == groups(docs)
    assert {r.doc_id for r in out if r.kept} == set(groups(docs).values())


def test_similar_documents_of_the_tables(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    want = groups([(r.doc_id, r.text) for r in docs.collect()])
    assert {r.doc_id: r.component_id for r in similar.similar_documents(docs).collect()} == want


def test_bands_find_pairs_at_the_similarity_asked_for():
    rng = np.random.default_rng(3)
    count = similar.band_count(0.8)
    assert (1 - 0.8**similar.ROWS) ** count <= similar.MISS
    shares = []
    for n, shared in [(5, 4), (10, 9), (90, 80), (450, 400), (4500, 4000)] * 60:
        hashes = rng.integers(0, 2**64, 2 * n - shared, dtype=np.uint64)  # as similar as 0.8, or a little more for few
        one, other = similar.bands(hashes[:n] if n > 5 else hashes[:4], count), similar.bands(hashes[n - shared :] if n > 5 else hashes[:5], count)
        shares.append((one == other).mean())
    assert min(shares) > 0 and abs(np.mean(shares) - 0.8**similar.ROWS) < 0.03
    assert len(similar.bands(np.empty(0, np.uint64), count)) == 0


def test_equal_sketches_do_not_make_a_class(spark, monkeypatch):
    monkeypatch.setattr(similar, "sketch", lambda hashes: bytes(32))
    docs = [(0, "a b c d e f g"), (1, "h i j k l m n"), (2, "a b c d e f g")]
    out = similar.similar_documents(spark.createDataFrame([(i, t, "", "", 0) for i, t in docs], SCHEMA)).collect()
    assert {r.doc_id: r.component_id for r in out} == {0: 0, 1: 1, 2: 0}


def templated(n_texts=400, seed=5):
    """Copies of one passage: most pairs are of similarity 0.7 to 0.79, few of 0.8 or more."""
    rng = np.random.default_rng(seed)
    base = [f"w{i}" for i in range(300)]
    docs = []
    for c in range(n_texts):
        own = list(base)
        for at in rng.choice(60, 5, replace=False) * 5:
            own[at] = f"n{c}y{at}"
        docs.append(own)
    docs.append([f"z{i}" if i in (0, 5, 10, 15, 20, 25) else w for i, w in enumerate(docs[-1])])
    return [(i, " ".join(w)) for i, w in enumerate(docs)]


@pytest.mark.parametrize(("chunk", "block"), [(similar.CHUNK_SHINGLES, similar.BLOCK), (20_000, 50)])
def test_links_of_large_groups_are_all_verified(spark, monkeypatch, chunk, block):
    docs = templated()
    want = groups(docs)
    assert 1 < len(set(want.values())) < len(docs)
    monkeypatch.setattr(similar, "CHUNK_SHINGLES", chunk)
    monkeypatch.setattr(similar, "BLOCK", block)
    out = similar.similar_documents(spark.createDataFrame([(i, t, "", "", 0) for i, t in docs], SCHEMA)).collect()
    assert {r.doc_id: r.component_id for r in out} == want


def test_short_near_copies_are_found(spark):
    """Of four shingles, and of five: at similarity 0.8 up to 70 of 256 bits differ."""
    rng = np.random.default_rng(8)
    docs = []
    for _ in range(400):
        words = [f"w{rng.integers(10**6)}" for _ in range(9)]
        docs += [" ".join(words), " ".join(words[:8])]
    docs = list(enumerate(docs))
    out = similar.similar_documents(spark.createDataFrame([(i, t, "", "", 0) for i, t in docs], SCHEMA)).collect()
    assert {r.doc_id: r.component_id for r in out} == groups(docs)


def test_radius_holds_the_tail_of_measured_sketches():
    radius = similar.radii(0.8)
    assert radius[0, 4, 4] == radius[0, 3, 4] == -1 and radius[0, 4, 5] > radius[0, 60, 60] > 58
    rng = np.random.default_rng(1)
    for a, b, shared in [(4, 5, 4), (12, 15, 12), (40, 40, 36), (500, 500, 445), (400, 500, 400)]:
        far = []
        for _ in range(300):
            hashes = rng.integers(0, 2**64, a + b - shared, dtype=np.uint64)
            one, other = similar.matrix([similar.sketch(hashes[:a]), similar.sketch(hashes[a - shared :])])
            far.append(int(np.bitwise_count(one ^ other).sum()))
        assert max(far) <= radius[0, min(a, similar.FEW + 1), min(b, similar.FEW + 1)]
        if max(a, b) <= similar.FEW:
            assert abs(np.mean(far) / 256 - similar.differing(shared, a - shared, b - shared)) < 0.01


def test_deduplicated_edges(spark):
    rows = [(5, "one two three four five six", "en", "a", 1), (5, "one two three four five six", "en", "a", 1), (3, "One two three four five six", "en", "b", 1), (None, "alone here with some other words", None, None, None), (None, "alone here with some other words", None, None, None), (7, None, None, None, None), (8, "", "en", "c", 0), (9, "x", "en", "c", 1)]
    df = spark.createDataFrame(rows, SCHEMA)
    out = similar.deduplicated(df)
    assert out.columns == df.columns
    assert sorted((str(r.doc_id), r.text or "") for r in out.collect()) == sorted([("3", "One two three four five six"), ("None", "alone here with some other words"), ("7", ""), ("9", "x")])
    assert similar.deduplicated(df.limit(0)).count() == 0


def test_deduplication_with_clashing_names(spark):
    """Columns of any name stay as they are."""
    text = " ".join(f"word{i}" for i in range(60))
    rows = [(1, text, 7, 8, "a"), (2, text, 9, 8, "b"), (3, "other words altogether here", 1, 2, "c"), (3, "other words altogether here", 1, 2, "c")]
    df = spark.createDataFrame(rows, "doc_id long, text string, near_id long, near_version long, __id string").withColumn("__at", F.lit(1))
    out = similar.deduplicated(df)
    assert out.columns == df.columns and sorted((r.doc_id, r.near_id, r["__id"]) for r in out.collect()) == [(1, 7, "a"), (3, 1, "c")]


def test_stages(spark):
    docs = copies(6, 3)
    key = "password=abcdefghijkl0123"
    rows = [(i, t, "en", "s", len(t)) for i, t in docs] + [(100, "12 34 !", "en", "s", 7), (101, None, "en", "s", 0), (103, "Распознавание неизвестного предложения продолжается следующими длинными словами", None, "s", 79), (102, f"here is a {key} in a text", "en", "s", 9)]
    frame = spark.createDataFrame(rows, SCHEMA)
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["language", "near_duplicates", "secrets", "packing"]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        frame = corpus_pipeline.materialize(stage(spark, frame, SMALL), f"test-{name}")
        assert frame.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        left = {r.doc_id: r for r in frame.collect()}
        if name == "language":
            assert set(left) == {i for i, _ in docs} | {102}
        if name == "near_duplicates":
            assert set(left) == set(groups(docs).values()) | {102}
    assert left[102].text == "here is a [SECRET] in a text" and left[102].n_chars == len(left[102].text)
    assert all(r.text == dict(docs)[i] for i, r in left.items() if i != 102)
    own = packing.encoder(public_tokenizers.path(corpus_pipeline.TOKENIZER))
    out = corpus_pipeline.pack(spark, frame, SMALL).collect()
    total = {i: sum(r.length for r in out if r.doc_id == i) for i in left}
    assert total == {i: len(own.encode(r.text)) + 1 for i, r in left.items()}


def test_documents_stay_if_no_language_can_be_learned(spark):
    frame = spark.createDataFrame([(1, "a clean text", None, "s", 12), (2, "another one", None, "s", 11)], SCHEMA)
    assert {r.doc_id for r in corpus_pipeline.language(spark, frame, SMALL).collect()} == {1, 2}


def test_run_over_the_tables(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    out = corpus_pipeline.run(spark, SMALL)
    letters = {i for i, t in docs if t and any(c.isalpha() for c in t)}
    best = groups([(i, t) for i, t in docs if i in letters])
    assert {r.doc_id for r in out.collect()} == set(best.values())


def test_empty_table(spark):
    frame = spark.createDataFrame([], SCHEMA)
    for _, stage in corpus_pipeline.STAGES:
        frame = stage(spark, frame, SMALL)
    assert frame.count() == 0


@pytest.mark.parametrize("module", ["operators", "sources", "functions", "plans", "streaming", "service", "schema"])
def test_nothing_else_imports_this_package(module):
    files = [Path(ROOT, "tessera", f"{module}.py")] if Path(ROOT, "tessera", f"{module}.py").exists() else Path(ROOT, "tessera", module).rglob("*.py")
    assert not any("tessera.llm" in f.read_text() for f in files)


def test_the_rest_works_without_this_package(tmp_path):
    import shutil

    shutil.copytree(ROOT, tmp_path / "repo", ignore=shutil.ignore_patterns(".git", "__pycache__"))
    shutil.rmtree(tmp_path / "repo/tessera/llm")
    code = "import __spark_entry__ as e; q = e.queries(); assert q and set(e.oracle_sql()) <= set(q) and not any(n.startswith('op') or n == 'pipeline' for n in q)"
    (tmp_path / "repo/corpus_pipeline.py").unlink()
    env = {"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path / "repo")}
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "repo", env=env, check=True, timeout=120)


def test_secret_and_language_modules_agree_on_empty_texts():
    assert langid.Identifier(langid.Model([], np.zeros((0, langid.BUCKETS), np.float32))).predict("") == ("und", 0.0, {})
    assert secrets.scan_text("") == []
