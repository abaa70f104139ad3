import hashlib
import zlib
from functools import partial

import pytest
from conftest import SMALL, same_rows
from pyspark.sql import functions as F

from tessera.llm import merkle, queries

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, tree string, node string, path string"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def up(nodes):
    """All levels of a tree, by the definition."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([h(*levels[-1][i : i + 8]) for i in range(0, len(levels[-1]), 8)])
    return levels


def way(levels, at):
    path = []
    for nodes in levels[:-1]:
        run, nth = nodes[at // 8 * 8 : at // 8 * 8 + 8], at % 8
        path.append(("".join(run[:nth]), "".join(run[nth + 1 :])))
        at //= 8
    return path


def fold(node, path):
    for before, after in path:
        node = h(before, node, after)
    return node


def field(x):
    return "-" if x is None else f"{len(str(x).encode())}:{x}"


def brute(rows):
    """Rows (doc_id, source, lang, n_chars, text) to the query's rows."""
    lower = str.maketrans(queries.UPPER, queries.UPPER.lower())
    parts = {}
    for row in rows:
        parts.setdefault(row[2], []).append((row, h(*map(field, row))))
    names = sorted(parts, key=lambda p: (p is not None, (p or "").encode()))
    trees = {}
    for name in names:
        parts[name].sort(key=lambda x: (x[0][0] is not None, x[0][0] or 0, x[1]))
        trees[name] = up([leaf for _, leaf in parts[name]])
    above = up([trees[name][-1][0] for name in names])
    out = []
    for nth, name in enumerate(names):
        for at, (row, leaf) in enumerate(parts[name]):
            path = way(trees[name], at) + way(above, nth)
            start = leaf
            if row[0] is not None and zlib.crc32(str(row[0]).encode()) % 3 == 0:
                start = h(*map(field, (*row[:4], None if row[4] is None else row[4].translate(lower))))
            root = fold(start, path)
            out.append((row[0], leaf, trees[name][-1][0], above[-1][0], h(*(a + b for a, b in path)), root, root == above[-1][0]))
    return sorted(map(repr, out))


def asked(df):
    names = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    return sorted(repr(tuple(r[n] for n in names)) for r in df.select(names).collect())


@pytest.mark.parametrize(("n", "levels"), [(1, 0), (2, 1), (8, 1), (9, 2), (64, 2), (65, 3), (1, 4), (700, 4), (4095, 4), (4096, 4)])
def test_traversal(n, levels):
    leaves = [h(str(i)) for i in range(n)]
    tree = [leaves]
    for _ in range(levels):
        tree.append([h(*tree[-1][i : i + 8]) for i in range(0, len(tree[-1]), 8)])
    assert merkle.block_root(leaves, levels) == tree[-1][0]
    walk, most = merkle.Traversal(leaves, levels), 0
    for i, steps in enumerate(walk):
        assert steps == way(tree, i)
        most = max(most, walk.held())
    # A run and a stack a level, each of at most seven waiting nodes a level below it.
    assert i == n - 1 and most <= 8 * levels * (levels + 5) // 2
    assert walk.late <= n // 20  # hardly a stack is behind when its run is due


def test_query_equals_its_sql(spark, duck):
    same_rows(queries.op11_merkle(spark, SMALL), duck, queries.OP11_SQL)


def test_small_blocks_equal_the_definition(spark, monkeypatch, tmp_path):
    """Several tiers below and above, null and repeated ids, nulls everywhere, repeated rows."""
    monkeypatch.setattr(merkle, "manifest", partial(merkle.manifest, height=1))
    rows = [(i, f"Text {i % 50} Ä", ["de", "en", None, ""][i % 4], "S" if i % 3 else None, i) for i in range(600)]
    rows += [(1000 + i, "", f"lang{i}", None, None) for i in range(70)] + [(5, None, "de", "", 0), (None, "x", None, "", 1), (None, None, None, None, None), (5, "Text 5 Ä", "en", "S", 5)] * 2
    df = spark.createDataFrame([(*r, "", "", "") for r in rows], SCHEMA)
    df.write.parquet(f"{tmp_path}/documents.parquet")
    want = brute([(i, source, lang, n, text) for i, text, lang, source, n in rows])
    assert asked(queries.op11_merkle(spark, str(tmp_path))) == want


def test_proofs_verify_and_tell_changes(spark):
    rows = [(i, "Ab" * (i % 5), "en", "", i, "", "", "") for i in range(100)]
    out = merkle.manifest(spark.createDataFrame(rows, SCHEMA), carry={"text": F.col("text")})
    whole = out.select(merkle.folded(F.col("leaf"), F.col("path")).alias("a"), merkle.folded(F.sha2(F.col("text").cast("binary"), 256), F.col("path")).alias("b"), "root")
    assert whole.filter("a = root and b <> root").count() == 100


def test_edges(spark):
    assert merkle.manifest(spark.createDataFrame([], SCHEMA)).count() == 0
    one = merkle.manifest(spark.createDataFrame([(1, "x" * 3_000_000, None, None, None, "", "", "")], SCHEMA)).collect()
    assert len(one) == 1 and one[0].leaf == one[0].subroot == one[0].root and one[0].path == []
