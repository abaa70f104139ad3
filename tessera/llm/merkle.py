"""A Merkle manifest of a dataset: a digest for the whole, one for each part, and a proof for each row.

A row's leaf is the SHA-256 of its fields.  The leaves of a part, in order of their ids, are hashed in
runs of eight until one node remains, the part's subroot; the subroots of all parts, in order of their
names, are hashed likewise to the root.  A row's proof is what lies beside its way to the root.

Leaves lie in aligned blocks of 8**4, so that a block is a whole subtree.  Upwards, a task hashes a
block with a treehash stack and hands on one node; blocks of those nodes come next, until each part
has one.  Downwards, every block gets the path above its own root, and a traversal goes through it leaf
by leaf: for each level it holds the run that the leaf's way passes, while a treehash stack works on the
next run of that level.  Each step feeds as many leaves as there are levels, always to the stack whose
lowest node is lowest, so that the stacks together hold a number of nodes logarithmic in the block;
then the path above is appended.  Only digests, ids and paths move between tasks, never the fields.

Nulls in any field are written ``-`` and told from texts by it; rows of a null part are a part of their
own, before all others.  Within a part null ids come first, and rows of equal ids are in order of their
leaves; repeated rows are leaves of their own, which may change places.  Empty texts are fields of zero
bytes.  An empty table has no root and gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.order import numbered
from tessera.llm.shared import materialize, ship

#: Children of a node, and levels of a block.
ARITY, HEIGHT = 8, 4
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
PATH = T.ArrayType(T.StructType().add("before", "string").add("after", "string"))


def field(value: Column) -> Column:
    told = value.cast("string")
    return F.when(told.isNull(), "-").otherwise(F.concat(F.octet_length(told).cast("string"), F.lit(":"), told))


def leaf(*values: Column) -> Column:
    """The digest of a row's fields."""
    return F.sha2(F.concat(*map(field, values)).cast("binary"), 256)


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its path lead to."""
    return F.aggregate(path, leaf, lambda node, step: F.sha2(F.concat(step["before"], node, step["after"]).cast("binary"), 256))


def siblings(path: Column) -> Column:
    """All digests of a path, level by level, left to right."""
    return F.array_join(F.transform(path, lambda step: F.concat(step["before"], step["after"])), "")


def parent(nodes: list[str]) -> str:
    return hashlib.sha256("".join(nodes).encode()).hexdigest()


def levels_of(total: int, height: int = HEIGHT) -> int:
    """Levels above the leaves of a tree, as far as they lie in one block."""
    levels, reached = 0, 1
    while reached < total and levels < height:
        levels, reached = levels + 1, reached * ARITY
    return levels


class Treehash:
    """Hashes the leaves ``at`` to ``end`` up to the nodes of level ``height``; ``held`` has the nodes of each
    level that still wait for their run to fill."""

    def __init__(self, leaves: list[str], at: int, end: int, height: int):
        self.leaves, self.at, self.end, self.height = leaves, at, min(end, len(leaves)), height
        self.held: list[list[str]] = [[] for _ in range(height + 1)]
        self.low = height

    def feed(self) -> None:
        """One leaf, and the parents it completes."""
        held, level = self.held, 0
        held[0].append(self.leaves[self.at])
        self.at += 1
        while level < self.height and len(held[level]) == ARITY:
            held[level + 1].append(parent(held[level]))
            held[level] = []
            level += 1
        if self.at == self.end:
            for level in range(self.height):
                if held[level]:
                    held[level + 1].append(parent(held[level]))
                    held[level] = []
        self.low = next((i for i, nodes in enumerate(held) if nodes), self.height)

    def run(self) -> list[str]:
        while self.at < self.end:
            self.feed()
        return self.held[self.height]


def block_root(leaves: list[str], levels: int) -> str:
    return Treehash(leaves, 0, len(leaves), levels).run()[0]


class Traversal:
    """The paths of a block's leaves in order.  ``runs`` holds, for each level, the run on the way of the
    current leaf; ``ahead`` the stacks that hash the next run of each level."""

    def __init__(self, leaves: list[str], levels: int):
        self.leaves, self.levels = leaves, levels
        self.widths = [ARITY ** (h + 1) for h in range(levels)]
        self.runs = [Treehash(leaves, 0, w, h).run() for h, w in enumerate(self.widths)]
        self.ahead = [Treehash(leaves, w, 2 * w, h) for h, w in enumerate(self.widths)]
        self.most_held = self.late = 0

    def __iter__(self) -> Iterator[list[tuple[str, str]]]:
        """The path of each leaf: per level, what lies before and after it in its run."""
        levels, runs = self.levels, self.runs
        steps: list[tuple[str, str]] = [("", "")] * levels
        for i in range(len(self.leaves)):
            for h in range(levels):
                below = self.widths[h] // ARITY
                if i % below:
                    break  # no node above changes before this one does
                nth = i // below % ARITY
                if not nth and i:
                    self.late += self.ahead[h].end - self.ahead[h].at if self.ahead[h].at < self.ahead[h].end else 0
                    runs[h] = self.ahead[h].run()
                    self.ahead[h] = Treehash(self.leaves, i + self.widths[h], i + 2 * self.widths[h], h)
                steps[h] = "".join(runs[h][:nth]), "".join(runs[h][nth + 1 :])
            yield steps
            for _ in range(levels):
                stack = min((s for s in self.ahead if s.at < s.end), key=lambda s: s.low, default=None)
                if stack is None:
                    break
                stack.feed()

    def held(self) -> int:
        """Nodes in memory besides the leaves."""
        return sum(len(nodes) for stack in self.ahead for nodes in stack.held) + sum(map(len, self.runs))


def _sorted(table: pa.Table, height: int) -> tuple[pa.Table, list[str], int]:
    """A block's rows in order, their nodes as hexadecimal text, and its levels."""
    table = table.sort_by("place")
    nodes = [x.hex() for x in table.column("node").to_pylist()]
    return table, nodes, levels_of(table.column("total")[0].as_py(), height)


def _roots(nodes: DataFrame, height: int) -> DataFrame:
    """(tree, place, total, node) of one tier to the tier of its blocks."""

    def run(table: pa.Table) -> pa.Table:
        table, leaves, levels = _sorted(table, height)
        root = bytes.fromhex(block_root(leaves, levels))
        total = -(-table.column("total")[0].as_py() // ARITY**height)
        return pa.table([table.column("tree")[:1], table.column("block")[:1], pa.array([total]), pa.array([root])], names=["tree", "place", "total", "node"])

    return nodes.withColumn("block", _block(height)).groupBy("tree", "block").applyInArrow(run, f"tree {nodes.schema['tree'].dataType.simpleString()}, place long, total long, node binary")


def _block(height: int) -> Column:
    return F.shiftright("place", (ARITY**height).bit_length() - 1)


def _paths(nodes: DataFrame, above: DataFrame, height: int) -> DataFrame:
    """``nodes`` (tree, place, total, node, ...) with the ``path`` of each; ``above``: (tree, block, path, ...)
    of the blocks' roots, whose further columns go to all nodes of the block."""
    told = [c for c in above.columns if c not in ("tree", "block", "path")]
    own = [c for c in nodes.columns if c != "total"]
    schema = T.StructType([*(nodes.schema[c] for c in own), *(above.schema[c] for c in told)]).add("path", PATH)

    def run(table: pa.Table, upper: pa.Table) -> pa.Table:
        table, leaves, levels = _sorted(table, height)
        rest = upper.column("path")[0].as_py()
        rest = [(step["before"], step["after"]) for step in rest]
        before, after = [], []
        for steps in Traversal(leaves, levels):
            for one, other in (*steps, *rest):
                before.append(one)
                after.append(other)
        n, width = len(leaves), levels + len(rest)
        steps = pa.StructArray.from_arrays([pa.array(before, pa.string()), pa.array(after, pa.string())], names=["before", "after"])
        path = pa.ListArray.from_arrays(pa.array(range(0, n * width + 1, width) if width else [0] * (n + 1), pa.int32()), steps)
        columns = [*(table.column(c) for c in own), *(pa.chunked_array([pa.array([upper.column(c)[0].as_py()] * n, upper.schema.field(c).type)]) for c in told), path]
        return pa.table(columns, names=schema.names)

    blocked = nodes.withColumn("block", _block(height))
    return blocked.groupBy("tree", "block").cogroup(above.groupBy("tree", "block")).applyInArrow(run, schema)


def _tiers(nodes: DataFrame, height: int) -> tuple[list[DataFrame], DataFrame]:
    """All tiers from ``nodes`` up, each written, and (tree, node): the roots of all trees."""
    tiers, roots = [nodes], None
    while True:
        done = tiers[-1].filter("total = 1").select("tree", "node")
        roots = done if roots is None else roots.unionAll(done)
        rest = tiers[-1].filter("total > 1")
        if not rest.limit(1).count():
            return tiers, roots
        tiers.append(materialize(_roots(rest.select("tree", "place", "total", "node"), height), "merkle-tier"))


def _descend(tiers: list[DataFrame], tops: DataFrame, height: int) -> DataFrame:
    """The rows of the lowest tier with their paths.  ``tops``: (tree, path, ...) of all trees' roots."""
    found = None
    for nth, nodes in reversed([*enumerate(tiers)]):
        # A tree's root stands in the first tier where it is alone; what lies below it hangs on blocks.
        above = tops.join(nodes.filter("total = 1").select("tree"), "tree").withColumn("block", F.lit(0).cast("long"))
        if found is not None:
            above = above.unionByName(found.withColumnRenamed("place", "block"))
        found = _paths(nodes, materialize(above, "paths-above"), height)
        if nth:
            found = materialize(found.drop("node"), "merkle-paths")
    return found


def manifest(df: DataFrame, fields: tuple[str, ...] = FIELDS, id_col: str = "doc_id", part_col: str = "lang", carry: dict[str, Column] | None = None, height: int = HEIGHT) -> DataFrame:
    """(id, leaf, subroot, root, path) of all rows; ``path``: array of (before, after), the digests beside the
    row's way at each level.  ``carry`` names further expressions over ``df`` to hand along; blocks have ``height`` levels."""
    spark, carry = df.sparkSession, carry or {}
    ship(spark)
    name = F.when(F.col(part_col).isNull(), "").otherwise(F.concat(F.lit("+"), F.col(part_col).cast("string")))
    more = [value.alias(f"carried_{i}") for i, value in enumerate(carry.values())]
    rows = materialize(df.select(F.col(id_col).alias("id"), name.alias("tree"), F.unhex(leaf(*(F.col(c) for c in fields))).alias("node"), *more), "leaves")
    nodes = materialize(numbered(rows, "tree", ["id", "node"]), "numbered-leaves")
    tiers, subroots = _tiers(nodes, height)
    parts = materialize(subroots.select(F.col("tree").alias("part"), "node", F.lit("").alias("tree")), "subroots")
    parts = materialize(numbered(parts, "tree", ["part"]), "numbered-subroots")
    upper, root = _tiers(parts, height)
    top = root.select("tree", F.lower(F.hex("node")).alias("root"), F.array().cast(PATH).alias("path"))
    tops = materialize(_descend(upper, top, height).select(F.col("part").alias("tree"), F.lower(F.hex("node")).alias("subroot"), "root", "path"), "part-paths")
    found = _descend(tiers, tops, height)
    return found.select(F.col("id").alias(id_col), F.lower(F.hex("node")).alias("leaf"), "subroot", "root", "path", *(F.col(f"carried_{i}").alias(c) for i, c in enumerate(carry)))
