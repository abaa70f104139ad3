"""Minimax contiguous sharding.

Rows with equal texts form an atomic group.  Groups are ordered by the SHA-256 of their text, so
the order says nothing about source or length.  The smallest capacity for which a greedy pass
over that order needs no more than ``n_shards`` shards is found by binary search, and the order
is cut where that pass cuts.

Prefix sums come in two levels: within each of 4096 ranges of the hash by a window, and over the
ranges by one small window.  A greedy pass needs the answer to "the last group that ends at or
before x" once a shard; the driver asks the sorted table of group ends for the few thousand ends
around x, keeps them, and answers nearby questions from them, so a search takes some dozens of
narrow look-ups whatever the size of the table.  Ranks inside a group go over 64 cells of ids, so
that no group, however large, is sorted in one task.  DataFrame functions only.

Sizes are the UTF-8 bytes of the text plus one.  Null and empty texts form one group.  Repeated
rows are rows of their own.  An empty table gives an empty result.
"""

from __future__ import annotations

from bisect import bisect_right

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.shared import materialize, parallelism

#: Hash ranges have at least so many hexadecimal digits, and as many as give about ``RANGE_ROWS`` rows each.
RANGE_DIGITS, RANGE_ROWS = 3, 1_000_000
#: A group is ranked in at least so many parts, and in as many as give a part of a group of all rows about
#: ``CELL_ROWS`` rows.
CELLS, CELL_ROWS = 64, 2_000_000
#: Group ends fetched on either side of a position.
NEARBY = 4096


class Ends:
    """Answers ``last(x)``, the largest group end at or before x, from stretches of the table."""

    def __init__(self, table: DataFrame):
        self.table = table
        self.stretches: list[tuple[float, float, list[int]]] = []

    def last(self, x: int) -> int | None:
        for low, high, ends in self.stretches:
            if low <= x <= high:
                at = bisect_right(ends, x)
                if at or low == float("-inf"):
                    return ends[at - 1] if at else None
        below = self.table.filter(F.col("end") <= x).orderBy(F.desc("end")).limit(NEARBY)
        above = self.table.filter(F.col("end") > x).orderBy("end").limit(NEARBY)
        ends = sorted(row[0] for row in below.unionAll(above).collect())
        at = bisect_right(ends, x)
        low = ends[0] if at >= NEARBY else float("-inf")
        high = ends[-1] if len(ends) - at >= NEARBY else float("inf")
        self.stretches.append((low, high, ends))
        return ends[at - 1] if at else None


def greedy(ends: Ends, capacity: int, total: int, n_shards: int) -> list[int] | None:
    """Where a greedy pass cuts (ends of all shards but the last), or None if it needs more."""
    cuts, base = [], 0
    for _ in range(n_shards):
        if base + capacity >= total:
            return cuts
        reached = ends.last(base + capacity)
        if reached is None or reached <= base:
            return None
        base = reached
        cuts.append(base)
    return None


def minimax_cuts(ends: Ends, largest: int, total: int, n_shards: int) -> tuple[int, list[int]]:
    """The smallest feasible capacity and its cuts.  Capacities are tried upwards from the least
    that could do (in doubling steps), then between the last that failed and the first that held."""
    low = max(largest, -(-total // n_shards))
    if (cuts := greedy(ends, low, total, n_shards)) is not None:
        return low, cuts
    failed, step = low, 1
    while (cuts := greedy(ends, failed + step, total, n_shards)) is None:
        failed, step = failed + step, step * 2
    held = failed + step
    while held - failed > 1:
        middle = (held + failed) // 2
        if (found := greedy(ends, middle, total, n_shards)) is None:
            failed = middle
        else:
            held, cuts = middle, found
    return held, cuts


def range_digits(count: int) -> int:
    digits = RANGE_DIGITS
    while 16**digits * RANGE_ROWS < count:
        digits += 1
    return digits


def shard_documents(df: DataFrame, n_shards: int = 16, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of ``df``: the id, ``size``, ``text_crc32``, ``shard`` (0 to ``n_shards`` - 1), ``slot``
    (0 upwards without gaps within a shard), ``group_key`` and ``capacity``."""
    spark = df.sparkSession
    text = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    count = df.count()
    digits, n_cells = range_digits(count), max(CELLS, -(-count // CELL_ROWS))
    rows = materialize(df.select(
        F.col(id_col).alias("id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("crc"),
        F.sha2(text, 256).alias("key"), F.pmod(F.xxhash64(id_col), F.lit(n_cells)).cast("int").alias("cell"),
    ).withColumn("part", F.substring("key", 1, digits)), "shard-rows")
    cells = materialize(rows.groupBy("part", "key", "cell").agg(F.count("*").alias("n"), F.sum("size").alias("bytes")), "shard-cells")

    parts = cells.groupBy("part").agg(F.sum("n").alias("n"), F.sum("bytes").alias("bytes"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row a range
    parts = parts.select("part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("n0"), F.coalesce(F.sum("bytes").over(earlier), F.lit(0)).alias("b0"))
    by_cell = Window.partitionBy("part").orderBy("key", "cell")
    by_key = Window.partitionBy("part").orderBy("key").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    placed = cells.withColumns({
        "before": F.coalesce(F.sum("n").over(by_cell.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
        "upto": F.sum("bytes").over(by_key),
        "whole": F.sum("bytes").over(Window.partitionBy("part", "key")),
    }).join(F.broadcast(parts), "part")
    placed = materialize(placed.select("key", "cell", "whole", (F.col("n0") + F.col("before")).alias("first"), (F.col("b0") + F.col("upto")).alias("end")), "shard-placed")

    total, largest = placed.agg(F.max("end"), F.max("whole")).first()
    cuts, capacity = [], 0
    if total is not None:
        one = placed.select("end").distinct()
        ends = Ends(materialize(one.repartitionByRange(parallelism(spark), "end").sortWithinPartitions("end"), "shard-ends"))
        capacity, cuts = minimax_cuts(ends, largest, total, n_shards)
    shard = F.lit(0)
    for cut in cuts:
        shard = shard + (F.col("end") > cut).cast("int")
    placed = placed.withColumn("shard", shard)
    starts = {row["shard"]: row["start"] for row in placed.groupBy("shard").agg(F.min("first").alias("start")).collect()}  # a row a shard
    start = F.element_at(F.array(*[F.lit(starts.get(i, 0)).cast("long") for i in range(n_shards)]), F.col("shard") + 1)
    placed = placed.select("key", "cell", "shard", (F.col("first") - start).alias("offset"))
    within = F.row_number().over(Window.partitionBy("key", "cell").orderBy("id"))
    return rows.join(placed, ["key", "cell"]).select(
        F.col("id").alias(id_col), "size", F.col("crc").alias("text_crc32"), "shard", (F.col("offset") + within - 1).cast("long").alias("slot"),
        F.col("key").alias("group_key"), F.lit(capacity).cast("long").alias("capacity"),
    )
