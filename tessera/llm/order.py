"""Places in a global order, without a task that sees all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.shared import broadcast_if_small, materialize, parallelism

#: (Range, group) pairs that may be broadcast to the rows.
SMALL_STARTS = 100_000


def numbered(rows: DataFrame, by: str, order: list[str], out: str = "place", size: str = "total") -> DataFrame:
    """``rows`` with ``out``, their place (from 0, without gaps) among the rows of equal ``by`` (not null), and
    ``size``, how many those are.

    Rows are dealt by range and sorted, so a range numbers its rows by itself; how many rows of a group lie
    in earlier ranges is a sum over one row for each range and group.  Rows that are equal throughout are
    told apart by where they came from, so that a repeated row splits over ranges too.  The dealt rows are
    written once, so places cannot change when a task runs again.  Repeated, null and empty inputs need no
    special case; ``rows`` should be a written table, as it is read twice (for the ranges, then to deal)."""
    spark = rows.sparkSession
    keys = [by, *order, "__from"]
    dealt = rows.withColumn("__from", F.monotonically_increasing_id()).repartitionByRange(parallelism(spark), *keys).sortWithinPartitions(*keys)
    dealt = dealt.drop("__from").withColumn("__at", F.monotonically_increasing_id()).withColumn("__range", F.shiftright("__at", 33))
    dealt = materialize(dealt, "dealt")
    ranges = dealt.groupBy("__range", by).agg(F.min("__at").alias("__first"), F.count("*").alias("__n"))
    earlier = Window.partitionBy(by).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.withColumns({"__before": F.coalesce(F.sum("__n").over(earlier), F.lit(0)), size: F.sum("__n").over(Window.partitionBy(by))}).drop("__n")
    starts = broadcast_if_small(materialize(ranges, "range-starts"), SMALL_STARTS)
    return dealt.join(starts, ["__range", by]).withColumn(out, F.col("__before") + F.col("__at") - F.col("__first")).drop("__range", "__at", "__first", "__before")
