import os

from pyspark.sql import functions as F

from tessera.operators import durable


def tables(spark):
    return set(os.listdir(durable.shared_folder(spark).removeprefix("file:")))


def test_scratch_tables_go_and_kept_ones_stay(spark):
    before = tables(spark)
    with durable.scratch(spark):
        inner = durable.materialize(spark.range(5), "inner")
        out = durable.materialize(inner.withColumn("x", F.col("id") * 2), "outer", keep=True)
        assert len(tables(spark) - before) == 2
    left = tables(spark) - before
    assert len(left) == 1 and next(iter(left)).startswith("outer") and out.count() == 5


def test_scratch_cleans_up_after_an_error(spark):
    before = tables(spark)
    try:
        with durable.scratch(spark):
            durable.materialize(spark.range(2), "inner")
            raise KeyError
    except KeyError:
        pass
    assert tables(spark) == before


def test_broadcast_only_if_small(spark):
    small, large = spark.range(10), spark.range(1000)
    plan = lambda df: df._jdf.queryExecution().toString()
    assert "strategy=broadcast" in plan(durable.broadcast_if_small(small, 100)) and "strategy=broadcast" not in plan(durable.broadcast_if_small(large, 100))
    assert "strategy=broadcast" not in plan(durable.broadcast_if_small(small, 40, F.col("id")))
