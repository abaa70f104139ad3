"""Schematic documents: pages of a small file are many tasks' work, and a document is its pages."""

from conftest import SMALL
from pyspark.sql import functions as F

from tessera.operators import pages as P
from tessera.sources import views as V

LEAD = "# 电子图纸分析报告：Board\n\n"


def read(spark, documents):
    rows = V.hw_pages(spark, SMALL).filter("page_id < 60").coalesce(1)
    return rows.select((F.col("page_id") % documents).cast("string").alias("doc"), F.lit("Board").alias("title"), F.col("page_id").cast("int").alias("page"), "text", F.col("text").alias("scanned"), F.lit(None).cast("string").alias("described"), F.lit("p1").alias("project"))


def test_pages_are_dealt_before_they_are_read(spark):
    """One file is one partition; what costs time is not left to its task."""
    plan = P.schematic_documents(read(spark, 5))._jdf.queryExecution().optimizedPlan().toString()
    assert "RepartitionByExpression" in plan
    assert "regexp_extract_all" not in plan[plan.index("RepartitionByExpression") :]


def test_a_document_is_its_pages_in_order(spark):
    single = {int(r.doc): r for r in P.schematic_documents(read(spark, 1000)).collect()}
    whole = P.schematic_documents(read(spark, 5)).collect()
    assert sorted(r.doc for r in whole) == ["0", "1", "2", "3", "4"]
    for r in whole:
        own = [single[i] for i in range(60) if i % 5 == int(r.doc)]
        assert r.page_count == len(own) == 12
        assert r.content == LEAD + "\n\n---\n\n".join(x.content.removeprefix(LEAD).strip() for x in own) + "\n"
        assert r.nets == list(dict.fromkeys(n for x in own for n in x.nets))
        assert r.interfaces == list(dict.fromkeys(n for x in own for n in x.interfaces))
