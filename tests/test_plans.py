"""What the planner makes of the queries."""

import re

import pytest
from conftest import SMALL

from tessera.plans import registry

QUERIES = registry.queries()
#: Queries whose hooks, folds or packed postings run Python on purpose.
WITH_PYTHON = {"C11_prose_windows", "C12_block_packing", "C05_lead_merge", "C07_schematic_sections", "C10_atomic_blocks", "C13_section_driver", "C18_corpus_chunks", "X03_embed", "R01_query_embedding", "R02_dense_top_k", "R08_query_excerpt", "S22_index_store", "R03_bm25_scores", "R04_bm25_top_k", "R06_schematic_recall", "R14_pool_retrieve", "R20_flat_retrieve", "R21_retrieve", "G10_classification", "G14_answers", "G13_lifecycle", "S19_reply", "F09_scope_extraction"}


def plan(df):
    return df._jdf.queryExecution().toString()


@pytest.mark.parametrize("name", sorted(set(QUERIES) - WITH_PYTHON))
def test_no_python_and_no_cartesian_product(spark, name):
    text = plan(QUERIES[name](spark, SMALL))
    assert not re.search("ArrowEvalPython|BatchEvalPython|MapInPandas|MapInArrow|FlatMapGroups|CartesianProduct", text)


def test_scans_read_only_what_is_used(spark):
    schema = re.search(r"ReadSchema: struct<([^>]*)>", plan(QUERIES["S16_page_class"](spark, SMALL))).group(1)
    assert {c.split(":")[0] for c in schema.split(",")} == {"l_orderkey", "l_partkey", "l_linenumber", "l_quantity", "l_discount"}


def test_filters_reach_the_scan(spark):
    assert re.search(r"PushedFilters: \[[^\]]*IsNotNull\(text\)", plan(QUERIES["T27_fact_match"](spark, SMALL)))


def test_top_k_is_cut_before_the_shuffle(spark):
    text = plan(QUERIES["R13_flat_order"](spark, SMALL))
    assert text.count("WindowGroupLimit") >= 2
