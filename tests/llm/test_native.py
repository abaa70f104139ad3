import re

import pytest
from conftest import SMALL

from tessera.llm import queries


@pytest.mark.parametrize("name", ["op6_shards", "op9_chat"])
def test_native_operators_run_no_python(spark, name):
    df = queries.queries()[name](spark, SMALL)
    assert not re.search("Python|Pandas|Arrow|CartesianProduct", df._jdf.queryExecution().executedPlan().toString())


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_no_cartesian_product(spark, name):
    assert "CartesianProduct" not in queries.queries()[name](spark, SMALL)._jdf.queryExecution().toString()
