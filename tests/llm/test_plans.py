"""The native operators stay in the JVM; nothing collects or crosses what grows with the data."""

from __future__ import annotations

import re

import pytest
from stemma.llm import queries

from tests.conftest import DATA


@pytest.mark.parametrize("name", ["op3_chat", "op4_fingerprints", "op6_sharding"])
def test_native_plans_have_no_python(spark, name):
    plan = queries.QUERIES[name](spark, DATA)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow|ExistingRDD", plan)


@pytest.mark.parametrize("name", [n for n in queries.QUERIES if n != "pipeline"])
def test_no_cross_joins(spark, name):
    plan = queries.QUERIES[name](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("CartesianProduct|BroadcastNestedLoop", plan)
