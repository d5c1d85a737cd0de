"""The training-data queries against their SQL twins on the small tables."""

import pytest

import oracle
from rankspark.llm import oracles, queries

FOLDER = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(oracles.ORACLES))
def test_query(spark, name):
    assert oracle.differences(spark, oracle.duck(FOLDER), FOLDER, name, queries.QUERIES[name], oracles.ORACLES[name]) == ""
