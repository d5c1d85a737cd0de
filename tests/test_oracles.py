"""Every registered query equals its SQL twin on the small tables, or at least gives rows."""

import pytest

import oracle
from rankspark.plans import registry

FOLDER = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def con():
    return oracle.duck(FOLDER)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, con, name):
    if name in registry.ORACLES:
        assert oracle.differences(spark, con, FOLDER, name, registry.QUERIES[name], registry.ORACLES[name]) == ""
    else:
        assert registry.QUERIES[name](spark, FOLDER).limit(1).count() == 1
