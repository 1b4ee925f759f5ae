import pytest
from oracle import compare, connect

from __spark_entry__ import entry
from lmprep.catalog import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_equals_sql(spark, con, name):
    result = compare(spark, con, name, QUERIES[name], ORACLES.get(name), SF)
    assert result["ok"] is not False, (result["rows"], result["want"], result["types"])


def test_every_query_has_sql():
    assert set(ORACLES) == set(QUERIES)


def test_entry(spark):
    assert entry(spark).limit(1).count() == 1
