"""Every registered query against its SQL, on the smallest given tables."""

import pytest

from __spark_entry__ import entry
from checks.compare import compare, database
from checks.oracles import SQL
from checks.queries import Q

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return database(SF)


def test_every_query_has_its_sql():
    assert set(Q) == set(SQL)


def test_entry(spark):
    assert entry(spark).limit(1).count() == 1


@pytest.mark.parametrize("name", list(Q))
def test_query_matches_sql(spark, con, name):
    line = compare(spark, con, SF, name, Q[name], SQL[name])
    assert line.startswith("OK"), line
