"""Every query with an SQL equivalent, against DuckDB; the others run."""

import pytest
from oracle import connect, duck_rows, spark_rows

from skarn.queries import ORACLES, QUERIES

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_as_sql(spark, con, name):
    assert spark_rows(QUERIES[name](spark, FOLDER)) == duck_rows(con, ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, name):
    assert QUERIES[name](spark, FOLDER).count() > 0


def test_clustered_search_finds_most(spark):
    """At a quarter of the lists, for every query of the stated set."""
    found = QUERIES["cluster_search_recall"](spark, FOLDER).collect()
    assert {r["query"] for r in found} == set(range(0, 500, 100))
    assert sum(r["recall"] for r in found) / len(found) >= 0.9 and all(r["ap"] <= r["recall"] for r in found)
