"""Every registered query against its SQL, over the whole given tables."""

import pytest

import __spark_entry__ as entry
from feedloom.catalog.queries import QUERIES
from tests.compare import check, open_oracle


@pytest.fixture(scope="module")
def oracle(sf_dir):
    con = open_oracle(sf_dir)
    yield con
    con.close()


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["req_id", "texto", "usuario", "timestamp", "numero"]
    assert df.count() > 0


def test_every_query_has_sql():
    assert set(QUERIES) <= set(entry.oracle_sql()) and set(QUERIES) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, oracle, sf_dir, name):
    problem, _ = check(spark, oracle, sf_dir, name)
    assert problem is None, problem
