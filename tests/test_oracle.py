"""Every query with SQL gives the rows of its SQL; the others give rows."""

import pytest

import __spark_entry__ as contract
from tests.oracle import compare, connect


@pytest.fixture(scope="module")
def con(tiny):
    return connect(tiny)


@pytest.mark.parametrize("name", sorted(contract.oracle_sql()))
def test_query_equals_sql(spark, con, tiny, name):
    assert compare(spark, con, tiny, name) == ""


def test_every_sql_has_a_query():
    assert set(contract.oracle_sql()) <= set(contract.queries())


def test_entry(spark):
    rows = contract.entry(spark)
    assert rows.columns == ["doc_id", "word", "n", "tf", "idf", "tf_idf"]
    assert rows.count() > 0
