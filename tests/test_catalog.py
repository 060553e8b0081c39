"""Every registered query gives the rows of its SQL counterpart; those without one give rows."""

import os

import pytest

from textloom import catalog

from .compare import duck, rows

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    return duck(DATA)


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, con, name):
    found = catalog.queries()[name](spark, DATA).toPandas()
    sql = catalog.oracle_sql().get(name)
    if sql is None:
        assert len(found.columns) > 0
        return
    expected = con.sql(sql).df()
    assert sorted(found.columns) == sorted(expected.columns)
    assert rows(found) == rows(expected)


def test_entry_without_llm_parts():
    import __spark_entry__ as entry

    assert set(catalog.queries()) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
