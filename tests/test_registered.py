"""Every registered query against its SQL on the smallest test tables."""

import duckdb
import pytest

import harness
from conftest import SMALL
from meterlens.registered.all import all_queries
from meterlens.registered.inputs_sql import dates_as_text

QUERIES = all_queries()
ORACLE = dates_as_text({n: q.oracle() for n, q in QUERIES.items() if q.sql is not None})


@pytest.fixture(scope="module")
def con() -> duckdb.DuckDBPyConnection:
    return harness.duck(SMALL)


@pytest.mark.parametrize("name", list(QUERIES))
def test_matches_sql(name, tables, con):
    found = harness.spark_rows(QUERIES[name].rows(tables))
    wanted = harness.duck_rows(con, ORACLE[name])
    assert harness.difference(found, wanted) is None, harness.difference(found, wanted)


def test_entry_points(spark):
    import __spark_entry__ as entry
    assert entry.entry(spark).count() == 10
    assert set(entry.oracle_sql()) <= set(entry.queries())
