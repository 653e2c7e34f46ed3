"""Every catalog query with an oracle matches DuckDB (row count, names, value hash) on sf0.001;
every query without one runs and returns rows."""

import pytest

from causeway.plans.catalog import QUERIES, SQL
from conftest import SF_SMALL
from oracle_compare import compare, duck

_CON = {}


def _con():
    if "c" not in _CON:
        _CON["c"] = duck(SF_SMALL)
    return _CON["c"]


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_duckdb(spark, name):
    r = compare(spark, name, SF_SMALL, _con(), verbose=True)
    assert r["status"] == "ok", r


ROWS_ONLY = sorted(set(QUERIES) - set(SQL))


@pytest.mark.parametrize("name", ROWS_ONLY)
def test_rows_only_queries_run(spark, name):
    assert QUERIES[name](spark, SF_SMALL).count() >= 1


def test_every_query_is_registered_in_entry():
    import __spark_entry__ as e
    assert set(e.oracle_sql()) <= set(e.queries())
    assert set(QUERIES) <= set(e.queries())


def test_entry_smoke(spark):
    import __spark_entry__ as e
    df = e.entry(spark)
    rows = df.collect()
    assert len(rows) == 1 and abs(rows[0]["value"] - 320) < 20
