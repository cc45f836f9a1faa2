"""Every query with SQL gives the rows that DuckDB gives; the others run."""

import re

import pytest

from daftar import plans

from .conftest import SF, same_rows

QUERIES, ORACLES = plans.queries(), plans.oracle_sql()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, duck, name):
    same_rows(QUERIES[name](spark, SF), duck.execute(ORACLES[name]))


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_without_sql_runs(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


@pytest.mark.parametrize("name", ["l11_classification", "l12_titles"])
def test_titles_are_joined_in_a_stated_order(name):
    """The order of a window's frame is no promise to string_agg: its own ORDER BY is."""
    assert "string_agg(" in ORACLES[name] and all(re.match(r"string_agg\(line, ' ' ORDER BY pos\)", ORACLES[name][m.start() :]) for m in re.finditer("string_agg", ORACLES[name]))


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).columns == ["query_id", "chunk_id", "score", "rank"]
    assert set(e.oracle_sql()) <= set(e.queries())
