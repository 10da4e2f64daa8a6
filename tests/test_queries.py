"""Every named query against DuckDB; those without SQL must give rows."""

import pytest

import __spark_entry__ as entry
from tests.oracle import compare

SQL = entry.oracle_sql()
QUERIES = entry.queries()


@pytest.mark.parametrize("name", [n for n in QUERIES if n in SQL])
def test_equals_duckdb(spark, duck_medium, medium, name):
    assert compare(spark, duck_medium, medium, QUERIES[name], SQL[name]) is None


@pytest.mark.parametrize("name", [n for n in QUERIES if n not in SQL])
def test_gives_rows(spark, duck_medium, small, name):
    assert compare(spark, duck_medium, small, QUERIES[name], None) is None


def test_entry_has_a_stable_schema(spark):
    df = entry.entry(spark)
    assert df.columns == ["sender_bank", "total", "fraud_count", "fraud_rate"]
    assert df.count() == 8


def test_catalogue_is_complete():
    names = list(QUERIES)
    for prefix, n in (("q", 50), ("t", 30), ("d", 16)):
        numbers = {x[1:3] for x in names if x[0] == prefix and x[1:3].isdigit()}
        assert len(numbers) == n
