"""Every registered query with an oracle statement against DuckDB; the others must run and be stable."""

import pytest

import __spark_entry__ as entry
import oracle

QUERIES, STATEMENTS = entry.queries(), entry.oracle_sql()


def test_registry():
    assert set(STATEMENTS) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(STATEMENTS))
def test_matches_oracle(spark, duck, data, name):
    assert oracle.compare(spark, duck, data, QUERIES[name], STATEMENTS[name]) == []


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(STATEMENTS)))
def test_rows_only(spark, data, name):
    first = sorted(map(str, QUERIES[name](spark, data).collect()))
    assert first and first == sorted(map(str, QUERIES[name](spark, data).collect()))


def test_entry(spark, data):
    assert entry.entry(spark).count() > 0
