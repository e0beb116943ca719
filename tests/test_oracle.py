"""Every registered query against its SQL, values and types, over the smallest test tables."""

import pytest
from compare import duck, duck_side, spark_side, type_differences

import __spark_entry__ as entry_module
from registry.oracle import all_oracles
from registry.queries import all_queries

# The training-data queries have their own tests, beside their package.
QUERIES = all_queries()
ORACLES = all_oracles()


@pytest.fixture(scope="module")
def connection(small_dir):
    return duck(small_dir)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, small_dir, connection, name):
    df = QUERIES[name](spark, small_dir)
    assert type_differences(df, connection, ORACLES[name]) == []
    columns, rows = spark_side(df)
    expected_columns, expected = duck_side(connection, ORACLES[name])
    assert columns == expected_columns
    assert rows == expected


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_without_sql_gives_rows(spark, small_dir, name):
    assert QUERIES[name](spark, small_dir).count() > 0


def test_every_sql_belongs_to_a_query():
    assert set(ORACLES) <= set(QUERIES)


def test_entry_has_rows(spark):
    assert entry_module.entry(spark).count() > 0
