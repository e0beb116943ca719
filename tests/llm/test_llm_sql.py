"""Queries of the training-data operators against their SQL over the test tables."""

import pytest
from compare import duck, duck_side, spark_side, type_differences

import __spark_entry__ as entry_module
from tradewind.llm import registry


@pytest.mark.parametrize("directory", ["/root/testdata/sf0.001", "/root/testdata/sf0.01"])
@pytest.mark.parametrize("name", sorted(registry.ORACLE))
def test_query_equals_sql(spark, directory, name):
    df, connection = registry.QUERIES[name](spark, directory), duck(directory)
    assert type_differences(df, connection, registry.ORACLE[name]) == []
    assert spark_side(df) == duck_side(connection, registry.ORACLE[name])


def test_all_are_registered():
    names = entry_module.queries()
    assert {n.split("_")[0] for n in names if n.startswith("op")} == {f"op{n}" for n in range(1, 14)} and "pipeline" in names
    assert set(registry.ORACLE) < set(registry.QUERIES)
