"""The queries with a DuckDB equivalent, held against it."""

import oracle
import pytest

from tidemark.llm import queries


@pytest.mark.parametrize("sf", ["/root/testdata/sf0.001", "/root/testdata/sf0.01"])
@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_equals_duckdb(spark, name, sf):
    assert not oracle.differs(spark, name, queries.QUERIES[name], queries.ORACLE_SQL[name], sf)
