"""Every registered query against its DuckDB counterpart."""

import pytest
from compare import connect, difference

import __spark_entry__ as entry_points

QUERIES = entry_points.queries()
ORACLES = entry_points.oracle_sql()


@pytest.fixture(scope="module")
def duck(folder):
    return connect(folder)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(name, spark, folder, duck):
    result = QUERIES[name](spark, folder)
    if name in ORACLES:
        assert difference(result, duck, ORACLES[name]) is None
    else:
        assert result.count() > 0


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)
