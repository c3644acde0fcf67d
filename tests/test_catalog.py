"""Every registered query against DuckDB on the smallest tables."""

from __future__ import annotations

import pytest

from cloakframe.catalog import entries
from tests.conftest import SF
from tests.oracle import connect, difference

ENTRIES = entries()


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(ENTRIES))
def test_query_agrees_with_sql(spark, con, name):
    entry = ENTRIES[name]
    frame = entry.run(spark, SF)
    if entry.sql is None:
        assert frame.count() > 0
    else:
        assert difference(frame, con, entry.sql) is None


def test_entry_points_are_consistent():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries()) >= set(ENTRIES)
