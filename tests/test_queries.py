"""Every named query with an oracle gives the oracle's result, on the smallest tables."""

import pytest
from compare import compare, connect

import __spark_entry__ as entry

ORACLE = entry.oracle_sql()


@pytest.fixture(scope="session")
def con(sf):
    return connect(sf)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_matches_oracle(spark, con, sf, name):
    _, _, verdict = compare(spark, con, name, entry.queries()[name], ORACLE[name], sf)
    assert verdict == "ok"


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_oracle_names_are_queries():
    assert set(ORACLE) <= set(entry.queries())
