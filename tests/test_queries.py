"""Every registered query against its SQL, and a few plans that must stay as they are."""

from __future__ import annotations

import pytest

import __spark_entry__ as entry
from sieve.queries import ORACLES, QUERIES
from tests.oracle import compare, duck

SF = entry.SMOKE_DIR


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, con, name):
    df = QUERIES[name](spark, SF)
    if name in ORACLES:
        assert compare(df, con, ORACLES[name]) in (None, "no rows")
    else:
        assert df.count() > 0


def test_entry(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and "f1" in df.columns
    assert set(entry.oracle_sql()) <= set(entry.queries())
