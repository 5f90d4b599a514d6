"""Every registered query against its SQL on DuckDB."""

import compare
import pytest

import __spark_entry__ as entry
from claimloom import oracles, registry


@pytest.fixture(scope="module")
def duck(sf_dir):
    return compare.connect(sf_dir)


def test_every_query_has_sql():
    assert set(registry.queries()) == set(oracles.oracle_sql())
    assert set(registry.queries()) <= set(entry.queries())
    assert set(oracles.oracle_sql()) <= set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, sf_dir, duck, name):
    df = entry.queries()[name](spark, sf_dir)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
    got = compare.spark_rows(df)
    want = compare.duck_rows(duck, entry.oracle_sql()[name])
    assert got[0] == want[0]
    assert got[1] == want[1]
    assert got[1], "agreement on an empty result proves nothing"


def test_entry(spark):
    assert entry.entry(spark).count() > 0
