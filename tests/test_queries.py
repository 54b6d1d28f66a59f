"""Every registered query runs; those with SQL give the same rows in another engine."""

import pytest

import __spark_entry__
from quern.plans import registry

from compare import rows_of_frame, rows_of_sql

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_same_rows_as_sql(spark, name):
    cols, rows = rows_of_frame(registry.QUERIES[name](spark, SF))
    want_cols, want = rows_of_sql(SF, registry.ORACLES[name])
    assert cols == want_cols
    assert rows == want


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_runs(spark, name):
    df = registry.QUERIES[name](spark, SF)
    assert df.columns
    df.collect()


def test_index_finds_the_nearest(spark):
    got = registry.QUERIES["ret_ivf_recall"](spark, SF).collect()
    assert min(r["recall"] for r in got) >= 0.9
    assert all(sum(r["query"] == x["query"] for x in got) == 10 for r in got)


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
