"""Every query with SQL equals it; the others return rows of a stable schema."""

import pytest
from harness import compare, data_dir

import __spark_entry__ as entry
from loamstone import queries as own


@pytest.mark.parametrize("name", sorted(own.oracle_sql()))
def test_equals_sql(spark, name):
    compare(spark, name, data_dir("0.001"))


@pytest.mark.parametrize("name", sorted(set(own.queries()) - set(own.oracle_sql())))
def test_runs(spark, name):
    df = own.queries()[name](spark, data_dir("0.001"))
    assert len(df.collect()) > 0 and len(set(df.columns)) == len(df.columns)


def test_entry(spark):
    assert entry.entry(spark).count() == 200


def test_sketches_come_near(spark):
    got = own.queries()["agg_approx"](spark, data_dir("0.01")).collect()
    assert all(abs(r.events - r.n) <= 0.05 * r.n and 100 <= r.users <= 160 for r in got)


def test_sql_has_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())
