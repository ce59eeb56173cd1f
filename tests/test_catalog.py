"""Every registered query with SQL agrees with it on the smallest tables."""

import os

import pytest

import __spark_entry__ as driver
from tests.compare import canonical, differences, duck

SF = "/root/testdata/sf0.001"
SQL = driver.oracle_sql()

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables are not here")


@pytest.fixture(scope="module")
def con():
    return duck(SF)


def agree(spark, con, name):
    df = driver.queries()[name](spark, SF)
    cursor = con.execute(SQL[name])
    columns = [d[0] for d in cursor.description]
    assert sorted(columns) == sorted(df.columns)
    got, want = canonical([tuple(r) for r in df.collect()], df.columns), canonical(cursor.fetchall(), columns)
    assert len(got) == len(want)
    assert not differences(got, want)[:3]


@pytest.mark.parametrize("name", sorted(SQL))
def test_query(spark, con, name):
    agree(spark, con, name)


@pytest.mark.parametrize(
    "name", ["rolling_form", "prior_count", "expanding_mean_delta", "rank_pairing", "multi_key_rank", "as_of_backfill",
             "distribution_summary", "nest_unnest", "ledger_continuity", "stream_form"],
)
def test_query_with_hot_groups(spark, con, hot, name):
    agree(spark, con, name)


def test_entry(spark):
    assert driver.entry(spark).count() > 0
