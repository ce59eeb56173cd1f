"""Every registered query of the subpackage, whole tables: against SQL where there is some."""

import os

import pytest

import __spark_entry__ as driver
from rosterlake.llm import catalog
from tests.compare import canonical, differences, duck

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables are not here")


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_agrees_with_sql(spark, name):
    df = driver.queries()[name](spark, SF)
    cursor = duck(SF).execute(catalog.oracle_sql()[name])
    columns = [d[0] for d in cursor.description]
    assert sorted(columns) == sorted(df.columns)
    got, want = canonical([tuple(r) for r in df.collect()], df.columns), canonical(cursor.fetchall(), columns)
    assert len(got) == len(want)
    assert not differences(got, want)[:3]


def test_all_operators_and_the_pipeline_are_registered():
    names = driver.queries()
    assert all(sum(n.startswith(f"op{k}_") for n in names) == 1 for k in range(1, 14))
    assert "pipeline" in names
