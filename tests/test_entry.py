import os

import pytest

import __spark_entry__ as entry
from workload.check import duck, rows_of

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="shared test tables are not here")


def test_entry(spark):
    row = entry.entry(spark).first()
    assert row["wrong_before"] > 0 and row["wrong_after"] < row["wrong_before"]


def test_registry():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_equals_sql(spark, name):
    df = entry.queries()[name](spark, SF)
    got = rows_of(df.columns, df.collect())
    cursor = duck(SF).execute(entry.oracle_sql()[name])
    want = rows_of([c[0] for c in cursor.description], cursor.fetchall())
    assert got == want
