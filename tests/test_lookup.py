import pytest
from pyspark.sql import functions as F

from cellsmith.operators import lookup as lk


@pytest.mark.parametrize("limit", [100_000, 3])
@pytest.mark.parametrize("how", ["left", "inner"])
def test_lookup_join(spark, monkeypatch, limit, how):
    monkeypatch.setattr(lk, "BROADCAST_ROWS", limit)
    monkeypatch.setattr(lk, "HOT_KEYS", 2)
    key = F.when(F.col("id") % 3 == 0, F.lit(0)).when(F.col("id") % 50 == 1, F.lit(None)).otherwise(F.col("id") % 40)
    rows = spark.range(600).select("id", key.alias("k"))
    table = spark.range(30).select(F.col("id").alias("k"), (F.col("id") * 10).alias("v"), F.when(F.col("id") == 0, 200).otherwise(1).alias("n"))
    got = sorted(lk.lookup_join(rows, table, ["k"], "n", how).select("id", "k", "v").collect(), key=str)
    want = sorted(rows.join(table.drop("n"), "k", how).select("id", "k", "v").collect(), key=str)
    assert got == want
