import math

import pytest
from pyspark.sql import functions as F

from cellsmith.operators.dependency import (
    cooccurrence_mi,
    fd_lookup,
    fd_propose,
    fd_repair,
    fd_validate,
    fd_violations,
    informative_columns,
    nmi_pairs,
    parse_fd,
    read_declared_fds,
    related_columns,
    type_check,
)


@pytest.fixture
def correlated(spark):
    return spark.createDataFrame([("1", "1", "x"), ("2", "2", "x"), ("3", "3", "y"), ("4", "4", "y")], "A string, B string, C string")


def test_equal_columns_score_ln2(correlated):
    scores = nmi_pairs(correlated, ["A", "B", "C"])
    got = {(r["col_a"], r["col_b"]): r["nmi"] for r in scores.collect()}
    assert got[("A", "B")] == pytest.approx(math.log(2))
    best = {r["col"]: r["related"] for r in related_columns(scores, 1).collect()}
    assert best["A"] == "B" and best["B"] == "A" and best["C"] == "A"


def test_nmi_skips_missing_and_constants(spark):
    rows = spark.createDataFrame([("a", "x"), ("nan", "y"), (None, "x"), ("b", "x")], "p string, q string")
    assert nmi_pairs(rows, ["p", "q"]).first()["nmi"] == 0.0
    none = spark.createDataFrame([(None, "y")], "p string, q string")
    assert nmi_pairs(none, ["p", "q"]).first()["nmi"] == 0.0


def test_cooccurrence_needs_repeats(spark):
    rows = spark.createDataFrame([("a", "x", "1"), ("a", "x", "2"), ("b", "y", "3"), ("b", "y", "4")], "p string, q string, k string")
    got = {(r["target"], r["col"]): r["score"] for r in cooccurrence_mi(rows, ["p", "q", "k"]).collect()}
    assert got[("p", "q")] == pytest.approx(1.0) and got[("p", "k")] == 0.0 and got[("p", "p")] == pytest.approx(1.0)
    kept = {(r["target"], r["col"]) for r in informative_columns(cooccurrence_mi(rows, ["p", "q", "k"])).collect()}
    assert ("p", "q") in kept and ("p", "k") not in kept


def test_fd_forms():
    assert parse_fd("zip → city") == ("zip", "city")
    assert parse_fd("None → city") is None and parse_fd("zip -> city") is None
    assert read_declared_fds('{"state": ["zip"], "state": ["zip", "area"]}') == [(["zip"], "state"), (["zip", "area"], "state")]


@pytest.fixture
def zips(spark):
    rows = [(i, "z1", "Rome") for i in range(6)] + [(6, "z1", "Bonn"), (7, "z2", "Oslo"), (8, "z2", "Lima"), (9, "z3", None)]
    return spark.createDataFrame(rows, "id long, zip string, city string").withColumn("flag", F.col("id").isin(6, 9))


def test_fd_repair(zips):
    got = {r["id"]: r["city"] for r in fd_repair(zips, "zip", "city", F.col("flag"), ~F.col("flag")).collect()}
    assert got[6] == "Rome" and got[9] is None and got[8] == "Lima"
    assert {r["fd_key"]: r["fd_value"] for r in fd_lookup(zips, F.col("zip"), F.col("city")).collect()} == {"z1": "Rome", "z2": "Lima"}
    assert [(r["id"], r["expected"]) for r in fd_violations(zips, "id", ["zip"], "city").orderBy("id").collect()] == [(6, "Rome"), (7, "Lima"), (9, None)][:2]


def test_fd_validate(spark, zips):
    lookup = fd_lookup(zips, F.col("zip"), F.col("city"), ~F.col("flag"))
    good = spark.createDataFrame([("z1", "Bonn", "Rome"), ("z9", "Kiel", "Kiel")], "key_value string, dirty_value string, truth string")
    assert fd_validate(good, lookup).first() == (2, 0, True)
    bad = good.union(spark.createDataFrame([("z2", "x", "Oslo")], good.schema))
    assert fd_validate(bad, lookup).first() == (3, 1, False)


def test_fd_propose_drops_keys(zips):
    text = zips.select(F.col("id").cast("string").alias("id"), "zip", "city")
    got = {(r["determinant"], r["dependent"]): r["purity"] for r in fd_propose(text, ["id", "zip", "city"], target="city").collect()}
    assert set(got) == {("zip", "city")} and got[("zip", "city")] == pytest.approx(7 / 9)


def test_type_rules(spark):
    rows = spark.createDataFrame([(1, "1/1/71", "212", "NY", "05"), (2, "soon", "21", "N", "5"), (3, None, None, None, None)], "id long, d string, a string, s string, z string")
    rules = {"d": "date", "a": "3 digits", "s": "2 letters", "z": "non-zero-leading digits"}
    got = {r["id"]: tuple(r)[1:] for r in type_check(rows, "id", rules).collect()}
    assert got == {1: (True, True, True, False), 2: (False, False, False, True), 3: (False,) * 4}
    with pytest.raises(ValueError):
        type_check(rows, "id", {"d": "predefined list"})
