import pytest
from pyspark.sql import functions as F

from cellsmith.operators.cells import diff_mark, diff_summary, error_report, flagged_column_list, pivot_cells, repair_overlay, unpivot_cells
from cellsmith.operators.encode import decode_column, encode_columns, label_dictionary, round_category_like
from cellsmith.operators.ordering import exact_quantiles, global_rank
from cellsmith.operators import ordering
from cellsmith.operators.profile import distribution_report, histogram, profile
from cellsmith.sources.tables import column_kinds, load_state, read_csv, read_csv_text, save_state, table_shape, write_corrections


def test_csv_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([(1, 'a "q", b', None), (2, "x", "12.0 oz.")], "id long, `beer-name` string, ounces string")
    path = str(tmp_path / "t")
    write_corrections(rows, path)
    back = read_csv_text(spark, path)
    assert table_shape(back) == (2, 3, ["id", "beer-name", "ounces"])
    assert sorted(back.collect()) == [("1", 'a "q", b', "null"), ("2", "x", "12.0 oz.")]
    typed = read_csv(spark, path)
    assert column_kinds(typed) == {"id": "Numeric", "beer-name": "Categorical", "ounces": "Categorical"}


def test_csv_splits(spark, tmp_path):
    """A file is read by several tasks unless cells may hold line breaks."""
    path = str(tmp_path / "one.csv")
    with open(path, "w") as f:
        f.write("id,text\n" + "".join(f"{i},some text of row {i}\n" for i in range(20_000)))
    size = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "100k")
    try:
        assert read_csv_text(spark, path).rdd.getNumPartitions() > 3 and read_csv_text(spark, path).count() == 20_000
        assert read_csv_text(spark, path, multi_line=True).rdd.getNumPartitions() == 1
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)


def test_state_round_trip(spark, tmp_path):
    save_state(spark, {"a": [1.5, None], "b": {"x": "y\nz"}}, str(tmp_path / "s"))
    assert load_state(spark, str(tmp_path / "s")) == {"a": [1.5, None], "b": {"x": "y\nz"}}


@pytest.fixture
def people(spark):
    dirty = spark.createDataFrame([(1, "Ann", "30"), (2, "Bob", "999"), (3, None, "41")], "id long, name string, age string")
    clean = spark.createDataFrame([(1, "Ann", "30"), (2, "Bob", "31"), (3, "Cy", "41")], "id long, name string, age string")
    mask = spark.createDataFrame([(1, False, False), (2, False, True), (3, True, False)], "id long, name boolean, age boolean")
    return dirty, clean, mask


def test_cells(people):
    dirty, clean, mask = people
    assert sorted(error_report(dirty, mask, "id").collect(), key=str) == [(2, "age", "999"), (3, "name", None)]
    assert flagged_column_list(mask, "id") == ["name", "age"]
    assert sorted(diff_mark(clean, dirty, "id").collect()) == [(2, "age", "31", "999"), (3, "name", "Cy", "null")]
    assert diff_summary(clean, dirty, "id").first() == (2, pytest.approx(100 * 2 / 6))
    cells = unpivot_cells(dirty, "id", ["name", "age"])
    assert cells.count() == 6
    assert sorted(pivot_cells(cells, "id", ["name", "age"]).collect(), key=str) == sorted(dirty.collect(), key=str)


def test_overlay(people):
    dirty, clean, mask = people
    out, left = repair_overlay(dirty, clean, mask, clean.filter("id = 2").select("id"), "id")
    assert sorted(out.collect(), key=str) == [(1, "Ann", "30"), (2, "Bob", "31"), (3, None, "41")]
    assert {r["id"]: (r["name"], r["age"]) for r in left.collect()} == {1: (False, False), 2: (False, False), 3: (True, False)}


def test_overlay_keeps_null_truth(people):
    dirty, clean, mask = people
    truth = clean.withColumn("age", F.when(F.col("id") != 2, F.col("age")))
    out, _ = repair_overlay(dirty, truth, mask, clean.filter("id = 2").select("id"), "id")
    assert out.filter("id = 2").first()["age"] is None


def test_encode_decode(spark):
    rows = spark.createDataFrame([(1, "b"), (2, "a"), (3, None), (4, "c")], "id long, v string")
    words = label_dictionary(rows, "v")
    assert {r["value"]: r["code"] for r in words.collect()} == {"a": 0, "b": 1, "c": 2}
    coded = encode_columns(rows, ["v"], {"v": words})
    assert {r["id"]: r["v"] for r in coded.collect()} == {1: 1.0, 2: 0.0, 3: None, 4: 2.0}
    moved = coded.withColumn("v", F.col("v") * 3 + 0.5)
    assert {r["id"]: r["v"] for r in decode_column(moved, "v", words).collect()} == {1: "c", 2: "a", 3: None, 4: "c"}


def test_rounding_only_categories(spark):
    rows = spark.range(100).select(F.col("id"), (F.col("id") % 19).cast("double").alias("few"), (F.col("id") % 20).cast("double").alias("many"))
    made = rows.select("id", (F.col("few") + 0.5).alias("few"), (F.col("many") + 0.5).alias("many"))
    out = {r["id"]: r for r in round_category_like(made, rows, ["few", "many"]).collect()}
    assert out[0]["few"] == 0.0 and out[1]["few"] == 2.0 and out[0]["many"] == 0.5


def test_global_rank(spark):
    rows = spark.range(1000).select(F.md5(F.col("id").cast("string")).alias("v"))
    got = {r["v"]: r["rank"] for r in global_rank(rows, ["v"]).collect()}
    assert got == {v: i for i, v in enumerate(sorted(got))}


@pytest.mark.parametrize("small", [100_000, 50])
def test_exact_quantiles(spark, monkeypatch, small):
    import numpy as np

    monkeypatch.setattr(ordering, "SMALL", small)
    rng = np.random.default_rng(1)
    values = np.concatenate([rng.normal(size=4000), np.full(2000, 0.25)])
    rows = spark.createDataFrame([(float(v),) for v in values], "v double")
    shares = [0.0, 0.01, 0.25, 0.5, 0.77, 0.99, 1.0]
    assert exact_quantiles(rows, F.col("v"), shares) == pytest.approx(list(np.quantile(values, shares)))


def test_profile_and_bands(spark):
    rows = spark.createDataFrame([(17.0, "a"), (18.0, "a"), (None, "b"), (70.0, None)], "age double, name string")
    got = {r["name"]: r for r in profile(rows).collect()}
    assert (got["age"]["type"], got["age"]["missing"], got["age"]["mean"], got["age"]["max"]) == ("Numeric", 1, 35.0, 70.0)
    assert (got["name"]["type"], got["name"]["missing"], got["name"]["unique"]) == ("Categorical", 1, 2)
    bands = {r["band"]: r["n"] for r in histogram(rows, "age").collect()}
    assert bands == {"Under 18": 1, "18-25": 1, "26-35": 0, "36-45": 0, "46-60": 0, "Over 60": 1}
    empty = profile(rows.filter("age > 1000").select("age")).first()
    assert empty["mean"] is None and empty["missing"] == 0


def test_distribution_report_is_held_to_30_lines(spark):
    rows = spark.range(200).select(F.col("id").cast("string").alias("v"))
    lines = [r for r in distribution_report(rows, "v").collect() if r["analysis"] == "rare values"]
    assert len(lines) == 31 and max(lines, key=lambda r: r["line_no"])["line"].startswith("... Too long")
