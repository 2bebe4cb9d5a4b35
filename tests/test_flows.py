import pandas as pd
import pytest
from pyspark.sql import functions as F

from cellsmith.operators import repair as rp
from cellsmith.operators.detect import function_mask, kept_rules, rule_mask, rule_scores, score_cells
from cellsmith.operators.evaluate import correction_prf, error_drop_rate, library_prf, repair_accuracy, row_prf
from cellsmith.operators.providers import labels_from_function, labels_from_predicates, repairs_from_function
from cellsmith.operators.impute import NotFittedError
from cellsmith.plans.corrector import CellCorrector
from cellsmith.plans.detector import CellDetector
from cellsmith.streaming.apply import mask_stream


@pytest.fixture
def people(spark):
    names = ["Ann", "Bob", "ErrorVal", "Cid", "Dan", "Eva", "Fay", "Gus", "Hal", "Ida"]
    ages = ["25", "30", "999", "35", "28", "41", "33", "29", "52", "47"]
    cities = ["Rome", "Oslo", "Unknown", "Rome", "Oslo", "Rome", "Oslo", "Rome", "Oslo", "Rome"]
    return spark.createDataFrame(list(zip(range(10), names, ages, cities)), "id long, name string, age string, city string")


def test_rules(people):
    labelled = people.select("id", "age", (F.col("id") == 2).cast("int").alias("label"))
    rules = {"good": "cast(age as int) < 120", "bad": "cast(age as int) > 120", "null": "try_cast(age as date) is null or true"}
    scores = {r["rule"]: r["accuracy"] for r in rule_scores(labelled, rules).collect()}
    assert scores == {"good": 1.0, "bad": 0.0, "null": 0.9}
    assert set(kept_rules(labelled, rules)) == {"good", "null"}
    assert rule_scores(labelled.limit(0), rules).first()["accuracy"] == 0.0
    mask = rule_mask(people, "id", {"age": ["cast(age as int) < 120"], "city": ["nullif(city, 'Unknown') <> ''"]})
    got = {r["id"]: (r["age"], r["city"]) for r in mask.collect()}
    assert got[2] == (True, False) and got[0] == (False, False)


def test_failing_function_rule_says_clean(people):
    def fine(pdf):
        return pdf["age"].astype(int) < 120

    def broken(pdf):
        raise RuntimeError("no")

    got = {r["id"]: r["age"] for r in function_mask(people, "id", "age", [broken, fine]).collect()}
    assert got[2] is True and sum(got.values()) == 1


def test_score_cells_without_model_or_rules(people):
    flags = score_cells(people, "id", {}, {}).collect()
    assert all(not any(r[c] for c in ("name", "age", "city")) for r in flags)


@pytest.mark.parametrize("cluster", ["bisecting", "eps"])
def test_detector(spark, people, tmp_path, cluster):
    people = people.drop("name")
    many = people.crossJoin(spark.range(4).withColumnRenamed("id", "copy")).select((F.col("id") + 10 * F.col("copy")).alias("id"), "age", "city")
    predicates = {"age": "cast(age as int) > 120", "city": "city = 'Unknown'"}
    provider = labels_from_predicates(predicates)
    with pytest.raises(NotFittedError):
        CellDetector("id", provider).transform(many)
    rules = {"age": {"small": "cast(age as int) < 120"}}
    detector = CellDetector("id", provider, rules, cluster=cluster, max_k=3).fit(many)
    mask = detector.transform(many)
    assert mask.columns == many.columns and mask.count() == 40
    assert set(detector.related) == {"age", "city"}
    detector.save(spark, str(tmp_path / cluster))
    again = CellDetector.load(spark, str(tmp_path / cluster), provider).transform(many)
    assert sorted(again.collect()) == sorted(mask.collect())
    if cluster == "bisecting":
        return
    by_rule = CellDetector("id", provider, rules, cluster=cluster, use_model=False, with_errors=False, max_k=3).fit_transform(many)
    if "age" in detector.kept:
        assert {r["id"] % 10 for r in by_rule.filter("age").collect()} == {2}


def test_detector_hands_context_to_the_provider(spark):
    rows = spark.createDataFrame([(i, str(20 + i % 5), "NY" if i % 5 < 2 else "LA") for i in range(30)], "id long, age string, city string")

    def answer(pdf, column, context):
        known = context["related"] == (["city"] if column == "age" else ["age"]) and any(r["line"].startswith(("20:", "LA:")) for r in context["distribution"])
        return pd.Series(['{"has_error_in_age_value": %s}' % ("false" if known else "true")] * len(pdf))

    mask = CellDetector("id", labels_from_function(answer, with_context=True), max_k=2, with_errors=False).fit_transform(rows)
    assert mask.filter("age or city").count() == 0


def test_split_half_is_exact(spark):
    rows = spark.range(501).selectExpr("id", "if(id % 5 = 0, 'a', 'b') AS col")
    parts = {(r["col"], r["part"]): r["count"] for r in rp.split_half(rows, "id").groupBy("col", "part").count().collect()}
    assert parts == {("a", "train"): 50, ("a", "validation"): 51, ("b", "train"): 200, ("b", "validation"): 200}


def test_answers_are_retried(spark, people):
    def answer(pdf, column):
        raise RuntimeError("down")

    assert {r["label"] for r in labels_from_function(answer)(people, "id", "age").collect()} == {0}


def test_repair_provider_falls_back(spark):
    cells = spark.createDataFrame([(1, "a", "x"), (2, "a", "y")], "id long, col string, dirty string")
    good = repairs_from_function(lambda pdf: pd.Series(["fixed", None]))(cells.coalesce(1)).orderBy("id").collect()
    assert [r["correction"] for r in good] == ["fixed", "null"]

    def broken(pdf):
        raise RuntimeError("down")

    assert [r["correction"] for r in repairs_from_function(broken)(cells).orderBy("id").collect()] == ["x", "y"]


def test_error_types(spark):
    rows = spark.createDataFrame(
        [("null", "a"), ("N/A", "a"), ("12.0 oz.", "12.0"), ("low", "LOW"), ("Bxnn", "Bonn"), ("Rome", "Oslo-Nord")], "d string, t string"
    )
    got = [r[0] for r in rows.select(rp.error_type(F.col("d"), F.col("t"))).collect()]
    assert got == [rp.MISSING_VALUE] * 2 + [rp.FORMATTING_ISSUE] * 2 + [rp.TYPO, rp.FD_VIOLATION]


def test_value_functions(spark):
    rows = spark.createDataFrame([("ounces", "12.0 oz.", "12.0"), ("ounces", "16.0 oz", "16.0"), ("city", "rome", "ROME"), ("odd", "a", "b")], "col string, dirty string, truth string")
    assert rp.choose_value_functions(rows) == {"ounces": "strip_unit", "city": "upper"}


def test_query_tests_functions_on_all_examples(spark, monkeypatch):
    """The query hands on every example of the chosen rows, and its gapped table would let no function pass."""
    from workload import fixtures as fx
    from workload import repair_queries as rq

    choose, seen = rp.choose_value_functions, []
    monkeypatch.setattr(rq.rp, "choose_value_functions", lambda examples: seen.append(examples) or choose(examples))
    sf = "/root/testdata/sf0.001"
    rq.value_function_repair(spark, sf)
    clean = fx.priority_clean(spark, sf)
    every = rp.repair_examples(fx.priority_formatted(clean), clean, rq._chosen(clean), "row_id", ["status", "priority"])
    assert sorted(seen[0].collect()) == sorted(every.collect()) and choose(every) == {"priority": "strip_unit_upper"}
    assert choose(rq._examples(spark, sf)) == {}


def test_value_function_query_repairs_the_gapped_table(spark):
    """The truth of a gap is not known to the query: gaps stay, every other flagged cell is repaired."""
    from workload import fixtures as fx
    from workload import repair_queries as rq

    sf = "/root/testdata/sf0.001"
    got = {r["row_id"]: r["priority"] for r in rq.value_function_repair(spark, sf).collect()}
    clean = {r["row_id"]: r["priority"] for r in fx.priority_clean(spark, sf).collect()}
    assert got == {k: None if k % 13 == 11 else v for k, v in clean.items()}
    assert None in got.values()


def test_vaegain_query_is_fully_trained(spark, monkeypatch):
    from cellsmith.operators.adversarial import VaeGainImputer
    from workload import impute_queries as iq

    made = []
    monkeypatch.setattr(VaeGainImputer, "fit_transform", lambda self, *rows: made.append(self))
    iq.vaegain_impute(spark, "/root/testdata/sf0.001")
    default = VaeGainImputer(iq.C, "row_id")
    assert [(m.batch_size, m.epoch, m.rounds, m.learning_rate) for m in made] == [(default.batch_size, default.epoch, default.rounds, default.learning_rate)]


def test_embedding_is_normalised(spark):
    import math

    rows = spark.createDataFrame([("abc",), (None,), ("abd",)], "v string")
    vectors = [r[0] for r in rows.select(rp.cell_embedding(F.col("v"), 16)).collect()]
    assert all(math.isclose(sum(x * x for x in v), 1.0) for v in vectors)
    assert vectors[0] != vectors[2]


def test_split_is_exact_and_disjoint(spark):
    rows = spark.range(11).select("id", F.lit("c").alias("col"))
    parts = rp.split_half(rows, "id").groupBy("part").count().collect()
    assert {r["part"]: r["count"] for r in parts} == {"train": 5, "validation": 6}


@pytest.fixture
def shop(spark):
    towns = ["Rome", "Oslo", "Lima", "Bonn"]
    rows = [(i, f"z{i % 4}", towns[i % 4], f"{i % 7 + 1}.0") for i in range(120)]
    clean = spark.createDataFrame(rows, "id long, zip string, city string, size string")
    dirty = clean.select(
        "id",
        "zip",
        F.when(F.col("id") % 10 == 3, F.lit("XX")).when(F.col("id") % 10 == 6, F.lit(None)).otherwise(F.col("city")).alias("city"),
        F.when(F.col("id") % 6 == 1, F.concat("size", F.lit(" oz"))).otherwise(F.col("size")).alias("size"),
    )
    mask = clean.select("id", F.lit(0).alias("zip"), (F.col("id") % 10).isin(3, 6).cast("int").alias("city"), (F.col("id") % 6 == 1).cast("int").alias("size"))
    return clean, dirty, mask


def test_corrector(spark, shop, tmp_path):
    clean, dirty, mask = shop
    with pytest.raises(NotFittedError):
        CellCorrector("id").transform(dirty, mask)
    model = CellCorrector("id", n_repair=8, dims=8).fit(dirty, mask, clean)
    out = model.transform(dirty, mask)
    assert sorted(out.collect()) == sorted(clean.collect())
    assert model.decisions["fds"] == {"city": "zip"} and model.decisions["functions"] == {"size": "strip_unit"}
    sources = {r["source"] for r in model.log.select("source").distinct().collect()}
    assert {"value function", "dependency"} <= sources
    model.save(spark, str(tmp_path / "c"))
    assert sorted(CellCorrector.load(spark, str(tmp_path / "c")).transform(dirty, mask).collect()) == sorted(clean.collect())


def test_corrector_falls_back_to_neighbours_and_provider(spark, shop):
    clean, dirty, mask = shop
    plain = CellCorrector("id", n_repair=4, dims=64).fit(dirty, mask, clean)
    plain.decisions["fds"], plain.decisions["functions"] = {}, {}
    plain.decisions["weights"] = {"city": {"zip": 1.0, "city": 1.0}, "size": {"zip": 1.0}}
    out = plain.transform(dirty, mask)
    fixed = repair_accuracy(clean.select("id", "city"), out.select("id", "city"), mask.select("id", "city"), "id").first()
    assert fixed["accuracy"] == 1.0
    plain.repair_provider = repairs_from_function(lambda pdf: pdf["dirty"].str.replace(" oz", ""))
    sizes = plain.transform(dirty, mask).select("id", "size")
    assert sorted(sizes.collect()) == sorted(clean.select("id", "size").collect())
    assert {r["source"] for r in plain.log.filter("col = 'size'").collect()} == {"provider"}


def test_correction_metrics(spark):
    clean = spark.createDataFrame([(1, "a", "b"), (2, "c", "d")], "id long, x string, y string")
    dirty = spark.createDataFrame([(1, "a", "?"), (2, "!", "d")], "id long, x string, y string")
    fixed = spark.createDataFrame([(1, "z", " b "), (2, "!", "d")], "id long, x string, y string")
    mask = spark.createDataFrame([(1, False, True), (2, True, False)], "id long, x boolean, y boolean")
    assert correction_prf(clean, dirty, fixed, mask, "id").first() == (0.5, 0.5, 0.5)
    assert library_prf(clean, dirty, fixed, "id").first() == (0.0, 0.0, 0.0)
    drop = error_drop_rate(dirty, fixed, clean, "id").first()
    assert (drop["wrong_before"], drop["wrong_after"], drop["right_to_wrong"], drop["edr"]) == (2, 3, 1, -0.5)
    assert repair_accuracy(clean, fixed, mask, "id").first() == (1, 2, 0.5)
    none = mask.select("id", F.lit(False).alias("x"), F.lit(False).alias("y"))
    assert correction_prf(clean, dirty, fixed, none, "id").first() == (0.0, 0.0, 0.0)
    labels = spark.createDataFrame([(1, 1), (2, 0)], "id long, label int")
    assert row_prf(labels, labels.withColumn("label", F.lit(0)), "id").first() == (0.0, 0.0, 0.0)


def test_rules_run_on_a_stream(spark, people, tmp_path):
    source, sink = str(tmp_path / "in"), str(tmp_path / "out")
    people.write.parquet(source)
    stream = spark.readStream.schema(people.schema).parquet(source)
    flags = mask_stream(stream, "id", {"age": ["cast(age as int) < 120"]})
    query = flags.writeStream.format("parquet").option("path", sink).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    query.awaitTermination(60)
    assert [r["id"] for r in spark.read.parquet(sink).filter("age").collect()] == [2]


def test_rows_are_spread_before_they_grow(spark, monkeypatch):
    """A table in one partition is embedded and clustered by as many tasks as its rows ask for."""
    from cellsmith import session
    from workload import similarity_queries as sq

    monkeypatch.setattr(session, "TASK_ROWS", 100)
    seen = []
    monkeypatch.setattr(sq, "clean_representatives", lambda rows, *rest: seen.append(rows))
    sq.clean_representatives_query(spark, "/root/testdata/sf0.01")
    assert seen[0].rdd.getNumPartitions() >= 20 and seen[0].count() == 2000


def test_index_entries_are_spread(spark, monkeypatch):
    """Index entries, queries and masked vectors of a table in one partition are embedded by as many tasks as its rows ask for."""
    from cellsmith import session
    from cellsmith.operators import repair as rp
    from workload import fixtures as fx

    monkeypatch.setattr(session, "TASK_ROWS", 100)
    clean = fx.typo_clean(spark, "/root/testdata/sf0.01")
    dirty, mask, columns = fx.typo_dirty(clean), fx.typo_mask(clean), ["name", "brand", "kind"]
    index = rp.retrieval_index(dirty, mask, "row_id", "name", columns)
    assert index.rdd.getNumPartitions() >= 20 and index.count() == 2000
    asked = rp.query_vectors(dirty, mask, "row_id", mask.filter("name"), dict.fromkeys(columns, 1.0))
    assert asked.rdd.getNumPartitions() >= 20 and asked.count() == mask.filter("name").count()
    assert rp.masked_row_vectors(dirty, mask, "row_id", columns).rdd.getNumPartitions() >= 20


def test_ridge_query_hashes_its_rows_once(spark):
    """What fills the gaps reads row ids and gaps that were written before, instead of hashing them again."""
    from workload.impute_queries import ridge_impute

    filled = ridge_impute(spark, "/root/testdata/sf0.001")
    assert "md5" not in filled._jdf.queryExecution().optimizedPlan().toString()


def test_corrector_spreads_rows_before_they_grow(spark, monkeypatch):
    """The corrector embeds a table of few partitions in as many tasks as its rows ask for."""
    from cellsmith import session
    from cellsmith.plans import corrector
    from workload import fixtures as fx

    class Seen(Exception):
        pass

    def look(rows, *rest, **more):
        raise Seen(rows.rdd.getNumPartitions())

    monkeypatch.setattr(session, "TASK_ROWS", 10)
    monkeypatch.setattr(corrector, "clean_representatives", look)
    clean = fx.typo_clean(spark, "/root/testdata/sf0.001").coalesce(1)
    with pytest.raises(Seen) as seen:
        corrector.CellCorrector("row_id").fit(fx.typo_dirty(clean), fx.typo_mask(clean), clean)
    assert seen.value.args[0] == -(-clean.count() // 10) > 4


def test_detectors_spread_rows_before_they_score(spark, monkeypatch):
    """Trees and links of a table in one partition are worked on by as many tasks as its rows ask for."""
    from cellsmith import session
    from cellsmith.plans import compare
    from workload import fixtures as fx

    seen = []

    def watch(operator):
        def run(rows, *rest, **more):
            seen.append(rows.rdd.getNumPartitions())
            return operator(rows, *rest, **more)

        return run

    monkeypatch.setattr(session, "TASK_ROWS", 20)
    monkeypatch.setattr(compare, "isolation_scores", watch(compare.isolation_scores))
    monkeypatch.setattr(compare, "lof_scores", watch(compare.lof_scores))
    clean = fx.typo_clean(spark, "/root/testdata/sf0.001").coalesce(1)
    dirty, mask = fx.typo_dirty(clean), fx.typo_mask(clean)
    got = compare.compare_detectors(dirty, mask, "row_id", {"given": mask}).collect()
    assert seen == [-(-clean.count() // 20)] * 2 and seen[0] > 4
    assert all(r["given"] == 1.0 and 0.0 <= min(r["isolation_forest"], r["lof"]) for r in got)


def test_texts_are_embedded_in_batches(spark):
    """A batch gives what the trigrams of each text give, with empty texts, gaps and letters beyond the first plane."""
    values = ["", "a", "Brand#12", "é€😀x", None, "aaaa"]
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "id int, v string")
    out = rows.select("id", rp.cell_embedding(F.col("v"), 8).alias("vec"))
    assert "ArrowEvalPython" in out._jdf.queryExecution().executedPlan().toString()
    for r in out.collect():
        codes = [ord(c) for c in f"^{'null' if values[r['id']] is None else values[r['id']]}$"]
        counts = [0] * 8
        for at in range(max(len(codes) - 2, 1)):
            three = (codes[at : at + 3] + [0])[:3]
            counts[sum(c * m for c, m in zip(three, rp.GRAM_MIX)) % rp.GRAM_MODULUS % 8] += 1
        assert r["vec"] == [c / sum(c * c for c in counts) ** 0.5 for c in counts]
