import numpy as np
import pytest
from pyspark.sql import functions as F

from cellsmith.operators import adversarial as ad
from cellsmith.operators import impute as im
from cellsmith.operators.evaluate import masked_rmse_mae, norm_rmse_mae
from cellsmith.sources.tables import missing_mask

COLUMNS = ["a", "b", "c"]


def matrix(n=600, seed=0):
    rng = np.random.default_rng(seed)
    a = rng.normal(10, 3, n)
    truth = np.column_stack([a, 2 * a + rng.normal(0, 0.2, n), -a + rng.normal(0, 0.2, n)])
    gaps = truth.copy()
    gaps[rng.uniform(size=truth.shape) < 0.2] = np.nan
    return truth, gaps


def frame(spark, x):
    return spark.createDataFrame([(i, *[None if np.isnan(v) else float(v) for v in r]) for i, r in enumerate(x)], "id long, a double, b double, c double")


def values(df):
    return np.array([[r[c] for c in COLUMNS] for r in df.orderBy("id").collect()], dtype=float)


def row_level_chain(x, rounds, tol=1e-3):
    """The same chained equations on rows, as plain matrices."""
    means, scales = np.nanmean(x, 0), np.nanstd(x, 0)
    z = (x - means) / scales
    gap = np.isnan(z)
    cur = np.where(gap, 0.0, z)
    order = [i for g, i in sorted((gap[:, i].sum(), i) for i in range(x.shape[1])) if g]
    for _ in range(rounds):
        before = cur.copy()
        for t in order:
            others = [i for i in range(x.shape[1]) if i != t]
            seen = ~gap[:, t]
            xs, ys = cur[seen][:, others], cur[seen, t]
            xc, yc = xs - xs.mean(0), ys - ys.mean()
            coef = im.bayesian_ridge(xc.T @ xc, xc.T @ yc, yc @ yc, seen.sum())
            cur[gap[:, t], t] = (cur[gap[:, t]][:, others] - xs.mean(0)) @ coef + ys.mean()
        change = np.sqrt(((cur - before) ** 2).mean(0)) * scales
        if change.max() < tol * np.nanmax(np.abs(x)):
            break
    return np.where(gap, cur * scales + means, x)


def test_nan_is_missing(spark):
    """A table with NaN gives what the same table with NULL gives; forests draw their rows by hash, so nearly so."""
    from cellsmith.operators.fill import knn_fill

    _, gaps = matrix(60)
    nulls = frame(spark, gaps)
    nans = spark.createDataFrame([(i, *[float(v) for v in r]) for i, r in enumerate(gaps)], "id long, a double, b double, c double")
    for fill in (
        lambda df: im.ChainedRidge(COLUMNS).fit_transform(df),
        lambda df: im.ChainedForest(COLUMNS, max_iter=1, trees=2).fit_transform(df),
        lambda df: knn_fill(df, "id", COLUMNS, 3),
    ):
        got = values(fill(nans))
        assert not np.isnan(got).any() and np.allclose(got, values(fill(nulls)), atol=0.5)


def test_forest_ignores_the_layout(spark):
    """One, four or eight partitions, another order, NaN or NULL, and a third of the rows equal: the same fills."""
    _, gaps = matrix(240, 8)
    gaps[160:] = gaps[1]
    gaps[160:, 0] = np.nan
    nulls = frame(spark, gaps)
    nans = spark.createDataFrame([(i, *[float(v) for v in r]) for i, r in enumerate(gaps)], "id long, a double, b double, c double")
    forest = lambda df: values(im.ChainedForest(COLUMNS, max_iter=2, trees=3, depth=5).fit_transform(df))
    want = forest(nulls.coalesce(1))
    for other in (nulls.repartition(4), nulls.repartition(8).orderBy(F.desc("id")), nans.repartition(8, "b"), nans.coalesce(1)):
        assert np.allclose(forest(other), want, atol=1e-9)


def test_ridge_equals_row_level_chain(spark):
    truth, gaps = matrix()
    rows = frame(spark, gaps)
    model = im.ChainedRidge(COLUMNS).fit(rows)
    got = values(model.transform(rows))
    assert np.allclose(got, row_level_chain(gaps, 10), atol=1e-6)
    seen = ~np.isnan(gaps)
    assert (got[seen] == gaps[seen]).all() and not np.isnan(got).any()
    mean = np.where(seen, gaps, np.nanmean(gaps, 0))
    assert np.sqrt(((got - truth)[~seen] ** 2).mean()) < 0.3 * np.sqrt(((mean - truth)[~seen] ** 2).mean())


def test_ridge_slices_and_partitions(spark, monkeypatch):
    _, gaps = matrix(200, 3)
    rows = frame(spark, gaps)
    want = values(im.ChainedRidge(COLUMNS).fit_transform(rows))
    assert np.allclose(values(im.ChainedRidge(COLUMNS).fit_transform(rows.repartition(7))), want, atol=1e-8)
    monkeypatch.setattr(im, "PATTERNS", 1)
    assert np.allclose(values(im.ChainedRidge(COLUMNS).fit_transform(rows)), want, atol=1e-8)


def test_ridge_save_load_and_guard(spark, tmp_path):
    _, gaps = matrix(100, 4)
    rows = frame(spark, gaps)
    with pytest.raises(im.NotFittedError):
        im.ChainedRidge(COLUMNS).transform(rows)
    model = im.ChainedRidge(COLUMNS).fit(rows)
    model.save(spark, str(tmp_path / "m"))
    assert np.allclose(values(im.ChainedRidge.load(spark, str(tmp_path / "m")).transform(rows)), values(model.transform(rows)))


def test_forest(spark, tmp_path):
    truth, gaps = matrix(300, 5)
    rows = frame(spark, gaps)
    with pytest.raises(im.NotFittedError):
        im.ChainedForest(COLUMNS).transform(rows)
    model = im.ChainedForest(COLUMNS, max_iter=2, trees=5, depth=6).fit(rows)
    got, seen = values(model.transform(rows)), ~np.isnan(gaps)
    assert (got[seen] == gaps[seen]).all() and not np.isnan(got).any()
    mean = np.where(seen, gaps, np.nanmean(gaps, 0))
    assert ((got - truth)[~seen] ** 2).mean() < 0.5 * ((mean - truth)[~seen] ** 2).mean()
    model.save(spark, str(tmp_path / "f"))
    assert np.allclose(values(im.ChainedForest.load(spark, str(tmp_path / "f")).transform(rows)), got)


def test_forest_grows_on_cells(spark, monkeypatch):
    """Trees see the cells of the bins, not the rows; they are those of the drawn rows, and lookups give what the trees give."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import RandomForestRegressor

    rng = np.random.default_rng(9)
    a, b = rng.integers(0, 6, 2000), rng.integers(0, 5, 2000)
    gaps = np.column_stack([a, b, a * 2.0 + b + rng.normal(0, 1, 2000)]).astype(float)
    gaps[rng.uniform(size=2000) < 0.2, 2] = np.nan
    rows, sizes, fit = frame(spark, gaps), [], im.RandomForestRegressor.fit
    monkeypatch.setattr(im.RandomForestRegressor, "fit", lambda self, df: (sizes.append(df.count()), fit(self, df))[1])
    model = im.ChainedForest(COLUMNS, max_iter=1, trees=2, depth=4).fit(rows)
    got = values(model.transform(rows))
    assert len(sizes) == 2 and max(sizes) <= 30
    monkeypatch.setattr(im, "GRID_CELLS", 0)
    assert np.allclose(values(model.transform(rows)), got, atol=1e-9)

    numbers = rows.select(*[F.when(~F.isnan(c), F.col(c)).alias(f"_c{i}") for i, c in enumerate(COLUMNS)])
    drawn = im.dealt_by_content(numbers, 2000).filter("_c2 is not null").withColumn("times", im.poisson_draws(F.col("_row"), 2, 42)[0])
    opened = drawn.select("*", F.explode(F.array_repeat(F.lit(1), F.col("times"))))
    assert 0.9 < opened.count() / drawn.count() < 1.1
    fed = VectorAssembler(inputCols=["_c0", "_c1"], outputCol="x")
    want = fit(
        RandomForestRegressor(numTrees=1, bootstrap=False, featureSubsetStrategy="all", maxDepth=4, featuresCol="x", labelCol="_c2"),
        fed.transform(opened),
    )
    monkeypatch.setattr(im, "GRID_CELLS", 1 << 16)
    all_inputs = im.ChainedForest(COLUMNS, max_iter=1, trees=1, depth=4).fit(rows)
    lacking = np.isnan(gaps[:, 2])
    filled = fed.transform(numbers.filter("_c2 is null"))
    expect = sorted((r["_c0"], r["_c1"], round(r["prediction"], 9)) for r in want.transform(filled).collect())
    found = values(all_inputs.transform(rows))[lacking]
    assert sorted((r[0], r[1], round(r[2], 9)) for r in found) == expect


def test_sample_is_exact_and_stable(spark):
    rows = spark.range(5000)
    got = {r[0] for r in im.seeded_sample(rows, "id", 300, 1).collect()}
    assert len(got) == 300 == len(im.batch_sample(rows, "id", 300, 1).collect())
    assert got == {r[0] for r in im.seeded_sample(rows.repartition(9), "id", 300, 1).collect()}
    assert im.seeded_sample(rows, "id", 9000, 1).count() == 5000


def test_blend(spark):
    seen = spark.createDataFrame([(1, 1.0, None), (2, None, 4.0)], "id long, a double, b double")
    made = spark.createDataFrame([(1, 9.0, 8.0), (2, 7.0, 6.0)], "id long, a double, b double")
    assert sorted(im.blend(seen, made, "id", ["a", "b"]).collect()) == [(1, 1.0, 8.0), (2, 7.0, 4.0)]


MODELS = {
    "gain": lambda: ad.GainImputer(COLUMNS, "id", batch_size=64, epoch=1500, rounds=3, blocks=2),
    "vaegain": lambda: ad.VaeGainImputer(COLUMNS, "id", batch_size=16, epoch=10, rounds=2),
    "sampled_gain": lambda: ad.SampledGainImputer(COLUMNS, "id", batch_size=64, epoch=40, rounds=2, initial_value=200),
}


@pytest.mark.parametrize("kind", MODELS)
def test_adversarial_contract(spark, tmp_path, kind):
    truth, gaps = matrix(500, 6)
    rows = frame(spark, gaps)
    with pytest.raises(im.NotFittedError):
        MODELS[kind]().transform(rows)
    model = MODELS[kind]().fit(rows)
    got, seen = values(model.transform(rows)), ~np.isnan(gaps)
    assert got.shape == gaps.shape and not np.isnan(got).any()
    assert (got[seen] == gaps[seen]).all()
    assert np.allclose(values(model.transform(rows.repartition(5))), got)
    assert np.allclose(values(MODELS[kind]().fit(rows.repartition(3)).transform(rows)), got, atol=1e-5)
    model.save(spark, str(tmp_path / kind))
    assert np.allclose(values(type(model).load(spark, str(tmp_path / kind)).transform(rows)), got)
    if kind == "gain":
        mean = np.where(seen, gaps, np.nanmean(gaps, 0))
        assert ((got - truth)[~seen] ** 2).mean() < ((mean - truth)[~seen] ** 2).mean()
    if kind == "sampled_gain":
        assert 200 <= model.sample_size <= 500 and model.search


def test_supplied_mask_is_honoured(spark):
    _, gaps = matrix(120, 7)
    rows = frame(spark, gaps)
    mask = missing_mask(rows, "id", COLUMNS).withColumn("a", F.when(F.col("id") == 0, 0).otherwise(F.col("a")))
    out = ad.GainImputer(COLUMNS, "id", epoch=20, rounds=2, blocks=1).fit_transform(rows, mask).filter("id = 0").first()
    assert out["a"] is not None and out["a"] != gaps[0, 0]


def test_network_gradients():
    rng = np.random.default_rng(0)
    sizes = [3, 4, 5, 2]
    w, x, pull = ad.xavier(sizes, rng), rng.normal(size=(6, 3)), rng.normal(size=(6, 2))
    w = w + rng.normal(0, 0.3, len(w))  # off the kinks at zero
    out, trace = ad.forward(w, sizes, x)
    assert out.shape == (6, 2)
    grad, back = ad.backward(w, sizes, trace, pull)
    for i in range(0, len(w), 5):
        step = np.zeros_like(w)
        step[i] = 1e-6
        slope = ((ad.forward(w + step, sizes, x)[0] - ad.forward(w - step, sizes, x)[0]) * pull).sum() / 2e-6
        assert grad[i] == pytest.approx(slope, abs=1e-5)
    moved = x.copy()
    moved[0, 0] += 1e-6
    assert back[0, 0] == pytest.approx(((ad.forward(w, sizes, moved)[0] - out) * pull).sum() / 1e-6, abs=1e-4)


def test_transport_and_curvature():
    rng = np.random.default_rng(1)
    x, y = rng.uniform(size=(16, 3)), rng.uniform(size=(16, 3))
    far = ad.sinkhorn_distance(x, y + 3)
    assert np.isfinite(far) and far > ad.sinkhorn_distance(x, y) > 0
    plan, _ = ad.sinkhorn_plan(x, y, rounds=200)
    assert np.allclose(plan.sum(1), 1 / 16, atol=1e-6) and np.allclose(plan.sum(0), 1 / 16, atol=1e-6)
    g = rng.normal(size=7)
    assert np.allclose(ad.curvature_inverse(g), np.diag(np.linalg.inv(np.outer(g, g) + np.eye(7))))


def test_transport_by_factors_equals_the_log_plan(monkeypatch):
    rng = np.random.default_rng(2)
    x, y = rng.uniform(size=(20, 3)), rng.uniform(size=(30, 3))
    by_factors = ad.sinkhorn_plan(x, y)
    monkeypatch.setattr(ad, "FLAT", 0.0)
    by_logs = ad.sinkhorn_plan(x, y)
    assert np.allclose(by_factors[0], by_logs[0], rtol=1e-12) and np.allclose(by_factors[1], by_logs[1])


@pytest.mark.parametrize("kind", ["gain", "sampled", "vaegain"])
def test_blocks_of_a_stack_do_not_touch_each_other(kind):
    """A block ends with the same weights alone and beside others of other sizes, also below a batch."""
    model = ad.VaeGainImputer(COLUMNS, "id") if kind == "vaegain" else ad.GainImputer(COLUMNS, "id", batch_size=32)
    d = len(COLUMNS)
    local = model._local(3) if kind == "vaegain" else model._local(3, kind == "sampled", (2.0, 3.0) if kind == "sampled" else None)
    rng = np.random.default_rng(1)
    ms = [(rng.random((n, d)) > 0.3).astype(float) for n in (100, 5, 70, 33)]
    xs = [m * rng.random(m.shape) for m in ms]
    width = sum([3 * ad.weight_count(s) if k == "dis" else 2 * ad.weight_count(s) for k, s in model.nets.items()]) if kind == "vaegain" else len(model._initial())
    start = np.zeros(width)
    start[: width // 3] = rng.normal(size=width // 3) * 0.1
    draws = lambda ks: [np.random.default_rng([7, k]) for k in ks]
    together = np.tile(start, (4, 1))
    local(1)(together, xs, ms, draws(range(4)))
    for k in range(4):
        alone = start[None].copy()
        local(1)(alone, [xs[k]], [ms[k]], draws([k]))
        assert np.allclose(alone[0], together[k], rtol=1e-9, atol=1e-12) and not np.allclose(alone[0], start)


def test_few_blocks_share_tasks(spark):
    """Blocks of one task are stepped together, so there are no more tasks than cores while tasks are small."""
    rows = spark.range(400).select(F.xxhash64("id").alias("h"), F.array(F.rand(1)).alias("x"), F.array(F.lit(1.0)).alias("m"))
    packed = ad.pack_blocks(rows, 16, seed=1)
    assert packed.rdd.getNumPartitions() <= spark.sparkContext.defaultParallelism
    assert packed.agg(F.sum("n")).first()[0] == 400


def test_batch_transport(spark):
    truth, gaps = matrix(300, 8)
    out = ad.batch_transport(frame(spark, truth), frame(spark, truth), "id", COLUMNS, batch=64)
    worse = ad.batch_transport(frame(spark, truth), frame(spark, truth + 20), "id", COLUMNS, batch=64)
    assert out.agg(F.sum("rows")).first()[0] == 300
    assert out.agg(F.avg("distance")).first()[0] < worse.agg(F.avg("distance")).first()[0]


def test_transport_moves_each_table_once(spark):
    """One shuffle of numbers and hashes a table, whatever the keys: equal keys meet as in a join, NULL keys meet nothing."""
    truth, _ = matrix(200, 8)
    names = [c for c in COLUMNS]
    left = frame(spark, truth).withColumn("id", F.when(F.col("id") == 7, F.lit(8)).when(F.col("id") != 9, F.col("id")))
    right = frame(spark, truth + 1).withColumn("id", F.when(F.col("id") == 7, F.lit(8)).when(F.col("id") != 9, F.col("id")))
    out = ad.batch_transport(left, right, "id", names, batch=16)
    assert out._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 2
    sizes = left.join(right.select("id"), "id").groupBy(F.pmod(F.xxhash64("id"), F.lit(13)).cast("int").alias("batch")).count()
    assert {r["batch"]: r["rows"] for r in out.collect()} == {r["batch"]: r["count"] for r in sizes.collect()}


def test_large_inputs_stay_where_they_are(spark):
    from cellsmith.session import spread

    cores = spark.sparkContext.defaultParallelism
    even = spark.range(0, 800, 1, 2 * cores)
    assert "Exchange" not in spread(even)._jdf.queryExecution().executedPlan().toString()
    assert spread(spark.range(0, 800, 1, 1)).rdd.getNumPartitions() == cores
    assert spread(even.filter("id < 50")).rdd.getNumPartitions() == cores


def test_scores(spark):
    truth, gaps = matrix(50, 9)
    rows = frame(spark, truth)
    mask = missing_mask(frame(spark, gaps), "id", COLUMNS)
    hole = np.isnan(gaps)
    off = frame(spark, truth + 0.5)
    assert masked_rmse_mae(rows, off, mask, "id").first() == (pytest.approx(0.5), pytest.approx(0.5), hole.sum())
    whole = missing_mask(rows, "id", COLUMNS)
    assert masked_rmse_mae(rows, off, whole, "id").first()[:2] == (0.0, 0.0)
    assert norm_rmse_mae(rows, off, mask, "id").first()["rmse"] == pytest.approx(0.0, abs=1e-9)
    with pytest.raises(ValueError):
        masked_rmse_mae(rows, off.drop("a"), mask, "id")


def test_scores_beside_the_cells_move_no_row(spark):
    from cellsmith.operators.impute import ChainedRidge

    truth, gaps = matrix(60, 9)
    known = frame(spark, truth).select("id", F.struct(*COLUMNS).alias("_truth"))
    wide = missing_mask(frame(spark, gaps).join(known, "id"), "id", COLUMNS, "_mask")
    wide = spark.createDataFrame(wide.collect(), wide.schema)
    model = ChainedRidge(COLUMNS).fit(frame(spark, gaps))
    score = masked_rmse_mae("_truth", model.transform(wide), "_mask", "id")
    assert "Join" not in score._jdf.queryExecution().executedPlan().toString()
    joined = masked_rmse_mae(frame(spark, truth), model.transform(frame(spark, gaps)), missing_mask(frame(spark, gaps), "id", COLUMNS), "id")
    assert tuple(score.first()) == pytest.approx(tuple(joined.first()))


def test_scores_hash_keys_once(spark, monkeypatch):
    """What the imputers and scores read has its row ids and gaps already computed."""
    from workload import impute_queries as iq

    seen = []
    monkeypatch.setattr(iq, "compare_imputers", lambda truth, gaps, *rest: seen.extend([truth, gaps]) or spark.createDataFrame([("rmse",), ("mae",)], "metric string"))
    iq.impute_scores(spark, "/root/testdata/sf0.001")
    assert [t._jdf.queryExecution().optimizedPlan().toString().count("md5(") for t in seen] == [0, 0]
