import numpy as np
import pytest
from pyspark.sql import functions as F

from cellsmith.operators.cluster import elbow_costs, eps_components, hierarchical_clusters, knee, medoids, nearest_to_mean, propagate_labels, repair_candidates, clean_representatives
from cellsmith.operators.components import connected_components
from cellsmith.operators import detect
from cellsmith.operators.detect import cut_by_share, isolation_scores, lof_scores
from cellsmith.operators import bands, cluster, lookup
from cellsmith.operators.fill import baseline_correct, column_modes, knn_fill
from cellsmith.operators import metric
from cellsmith.operators.similarity import knn_join


def points(seed, n, d, hot=0.0):
    """n points, a share of them copies of one vector."""
    rng = np.random.default_rng(seed)
    x = np.round(rng.normal(size=(n, d)), 3)
    x[: int(n * hot)] = x[0]
    return x


def frame(spark, x):
    return spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], "id long, vec array<double>")


def brute(q, x, k, skip_self=False):
    out = {}
    for i, row in enumerate(q):
        d = np.round(((x - row) ** 2).sum(1), 9)
        order = [j for j in np.lexsort((np.arange(len(x)), d)) if not (skip_self and j == i)]
        out[i] = [(int(j), float(d[j])) for j in order[:k]]
    return out


def collected(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r["qid"], r["rank"])):
        out.setdefault(r["qid"], []).append((r["iid"], r["d2"]))
    return out


@pytest.mark.parametrize("hot,rows,d", [(0.0, 2048, 3), (0.4, 2048, 3), (0.4, 16, 2), (0.0, 16, 8)])
def test_knn_join_matches_brute_force(spark, hot, rows, d):
    x = points(3, 150, d, hot)
    q = points(4, 60, d)
    got = collected(knn_join(frame(spark, q), frame(spark, x), 5, d, rows=rows))
    assert got.keys() == brute(q, x, 5).keys()
    for i, want in brute(q, x, 5).items():
        assert [a for a, _ in got[i]] == [a for a, _ in want]
        assert [b for _, b in got[i]] == pytest.approx([b for _, b in want])


@pytest.mark.parametrize("rows", [2048, 16])
def test_knn_join_without_self(spark, rows):
    x = points(5, 90, 3, 0.35)
    got = collected(knn_join(frame(spark, x), frame(spark, x), 4, 3, exclude_self=True, rows=rows))
    assert {i: [a for a, _ in v] for i, v in got.items()} == {i: [a for a, _ in v] for i, v in brute(x, x, 4, True).items()}


def test_knn_join_small_index(spark):
    x = points(6, 3, 2)
    assert all(len(v) == 3 for v in collected(knn_join(frame(spark, points(7, 9, 2)), frame(spark, x), 5, 2)).values())


def components(x, eps):
    n = len(x)
    near = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2)) <= eps
    label = list(range(n))
    changed = True
    while changed:
        changed = False
        for i in range(n):
            low = min(label[j] for j in range(n) if near[i, j])
            if low < label[i]:
                label[i], changed = low, True
    return {i: (label[i] if label.count(label[i]) > 1 else -1) for i in range(n)}


@pytest.mark.parametrize("hot", [0.0, 0.35])
def test_eps_components_match_brute_force(spark, hot):
    x = points(8, 120, 2, hot)
    got = {r["id"]: r["cluster"] for r in eps_components(frame(spark, x), "id", 0.2).collect()}
    assert got == components(x, 0.2)


def test_connected_components_chain_and_hub(spark):
    chain = [(i, i + 1) for i in range(40)]
    hub = [(100, i) for i in range(101, 160)]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(chain + hub, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(41)) and all(got[i] == 100 for i in range(100, 160))


def test_components_and_labels_of_a_hub(spark, monkeypatch):
    """A third of all nodes hangs on one hub and most rows are in one cluster, with lookups too large to broadcast."""
    monkeypatch.setattr(lookup, "BROADCAST_ROWS", 1)
    monkeypatch.setattr(lookup, "HOT_KEYS", 2)
    hub = [(0, i) for i in range(1, 300)]
    pairs = [(1000 + 2 * i, 1001 + 2 * i) for i in range(300)]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(hub + pairs, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(300)} | {n: a for a, b in pairs for n in (a, b)}
    members = spark.range(600).select("id", F.when(F.col("id") % 3 < 2, 0).otherwise(F.col("id")).alias("cluster"))
    chosen = members.groupBy("cluster").agg(F.min("id").alias("representative"))
    labels = spark.createDataFrame([(0, "hot"), (5, "five"), (8, None)], "id long, label string")
    out = propagate_labels(members, chosen, labels, "id").collect()
    assert {r["id"]: r["label"] for r in out} == {i: "hot" for i in range(600) if i % 3 < 2} | {5: "five", 8: None}


def test_medoid_matches_brute_force(spark):
    x = points(9, 130, 3, 0.3)
    weights = np.random.default_rng(1).integers(1, 5, len(x))
    rows = spark.createDataFrame(
        [(i, [float(v) for v in r], int(i % 3), int(weights[i])) for i, r in enumerate(x)], "id long, vec array<double>, cluster int, w int"
    )
    got = {r["cluster"]: r["representative"] for r in medoids(rows, "id", weight="w").collect()}
    for c in range(3):
        ids = [i for i in range(len(x)) if i % 3 == c]
        totals = [(round(float((np.sqrt(((x[ids] - x[i]) ** 2).sum(1)) * weights[ids]).sum()), 6), i) for i in ids]
        assert got[c] == min(totals)[1]
    near = {r["cluster"]: r["representative"] for r in nearest_to_mean(rows, "id", weight="w").collect()}
    for c in range(3):
        ids = [i for i in range(len(x)) if i % 3 == c]
        mean = (x[ids] * weights[ids, None]).sum(0) / weights[ids].sum()
        assert near[c] == min((round(float(np.sqrt(((x[i] - mean) ** 2).sum())), 9), i) for i in ids)[1]


@pytest.mark.parametrize("n", [3000, 300])
def test_medoid_rules_most_members_out(spark, monkeypatch, n):
    """Rounds of exact sums leave few members of two large clusters for the blocks, and never the medoid; the small table
    meets its rounds by shuffle."""
    if n == 300:
        monkeypatch.setattr(metric, "LEVEL_BYTES", 0)
        monkeypatch.setattr(cluster, "ROUNDS", 2)
    x = points(31, n, 2)
    rows = frame(spark, x).withColumn("cluster", F.concat(F.lit("c"), F.col("id") % 2))
    codes = [F.xxhash64(F.lit(i), "cluster").alias(c) for i, c in enumerate(("space", "node"))]
    base = rows.select(*codes, F.col("cluster").alias("c"), "id", "vec", F.lit(1.0).alias("w"))
    scored, left = cluster.rule_out(base, 2)
    assert scored.count() <= 2 * cluster.SCORED * cluster.ROUNDS and left.count() < (0.1 if n == 3000 else 1) * n
    got = {r["cluster"]: (r["representative"], r["total_distance"]) for r in medoids(rows, "id").collect()}
    for c in range(2):
        ids = np.arange(c, n, 2)
        totals = np.sqrt(((x[ids][:, None] - x[ids][None]) ** 2).sum(2)).sum(1).round(6)
        assert got[f"c{c}"][0] == ids[totals.argmin()] and got[f"c{c}"][1] == pytest.approx(totals.min())


def test_knee():
    assert knee([100, 30, 10, 9, 8, 7, 6.5, 6, 5.8, 5.7]) == 3
    assert knee([5.0, 5.0, 5.0]) == 1 and knee([3.0]) == 1


def test_hierarchical_clusters_split_groups(spark):
    x = np.vstack([points(1, 30, 2) * 0.05, points(2, 30, 2) * 0.05 + 5])
    got = hierarchical_clusters(frame(spark, x), 2).collect()
    groups = [{r["cluster"] for r in got if (r["id"] < 30) == side} for side in (True, False)]
    assert len(groups[0]) == len(groups[1]) == 1 and groups[0] != groups[1]


def test_lof_and_isolation_rank_outliers_high(spark):
    x = points(11, 200, 2)
    x[7], x[8] = [9, 9], [-8, 7]
    rows = frame(spark, x)
    lof = {r["id"]: r["score"] for r in lof_scores(rows, "id", 2).collect()}
    wide = rows.select("id", F.col("vec")[0].alias("a"), F.col("vec")[1].alias("b"))
    iso = isolation_scores(wide, "id", ["a", "b"])
    forest = {r["id"]: r["score"] for r in iso.collect()}
    for scores in (lof, forest):
        top = sorted(scores, key=scores.get)[-2:]
        assert set(top) == {7, 8}
    assert {r["id"] for r in cut_by_share(iso, "id", 0.01).filter("label = 1").collect()} == {7, 8}
    again = {r["id"]: r["score"] for r in isolation_scores(wide.repartition(3), "id", ["a", "b"]).collect()}
    assert again == forest


def test_lof_matches_brute_force(spark):
    x = points(12, 60, 3)
    k = 5
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    near = [sorted((j for j in range(60) if j != i), key=lambda j: (round(d[i, j] ** 2, 9), j))[:k] for i in range(60)]
    kd = [max(d[i, j] for j in near[i]) for i in range(60)]
    lrd = [1 / (np.mean([max(kd[j], d[i, j]) for j in near[i]]) + 1e-10) for i in range(60)]
    want = [np.mean([lrd[j] for j in near[i]]) / lrd[i] for i in range(60)]
    got = {r["id"]: r["score"] for r in lof_scores(frame(spark, x), "id", 3, neighbours=k).collect()}
    assert [got[i] for i in range(60)] == pytest.approx(want, rel=1e-6)


def test_lof_of_copies_matches_brute_force(spark, monkeypatch):
    """Copies beyond the nearest ones have one list of neighbours, told once: the links do not grow with the copies."""
    x = np.repeat(points(13, 12, 2), [1, 2, 3, 4, 5, 6, 7, 40, 1, 1, 60, 25], axis=0)[np.random.default_rng(13).permutation(155)]
    n, k, kinds = len(x), 5, 12
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    near = [sorted((j for j in range(n) if j != i), key=lambda j: (round(d[i, j] ** 2, 9), j))[:k] for i in range(n)]
    kd = [max(d[i, j] for j in near[i]) for i in range(n)]
    lrd = [1 / (np.mean([max(kd[j], d[i, j]) for j in near[i]]) + 1e-10) for i in range(n)]
    want = [np.mean([lrd[j] for j in near[i]]) / lrd[i] for i in range(n)]
    held, keep = [], detect.checkpointed
    monkeypatch.setattr(detect, "checkpointed", lambda df: held.append(keep(df)) or held[-1])
    rows = lof_scores(frame(spark, x), "id", 2, neighbours=k).collect()
    got = {r["id"]: r["score"] for r in rows}
    assert len(rows) == n and [got[i] for i in range(n)] == pytest.approx(want, rel=1e-6)
    links = [h.count() for h in held if "dist" in h.columns]
    assert links and max(links) <= kinds * (k + 2) * k < n * k


def plain_fill(x, k=5):
    """Every row against every other."""
    want, d = x.copy(), x.shape[1]
    for i, t in zip(*np.nonzero(np.isnan(x))):
        near = []
        for j in range(len(x)):
            both = ~np.isnan(x[i]) & ~np.isnan(x[j])
            if not np.isnan(x[j, t]) and both.any():
                near.append((round(d / both.sum() * ((x[i] - x[j])[both] ** 2).sum(), 6), j))
        best = [j for _, j in sorted(near)[:k]]
        want[i, t] = np.mean([x[j, t] for j in best]) if best else np.nanmean(x[:, t])
    return want


@pytest.mark.parametrize("leaf,shared", [(2048, True), (8, True), (8, False)])
@pytest.mark.parametrize("d", [3, 5])
def test_knn_fill_matches_brute_force(spark, monkeypatch, leaf, shared, d):
    """Any pattern of gaps, rows without any cell, ties, and a third of the rows equal."""
    monkeypatch.setattr(bands.build_tree, "__defaults__", (leaf,))
    monkeypatch.setattr(bands.nearest_donors, "__defaults__", (leaf,))
    if not shared:
        monkeypatch.setattr(metric, "LEVEL_BYTES", 0)
    rng = np.random.default_rng(13)
    x = np.round(rng.normal(size=(90, d)), 1) * [1, 1, 10, 0.1, 1][:d]
    x[rng.uniform(size=x.shape) < 0.25] = np.nan
    x[0] = np.nan
    x[60:] = x[7]
    x[60:, 0] = np.nan
    names = list("abcde")[:d]
    rows = spark.createDataFrame([(i, *[None if np.isnan(v) else float(v) for v in r]) for i, r in enumerate(x)], "id long, " + ", ".join(f"{c} double" for c in names))
    got = {r["id"]: [r[c] for c in names] for r in knn_fill(rows, "id", names).collect()}
    assert np.allclose([got[i] for i in range(len(x))], plain_fill(x))


def test_knn_fill_visits_few_leaves(spark):
    """The leaves that a row with a gap is sent to do not grow with the rows."""
    sent = {}
    for n in (1000, 8000):
        x = spark.range(n).select(F.col("id").alias("iid"), F.array(*[F.round(100 * F.rand(i), 4) for i in (1, 2)], F.when(F.col("id") % 10 > 0, F.rand(3))).alias("x"))
        leaves, levels = bands.build_tree(x, 3, 32)
        assert len(levels) >= 2 and leaves.count() == n
        asked = leaves.filter(F.get("x", F.lit(2)).isNull()).select("space", F.lit(0).cast("bigint").alias("node"), F.col("iid").alias("qid"), "x", F.lit(3e4 / n).alias("radius"))
        near = bands._descend(asked, levels, 3, asked.schema["qid"].dataType, False)
        sent[n] = near.count() / asked.count()
    assert sent[8000] < 1.5 * sent[1000] and sent[8000] < 20


def test_mode_ties_take_the_smallest(spark):
    rows = spark.createDataFrame([("b", 10, 2.5), ("a", 9, 1.5), ("b", 9, None), ("a", 10, 2.5), (None, None, 1.5)], "s string, i int, f double")
    assert column_modes(rows, ["s", "i", "f"]) == {"s": "a", "i": 9, "f": 1.5}


def test_baseline_knn_decodes_texts(spark):
    dirty = spark.createDataFrame([(i, "lo" if i < 10 else "hi", float(i)) for i in range(20)], "id long, s string, v double")
    mask = dirty.select("id", (F.col("id") == 3).alias("s"), F.lit(False).alias("v"))
    got = {r["id"]: r["s"] for r in baseline_correct(dirty, mask, "id", "knn").collect()}
    assert got[3] == "lo" and got[15] == "hi"


def test_repair_candidates_cover_columns(spark):
    flags = [(1, 0, 0), (1, 0, 0), (0, 1, 0), (0, 1, 1), (0, 0, 0)]
    mask = spark.createDataFrame([(i, *[bool(v) for v in f]) for i, f in enumerate(flags)], "id long, a boolean, b boolean, c boolean")
    vectors = spark.createDataFrame([(i, [float(v) * 10 for v in f]) for i, f in enumerate(flags)], "id long, vec array<double>")
    chosen = [r["id"] for r in repair_candidates(vectors, mask, "id", 2).orderBy("position").collect()]
    assert len(chosen) == 2 and set().union(*[{k for k, v in enumerate(flags[i]) if v} for i in chosen]) == {0, 1, 2}
    assert {r["id"] for r in clean_representatives(vectors, mask, "id", 3).collect()} == {4}


def test_fewer_distinct_points_than_clusters(spark):
    x = np.array([[0.0, 1.0]] * 30 + [[1.0, 0.0]] * 30)
    mask = spark.range(60).select("id", (F.col("id") < 30).alias("a"), (F.col("id") >= 30).alias("b"))
    assert {r["id"] for r in repair_candidates(frame(spark, x), mask, "id", 10).collect()} == {0, 30}
    none = mask.select("id", F.lit(False).alias("a"), F.lit(False).alias("b"))
    assert 1 <= clean_representatives(frame(spark, x), none, "id", 10).count() <= 10
    assert len(elbow_costs(frame(spark, x))) == 10


def test_empty_points(spark):
    none = frame(spark, np.empty((0, 2)))
    assert eps_components(none, "id").collect() == []
    clustered = hierarchical_clusters(none, 3)
    assert nearest_to_mean(clustered, "id").collect() == [] and medoids(clustered, "id").collect() == []


@pytest.mark.parametrize("shared", [True, False])
def test_index_levels_and_copies(spark, monkeypatch, shared):
    """A deep tree gives the same neighbours, and the leaves a query is sent to do not grow with the rows."""
    monkeypatch.setattr(metric, "FAN", 8)
    if not shared:
        monkeypatch.setattr(metric, "LEVEL_BYTES", 0)
    sent = {}
    for n in (400, 1600):
        x = points(21, n, 2)
        rows = frame(spark, x).withColumnRenamed("id", "iid").withColumn("space", F.lit(0).cast("bigint"))
        tree = metric.build_index(rows, 2, rows=16)
        assert len(tree.levels) >= 2 and tree.leaves.count() == n
        near = metric.leaves_within(tree, rows.withColumnRenamed("iid", "qid"), F.lit(3.0 / n**0.5))
        sent[n] = near.count() / n
    assert sent[1600] < 1.5 * sent[400] and sent[1600] < 20
    got = collected(knn_join(frame(spark, x[:50]), frame(spark, x), 4, 2, rows=16))
    assert {i: [a for a, _ in v] for i, v in got.items()} == {i: [a for a, _ in v] for i, v in brute(x[:50], x, 4).items()}


def test_index_keeps_spaces_apart(spark):
    x = points(22, 80, 2)
    rows = frame(spark, x).withColumn("space", F.col("id") % 3)
    got = collected(knn_join(rows, rows, 3, 2, rows=8))
    for i in range(80):
        own = [j for j in range(80) if j % 3 == i % 3]
        assert [a for a, _ in got[i]] == [own[j] for j, _ in brute(x[[i]], x[own], 3)[0]]


@pytest.mark.parametrize("eps", [0.05, 0.3, 1.0])
def test_eps_components_of_dense_cells(spark, eps):
    """Groups so tight that cells hold many points, with gaps of about eps that only their outer members bridge."""
    rng = np.random.default_rng(4)
    centres = np.array([[0, 0], [1.22 * eps, 0], [2.5 * eps, 0.1 * eps], [0, 1.3 * eps], [9, 9], [9, 9 + 1.6 * eps]])
    x = np.vstack([c + rng.uniform(-0.2 * eps, 0.2 * eps, size=(30, 2)) for c in centres] + [[[20.0, 20.0]]])
    got = {r["id"]: r["cluster"] for r in eps_components(frame(spark, x), "id", eps).collect()}
    assert got == components(x, eps)


def test_eps_components_of_one_dense_place(spark):
    """A million distinct points in one cell, a chain that leaves it, and noise."""
    dense = spark.range(1_000_000).select("id", F.array((F.col("id") % 1000) * 1e-5, F.floor(F.col("id") / 1000) * 1e-5).alias("vec"))
    chain = [(1_000_000 + i, [0.01 + 0.4 * (i + 1), 0.0]) for i in range(5)] + [(2_000_000, [50.0, 50.0])]
    rows = dense.unionByName(spark.createDataFrame(chain, "id long, vec array<double>"))
    sizes = {r["cluster"]: r["count"] for r in eps_components(rows, "id", 0.5).groupBy("cluster").count().collect()}
    assert sizes == {0: 1_000_005, -1: 1}


def test_searches_send_bounded_frames():
    """Queries that meet every child of their node leave the kernel in frames of bounded size, none lost."""
    import pandas as pd

    from cellsmith.operators import metric

    rng = np.random.default_rng(3)
    part = pd.DataFrame({"qid": range(700), "vec": list(rng.normal(size=(700, 4))), "radius": np.nan})
    children = pd.DataFrame({"child": range(256), "vec": list(rng.normal(size=(256, 4))), "low": 0.0, "high": 1.0, "split": False})
    frames = list(metric._reached(7, part, children, 4))
    assert max(map(len, frames)) <= metric.SENT_ROWS
    met = pd.concat(frames)
    assert len(met) == len(met[["qid", "node"]].drop_duplicates()) == 700 * 256
    assert all((a == b).all() for a, b in zip(met["vec"].iloc[::9999], part["vec"].iloc[met["qid"].iloc[::9999]]))


@pytest.mark.parametrize("search", ["knn", "lof", "eps"])
def test_searches_write_each_vector_a_few_times(spark, monkeypatch, search):
    """Vectors of many dimensions prune little, yet a vector is not written once for every leaf that it meets."""
    from cellsmith.operators import cluster, detect, lookup, similarity

    written, keep = [], metric.checkpointed

    def counted(df):
        out = keep(df)
        if {"vec", "mat"} & set(out.columns):
            written.append(out.agg(F.sum("n")).first()[0] if "mat" in out.columns else out.count())
        return out

    for module in (metric, similarity, cluster, detect, lookup):
        monkeypatch.setattr(module, "checkpointed", counted)
    monkeypatch.setattr(metric.build_index, "__defaults__", (16,))
    x = points(31, 300, 12)
    if search == "knn":
        rows = frame(spark, x)
        got = collected(knn_join(rows, rows, 5, 12, rows=16))
        assert {i: [a for a, _ in v] for i, v in got.items()} == {i: [a for a, _ in v] for i, v in brute(x, x, 5).items()}
    elif search == "lof":
        monkeypatch.setattr(similarity.knn_shared, "__defaults__", (9, 16))
        assert detect.lof_scores(frame(spark, x), "id", 12).count() == 300
    else:
        monkeypatch.setattr(similarity.eps_links, "__defaults__", (16,))
        monkeypatch.setattr(similarity.cell_links, "__defaults__", (16,))
        got = {r["id"]: r["cluster"] for r in eps_components(frame(spark, x), "id", 0.6).collect()}
        near = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2)) <= 0.6
        assert all((got[i] == -1) == (near[i].sum() == 1) for i in got)
        assert all(got[i] == got[j] for i, j in zip(*np.nonzero(near)) if i != j)
    assert written and max(written) <= 300
