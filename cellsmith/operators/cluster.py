"""Clusters over distinct vectors, their representatives, and label propagation."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.ml.clustering import BisectingKMeans, KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from cellsmith.functions.scalars import name
from cellsmith.operators import metric
from cellsmith.operators.components import connected_components
from cellsmith.operators.lookup import lookup_join
from cellsmith.operators.metric import split_grid, squared, stack
from cellsmith.operators.similarity import cell_links, eps_links, micro_cells
from cellsmith.session import checkpointed

MAX_K = 10
#: Members of a cluster that a round scores exactly, and the most rounds.
SCORED, ROUNDS = 32, 12


def knee(costs: Sequence[float], sensitivity: float = 1.0) -> int:
    """Knee of a convex decreasing curve over k = 1..n by the published difference-curve rule; 1 when there is none."""
    n = len(costs)
    if n < 3 or max(costs) == min(costs):
        return 1
    x = np.arange(n) / (n - 1)
    y = (np.asarray(costs, dtype=float) - min(costs)) / (max(costs) - min(costs))
    gap = (1.0 - y) - x
    peaks = [i for i in range(1, n - 1) if gap[i] >= gap[i - 1] and gap[i] >= gap[i + 1]]
    step = float(np.mean(np.diff(x)))
    for at, i in enumerate(peaks):
        floor = gap[i] - sensitivity * step
        stop = peaks[at + 1] if at + 1 < len(peaks) else n
        if any(gap[j] < floor for j in range(i + 1, stop)):
            return i + 1
    return 1


def _kmeans(k: int, seed: int, weight: str | None = None) -> KMeans:
    """The row solver accepts fewer distinct points than k; the block solver fails on them."""
    model = KMeans(k=k, seed=seed, predictionCol="cluster", solver="row")
    return model.setWeightCol(weight) if weight else model


def _vectors(points: DataFrame, vec: str, weight: str | None) -> DataFrame:
    extra = [F.col(weight).cast("double").alias("weight")] if weight else [F.lit(1.0).alias("weight")]
    return points.select("*", array_to_vector(F.col(vec)).alias("features"), *extra) if weight != "weight" else points.select(
        "*", array_to_vector(F.col(vec)).alias("features")
    )


def _dims(points: DataFrame, vec: str) -> int:
    """Length of the vectors; 0 for an empty table."""
    row = points.select(vec).first()
    return len(row[0]) if row else 0


def elbow_costs(points: DataFrame, vec: str = "vec", weight: str | None = None, max_k: int = MAX_K, seed: int = 42) -> list[float]:
    """k-means inertia for k = 1..min(n, max_k) over weighted distinct points."""
    data = _vectors(points, vec, weight).select("features", "weight").persist()
    try:
        top = min(data.limit(max_k).count(), max_k)
        return [
            float(_kmeans(k, seed, "weight").fit(data).summary.trainingCost) if k > 1 else _single_cost(points, vec, weight)
            for k in range(1, top + 1)
        ]
    finally:
        data.unpersist()


def _single_cost(points: DataFrame, vec: str, weight: str | None) -> float:
    dims = _dims(points, vec)
    if not dims:
        return 0.0
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    parts = []
    for i in range(dims):
        v = F.col(vec)[i]
        parts.append(F.sum(w * v * v) - F.sum(w * v) * F.sum(w * v) / F.sum(w))
    row = points.agg(*[p.alias(f"c{i}") for i, p in enumerate(parts)]).first()
    return float(max(0.0, sum(row)))


def elbow_k(points: DataFrame, vec: str = "vec", weight: str | None = None, max_k: int = MAX_K, seed: int = 42) -> int:
    return knee(elbow_costs(points, vec, weight, max_k, seed))


def hierarchical_clusters(points: DataFrame, k: int, vec: str = "vec", weight: str | None = None, seed: int = 42) -> DataFrame:
    """Top-down hierarchical clusters over weighted points; adds ``cluster``."""
    data = _vectors(points, vec, weight)
    if k <= 1 or points.isEmpty():
        return points.withColumn("cluster", F.lit(0))
    model = BisectingKMeans(k=k, seed=seed, weightCol="weight", predictionCol="cluster").fit(data)
    return model.transform(data).select(*points.columns, "cluster")


def eps_components(points: DataFrame, key: str, eps: float = 0.5, vec: str = "vec", weight: str | None = None) -> DataFrame:
    """Density clusters with at least two members: components of the eps-graph; noise gets -1.

    Cluster id = least row id of the component. Equal vectors are linked through
    their first row, and vectors of a cell of half of eps across through its first
    one, so a dense place is one node and only neighbouring cells meet.
    """
    copies = F.col(weight) if weight else F.lit(1)
    rows = points.select(name(key).alias("id"), F.col(vec).alias("vec"), F.xxhash64(F.col(vec)).alias("_h"), copies.alias("w"))
    firsts = checkpointed(rows.groupBy("_h", "vec").agg(F.min("id").alias("id"), F.sum("w").alias("copies")))
    dims = _dims(firsts, "vec")
    if not dims:
        return rows.select(F.col("id").alias(key), F.col("id").alias("cluster"))
    cells, members = micro_cells(firsts.select("id", "vec"), eps, dims)
    found = checkpointed(connected_components(eps_links(cells.select(F.col("node").alias("id"), F.col("rep").alias("vec")), eps, dims)))
    if not cells.filter("n > 1").isEmpty():
        more = cell_links(cells, members, found, eps, dims)
        whole = cells.select("node").join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
        ends = lambda node, end: whole.select(F.col("node").alias(node), F.col("component").alias(end))
        between = more.join(ends("a", "_a"), "a").join(ends("b", "_b"), "b").select(F.col("_a").alias("a"), F.col("_b").alias("b"))
        merged = connected_components(between).select(F.col("node").alias("component"), F.col("component").alias("_end"))
        found = whole.join(merged, "component", "left").select("node", F.coalesce("_end", "component").alias("component"))
    sizes = found.join(cells.select("node", "n"), "node").groupBy("component").agg(F.sum("n").alias("_w"))
    told = found.join(sizes, "component").filter("_w > 1")
    ids = members.select("id", "node")
    owned = lookup_join(ids, told.withColumnRenamed("component", "_c"), ["node"], "_w")
    labelled = firsts.join(owned.select("id", "_c"), "id", "left").select(
        "_h",
        "vec",
        "copies",
        F.when(F.col("_c").isNotNull(), F.col("_c"))
        .when(F.col("copies") > 1, F.col("id"))
        .otherwise(F.lit(-1).cast(firsts.schema["id"].dataType))
        .alias("cluster"),
    )
    placed = lookup_join(rows.select("id", "_h", "vec"), labelled, ["_h", "vec"], "copies", "inner")
    return placed.select(F.col("id").alias(key), "cluster")


def cluster_means(points: DataFrame, cluster: str, vec: str, weight: str | None = None) -> DataFrame:
    dims = _dims(points, vec)
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    mean = F.array(*[F.sum(w * F.col(vec)[i]) / F.sum(w) for i in range(dims)]).cast("array<double>")
    return points.groupBy(cluster).agg(mean.alias("_mean"), F.sum(w).alias("_size"))


def nearest_to_mean(points: DataFrame, key: str, cluster: str = "cluster", vec: str = "vec", weight: str | None = None) -> DataFrame:
    """Member nearest its cluster mean, least id on a tie."""
    joined = lookup_join(points, cluster_means(points, cluster, vec, weight), [cluster], "_size", "inner")
    squares = F.zip_with(vec, "_mean", lambda a, b: (a - b) * (a - b))
    distance = F.round(F.sqrt(F.aggregate(squares, F.lit(0.0), lambda s, v: s + v)), 9)
    best = F.min(F.struct(distance.alias("distance"), name(key).alias("id")))
    return joined.groupBy(cluster).agg(best.alias("b")).select(
        cluster, F.col("b.id").alias("representative"), F.col("b.distance").alias("distance")
    )


def rule_out(base: DataFrame, dims: int) -> tuple[DataFrame, DataFrame]:
    """(scored, left) of base (space, node, c, id, vec, w): members with their exact sum of distances, and the members whose
    sum may still be the least.

    Each round scores members of each cluster exactly, first those next to the mean, then some that are left, drawn by hash. For a
    scored j the triangle inequality gives S(i) >= |S(j) - W d(i, j)|; the bounds only rise and the least known sum only
    falls, so members fall away from round to round. Rounds end when one rules out less than a tenth.
    """
    keys = ["space", "node"]
    sizes = checkpointed(base.groupBy(*keys).agg(F.sum("w").alias("whole"), F.count("*").alias("rows")))
    means = cluster_means(base.withColumn("_k", F.struct(*keys)), "_k", "vec", "w").select("_k.*", "_mean", "_size")
    gap = F.zip_with("vec", "_mean", lambda x, y: (x - y) * (x - y))
    told = lookup_join(base, means, keys, "_size", "inner")
    told = told.select(*base.columns, F.lit(0.0).alias("low"), F.aggregate(gap, F.lit(0.0), lambda t, v: t + v).alias("turn"))
    left = checkpointed(told)
    scored = base.select(*keys, "c", "id", F.lit(0.0).alias("total")).limit(0)
    sums = T.StructType([T.StructField("space", T.LongType()), T.StructField("node", T.LongType()), T.StructField("child", base.schema["id"].dataType), T.StructField("part", T.DoubleType())])
    kept = T.StructType([*left.schema.fields])

    def distances(part: pd.DataFrame, own: pd.DataFrame) -> np.ndarray:
        a, b = stack(part["vec"], dims), stack(own["vec"], dims)
        d2 = squared(a, b)
        row, col = np.nonzero(d2 <= 1e-6 * (1.0 + (a * a).sum(1)[:, None]))
        d2[row, col] = ((a[row] - b[col]) ** 2).sum(1)
        return np.sqrt(d2)

    def add_up(space, part: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        total = part["w"].to_numpy() @ distances(part, own)
        return pd.DataFrame({"space": space, "node": own["node"].to_numpy(), "child": own["child"].to_numpy(), "part": total})

    def raise_bounds(space, part: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        reach = distances(part, own) * own["whole"].to_numpy()[None, :]
        low = np.maximum(part["low"].to_numpy(), np.abs(reach - own["total"].to_numpy()[None, :]).max(1))
        low = np.where(part["id"].isin(own["child"]), np.inf, low)
        part = part.assign(low=low)
        best = own["best"].to_numpy()[0]
        return part[low <= best * (1 + 1e-9) + 1e-6][[f.name for f in kept]]

    before = left.count()
    for done in range(ROUNDS):
        turn = F.xxhash64(F.lit(done), "id") if done else F.col("turn")
        first = F.row_number().over(Window.partitionBy(*keys).orderBy(turn, "id"))
        level = left.withColumn("_rn", first).filter(F.col("_rn") <= SCORED).select(*keys, "c", F.col("id").alias("child"), "vec")
        level = checkpointed(level)
        totals = metric._meet(base, level.drop("c"), "id", dims, add_up, sums).groupBy(*keys, "child").agg(F.sum("part").alias("total"))
        exact = checkpointed(level.join(totals, [*keys, "child"]))
        scored = checkpointed(scored.unionByName(exact.select(*keys, "c", F.col("child").alias("id"), "total")))
        best = scored.groupBy(*keys).agg(F.min("total").alias("best"))
        known = exact.drop("c").join(sizes.drop("rows"), keys).join(best, keys)
        left = checkpointed(metric._meet(left, known, "id", dims, raise_bounds, kept))
        now = left.count()
        if now == 0 or (done and 10 * now > 9 * before):
            break
        before = now
    return scored.drop(*keys), left


def medoids(points: DataFrame, key: str, cluster: str = "cluster", vec: str = "vec", weight: str | None = None) -> DataFrame:
    """Member with the least total distance to its cluster, least id on a tie; exact.

    ``rule_out`` scores a few members exactly and bounds the others by them; only members that remain are scored, in
    bounded blocks that return partial sums.
    """
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    own = F.col(cluster)
    codes = [F.xxhash64(F.lit(i), own).alias(n) for i, n in enumerate(("space", "node"))]
    base = checkpointed(points.select(*codes, own.alias("c"), name(key).alias("id"), F.col(vec).alias("vec"), w.alias("w")))
    dims = _dims(base, "vec")
    if not dims:
        return base.select(F.col("c").alias(cluster), F.col("id").alias("representative"), F.col("w").alias("total_distance"))
    scored, alive = rule_out(base, dims)
    left, right, grid = split_grid(
        alive.select("space", "node", F.col("id").alias("qid"), F.col("vec").alias("qvec"), "c"),
        base.select("space", "node", F.col("id").alias("iid"), F.col("vec").alias("ivec"), "w"),
        ["space", "node"],
        "qid",
        "iid",
    )

    def partial(grid_key, qpdf: pd.DataFrame, ipdf: pd.DataFrame) -> pd.DataFrame:
        if not len(qpdf) or not len(ipdf):
            return pd.DataFrame({"c": [], "id": [], "total": []})
        b, wb = stack(ipdf["ivec"], dims), ipdf["w"].to_numpy()
        sums = []
        for start in range(0, len(qpdf), 256):
            a = stack(qpdf["qvec"].iloc[start : start + 256], dims)
            d2 = squared(a, b)
            close = d2 <= 1e-6 * (1.0 + (a * a).sum(1)[:, None])
            row, col = np.nonzero(close)
            d2[row, col] = ((a[row] - b[col]) ** 2).sum(1)
            sums.append(np.sqrt(d2) @ wb)
        return pd.DataFrame({"c": qpdf["c"].to_numpy(), "id": qpdf["qid"].to_numpy(), "total": np.concatenate(sums)})

    schema = T.StructType(
        [
            T.StructField("c", base.schema["c"].dataType),
            T.StructField("id", base.schema["id"].dataType),
            T.StructField("total", T.DoubleType()),
        ]
    )
    sums = left.groupBy(*grid).cogroup(right.groupBy(*grid)).applyInPandas(partial, schema)
    totals = sums.groupBy("c", "id").agg(F.sum("total").alias("total")).unionByName(scored)
    totals = totals.withColumn("total", F.round("total", 6))
    best = totals.groupBy("c").agg(F.min(F.struct("total", "id")).alias("b"))
    return best.select(
        F.col("c").alias(cluster), F.col("b.id").alias("representative"), F.col("b.total").alias("total_distance")
    )


def propagate_labels(members: DataFrame, representatives: DataFrame, labels: DataFrame, key: str, cluster: str = "cluster") -> DataFrame:
    """Spread each representative's label over its cluster; rows of unlabelled clusters drop out.

    members (key, cluster), representatives (cluster, representative), labels (key, label). A cluster may hold most rows.
    """
    marked = representatives.join(
        labels.select(name(key).alias("representative"), "label"), "representative"
    ).select(cluster, "label")
    sizes = members.groupBy(name(cluster).alias(cluster)).agg(F.count("*").alias("_members"))
    return lookup_join(members, marked.join(sizes, cluster), [cluster], "_members", "inner").select(name(key), name(cluster), "label")


def repair_candidates(rows: DataFrame, mask: DataFrame, key: str, n: int, vec: str = "vec", seed: int = 42) -> DataFrame:
    """Rows to hand to a human: cluster the flagged rows, then take from each cluster, in order,

    the row adding most flagged columns not yet covered (first row on a tie).
    rows: (key, vec of masked cell embeddings). Returns (key, position).
    """
    columns = [c for c in mask.columns if c != key]
    flags = F.concat(*[F.coalesce(name(c).cast("int"), F.lit(0)).cast("string") for c in columns])
    flagged = rows.join(mask.select(name(key), flags.alias("pattern")), key).filter(F.contains("pattern", F.lit("1")))
    # Equal flag patterns with equal vectors are one weighted point; its first row stands for it.
    data = checkpointed(
        flagged.groupBy("pattern", F.col(vec).alias("vec")).agg(F.count("*").cast("double").alias("weight"), F.min(name(key)).alias("id"))
    )
    features = data.select("pattern", "id", "weight", array_to_vector("vec").alias("features"))
    model = _kmeans(n, seed, "weight").fit(features) if n > 1 else None
    placed = model.transform(features) if model else features.withColumn("cluster", F.lit(0))
    patterns = checkpointed(placed.groupBy("cluster", "pattern").agg(F.min("id").alias("id")))
    covered: set[int] = set()
    chosen = []
    for cluster in range(n):
        fresh = [i for i in range(len(columns)) if i not in covered]
        gain = F.lit(0)
        for i in fresh:
            gain = gain + F.substring("pattern", i + 1, 1).cast("int")
        best = patterns.filter(F.col("cluster") == cluster).agg(F.min(F.struct((-gain).alias("g"), "id", "pattern")).alias("b")).first()["b"]
        if best is None:
            continue
        chosen.append((best["id"], len(chosen)))
        covered |= {i for i, bit in enumerate(best["pattern"]) if bit == "1"}
    schema = T.StructType([T.StructField(key, rows.schema[key].dataType), T.StructField("position", T.IntegerType())])
    return rows.sparkSession.createDataFrame(chosen, schema)


def clean_representatives(rows: DataFrame, mask: DataFrame, key: str, n: int, vec: str = "vec", seed: int = 42) -> DataFrame:
    """One seeded pick per cluster of the rows without any flag; (key, cluster)."""
    from cellsmith.operators.cells import row_any

    clean = rows.join(row_any(mask, key).filter("label = 0"), key, "left_semi")
    data = checkpointed(clean.select(name(key), F.col(vec).alias("vec")))
    held = data.limit(n).count()
    if held == 0:
        return data.select(name(key), F.lit(0).alias("cluster")).limit(0)
    features = data.select(name(key), array_to_vector("vec").alias("features"))
    k = min(n, held)
    placed = (
        _kmeans(k, seed).fit(features).transform(features)
        if k > 1
        else features.withColumn("cluster", F.lit(0))
    )
    order = F.struct(F.xxhash64(F.lit(seed), name(key)), name(key))
    return placed.groupBy("cluster").agg(F.min_by(name(key), order).alias(key))
