"""Nearest donors of rows with gaps, whatever cells are missing, by one tree of coordinate bands.

A node with more than LEAF_ROWS rows is cut along its widest coordinate at quantiles; rows
without that coordinate have a band of their own. Each child is known by its box: bounds of
every coordinate, whether all of its rows have it, and whether any has. That bounds from
below the distance over shared coordinates, so a query visits only the leaves that can hold a
donor as near as those it has found at home.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from cellsmith.operators import metric
from cellsmith.operators.lookup import lookup_join
from cellsmith.operators.metric import split_grid
from cellsmith.session import checkpointed

LEAF_ROWS, BANDS, ACCURACY = 2048, 8, 1000
DIGITS = 6


def _matrix(series: pd.Series) -> np.ndarray:
    """Rows of numbers; a missing one is NaN."""
    return np.array([[np.nan if v is None else v for v in row] for row in series], dtype=float)


def _box(d: int) -> list:
    x = [F.col("x")[i] for i in range(d)]
    return [
        F.array(*[F.coalesce(F.min(v), F.lit(0.0)) for v in x]).alias("low"),
        F.array(*[F.coalesce(F.max(v), F.lit(0.0)) for v in x]).alias("high"),
        F.array(*[F.count(v) == F.count("*") for v in x]).alias("all"),
        F.array(*[F.count(v) > 0 for v in x]).alias("any"),
    ]


def build_tree(rows: DataFrame, d: int, most: int = LEAF_ROWS) -> tuple[DataFrame, list[DataFrame]]:
    """(space, node, iid, x) of the leaves, and the levels (space, node, child, box, rows, split) of rows (iid, x)."""
    state = checkpointed(rows.select(F.lit(0).cast("bigint").alias("space"), F.lit(0).cast("bigint").alias("node"), "iid", "x"))
    levels: list[DataFrame] = []
    done: list[DataFrame] = []
    if state.limit(most + 1).count() <= most:
        return state, levels
    active = state
    cuts = F.array(*[F.lit(i / BANDS) for i in range(1, BANDS)])
    while True:
        widths = []
        for i in range(d):
            v = F.col("x")[i]
            edges = F.coalesce(F.percentile_approx(v, cuts, ACCURACY), F.array().cast("array<double>"))
            mixed = ((F.count(v) > 0) & (F.count(v) < F.count("*"))).cast("int")
            widths.append(F.struct((F.coalesce(F.var_pop(v), F.lit(0.0)) * F.count(v)).alias("width"), mixed.alias("mixed"), F.lit(i).alias("at"), edges.alias("edges")))
        plan = active.groupBy("space", "node").agg(F.array_max(F.array(*widths)).alias("cut"), F.count("*").alias("_n"))
        plan = checkpointed(plan.select("space", "node", "cut.at", F.array_distinct("cut.edges").alias("edges"), "_n"))
        told = lookup_join(active, plan.withColumn("_w", F.col("_n")), ["space", "node"], "_w", "inner")
        v = F.get("x", "at")
        band = F.when(v.isNull(), 0).otherwise(1 + F.size(F.filter("edges", lambda e: e < v)))
        placed = checkpointed(told.select("space", F.col("node").alias("parent"), (F.col("node") * (BANDS + 2) + 1 + band).alias("node"), "iid", "x"))
        stats = placed.groupBy("space", "parent", "node").agg(*_box(d), F.count("*").alias("rows"))
        again = (F.col("rows") > most) & (F.col("rows") <= metric.SHRINK * F.col("_n"))
        level = stats.withColumnRenamed("node", "child").withColumnRenamed("parent", "node").join(plan.select("space", "node", "_n"), ["space", "node"])
        level = checkpointed(level.withColumn("split", again).drop("_n"))
        levels.append(level)
        flags = level.select("space", F.col("child").alias("node"), "split", "rows")
        told = lookup_join(placed.drop("parent"), flags, ["space", "node"], "rows", "inner")
        done.append(told.filter(~F.col("split")).drop("split"))
        if level.filter("split").isEmpty():
            break
        active = told.filter("split").drop("split")
    leaves = done[0]
    for part in done[1:]:
        leaves = leaves.unionByName(part)
    return checkpointed(leaves), levels


def _least(x: np.ndarray, own: pd.DataFrame, d: int) -> tuple[np.ndarray, np.ndarray]:
    """Lower bounds of the distance from each query to any row of each child (inf: nothing shared), and the
    number of the query's missing cells that no row of the child has."""
    low, high = _matrix(own["low"]), _matrix(own["high"])
    every, some = np.array(own["all"].tolist(), dtype=bool), np.array(own["any"].tolist(), dtype=bool)
    seen = ~np.isnan(x)
    filled = np.nan_to_num(x)
    gap = np.maximum(np.maximum(low[None] - filled[:, None], filled[:, None] - high[None]), 0.0)
    square = (gap * gap * (seen[:, None] & every[None])).sum(2)
    shared = seen.astype(float) @ some.T.astype(float)
    least = np.where(shared > 0, d / np.maximum(shared, 1) * square, np.inf)
    return least, (~seen).astype(float) @ (~some).T.astype(float)


def _descend(at: DataFrame, levels: list[DataFrame], d: int, id_type: T.DataType, home: bool) -> DataFrame:
    """(space, node, qid, x, radius) at the leaf of the least bound, or at all within the radius."""
    names = [("space", T.LongType()), ("node", T.LongType()), ("qid", id_type), ("x", metric.VECTOR), ("radius", T.DoubleType()), ("split", T.BooleanType())]
    schema = T.StructType([T.StructField(n, t) for n, t in names])

    def move(space, part: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        out = []
        for start in range(0, len(part), 256):
            chunk = part.iloc[start : start + 256]
            x = _matrix(chunk["x"])
            least, lacking = _least(x, own, d)
            if home:
                size = np.broadcast_to(-own["rows"].to_numpy(dtype=float), least.shape)
                col = np.lexsort((size, least, lacking), axis=1)[:, 0]
                row = np.arange(len(chunk))
            else:
                bound = chunk["radius"].to_numpy(dtype=float)
                bound = np.where(np.isnan(bound), np.inf, bound)
                useful = lacking < np.isnan(x).sum(1)[:, None]
                row, col = np.nonzero(useful & np.isfinite(least) & (least <= (bound * (1 + 1e-9) + 10.0**-DIGITS)[:, None]))
            out.append(
                pd.DataFrame(
                    {
                        "space": space,
                        "node": own["child"].to_numpy()[col],
                        "qid": chunk["qid"].to_numpy()[row],
                        "x": chunk["x"].to_numpy()[row],
                        "radius": chunk["radius"].to_numpy(dtype=float)[row],
                        "split": own["split"].to_numpy()[col],
                    }
                )
            )
        return pd.concat(out)

    ended = []
    at = at.withColumn("split", F.lit(bool(levels)))
    for level in levels:
        at = checkpointed(metric._meet(at.filter("split"), level, "qid", 4 * d, move, schema))
        ended.append(at.filter(~F.col("split")))
    out = ended[0] if ended else at
    for part in ended[1:]:
        out = out.unionByName(part)
    return out.drop("split")


def nearest_donors(rows: DataFrame, d: int, k: int, most: int = LEAF_ROWS) -> DataFrame:
    """(x, n, fills) of every distinct row with gaps: for each missing cell the mean over its k nearest donors.

    rows: (id, x array<double> of d cells, NULL where missing). Distance = d / shared * sum of squared gaps over the cells that both rows
    have, rounded to DIGITS; donors have the missing cell, share at least one cell, ties go to the least id. ``fills`` is NULL where no donor is.
    ``n``: the rows with that x.
    """
    id_type = rows.schema["id"].dataType
    copies = Window.partitionBy("_h", "x").orderBy("id")
    donors = rows.select(F.col("id").alias("iid"), "x", F.xxhash64("x").alias("_h"), "id").withColumn("_rn", F.row_number().over(copies))
    donors = donors.filter((F.col("_rn") <= k) & F.exists("x", lambda v: v.isNotNull())).select("iid", "x")
    leaves, levels = build_tree(donors, d, most)
    leaves = leaves.select("space", "node", "iid", F.col("x").alias("ix"))
    gaps = rows.filter(F.exists("x", lambda v: v.isNull()) & F.exists("x", lambda v: v.isNotNull()))
    asked = checkpointed(gaps.groupBy("x").agg(F.min("id").alias("qid"), F.count("*").alias("n")))
    zero = F.lit(0).cast("bigint")
    at = asked.select(zero.alias("space"), zero.alias("node"), "qid", "x", F.lit(None).cast("double").alias("radius"))

    def block(key, qpdf: pd.DataFrame, ipdf: pd.DataFrame) -> pd.DataFrame:
        out = [pd.DataFrame({"qid": [], "target": [], "iid": [], "d2": [], "v": []})]
        if len(qpdf) and len(ipdf):
            b, ids = _matrix(ipdf["ix"]), ipdf["iid"].to_numpy()
            order = pd.factorize(ipdf["iid"], sort=True)[0]
            seen_b, b0 = ~np.isnan(b), np.nan_to_num(b)
            for start in range(0, len(qpdf), 256):
                part = qpdf.iloc[start : start + 256]
                a = _matrix(part["x"])
                seen_a, a0 = ~np.isnan(a), np.nan_to_num(a)
                shared = seen_a.astype(float) @ seen_b.T.astype(float)
                rough = (a0 * a0) @ seen_b.T + seen_a @ (b0 * b0).T - 2.0 * a0 @ b0.T
                rough = np.where(shared > 0, d / np.maximum(shared, 1) * np.maximum(rough, 0.0), np.inf)
                error = 10.0**-DIGITS + 1e-9 * d * (1.0 + (a0 * a0).sum(1) + (b0 * b0).sum(1).max())
                for target in np.flatnonzero((~seen_a).any(0) & seen_b.any(0)):
                    lacks, has = np.flatnonzero(~seen_a[:, target]), np.flatnonzero(seen_b[:, target])
                    sub = rough[np.ix_(lacks, has)]
                    kth = np.partition(sub, k - 1, axis=1)[:, k - 1] if sub.shape[1] > k else np.full(len(lacks), np.inf)
                    row, col = np.nonzero((sub <= (kth + error[lacks])[:, None]) & np.isfinite(sub))
                    i, j = lacks[row], has[col]
                    gap = np.where(seen_a[i] & seen_b[j], a0[i] - b0[j], 0.0)
                    exact = np.round(d / shared[i, j] * (gap * gap).sum(1), DIGITS)
                    by = np.lexsort((order[j], exact, i))
                    i, j, exact = i[by], j[by], exact[by]
                    keep = np.arange(len(i)) - np.searchsorted(i, i, side="left") < k
                    i, j = i[keep], j[keep]
                    out.append(pd.DataFrame({"qid": part["qid"].to_numpy()[i], "target": int(target), "iid": ids[j], "d2": exact[keep], "v": b[j, target]}))
        return pd.concat(out)

    fields = [("qid", id_type), ("target", T.IntegerType()), ("iid", id_type), ("d2", T.DoubleType()), ("v", T.DoubleType())]
    schema = T.StructType([T.StructField(n, t) for n, t in fields])
    best = F.row_number().over(Window.partitionBy("qid", "target").orderBy("d2", "iid"))

    def best_in(routed: DataFrame) -> DataFrame:
        left, right, grid = split_grid(routed.select("space", "node", "qid", "x"), leaves, ["space", "node"], "qid", "iid", most)
        return left.groupBy(*grid).cogroup(right.groupBy(*grid)).applyInPandas(block, schema)

    def first(partial: DataFrame) -> DataFrame:
        return partial.withColumn("rn", best).filter(F.col("rn") <= k).drop("rn")

    home = checkpointed(_descend(at, levels, d, id_type, True))
    found = checkpointed(first(best_in(home)))
    if levels:
        # The k-th distance of every missing cell bounds the rest; where one has fewer than k, all leaves with it can matter.
        missing = F.size(F.filter("x", lambda v: v.isNull()))
        per_cell = found.groupBy("qid", "target").agg(F.count("*").alias("have"), F.max("d2").alias("kth"))
        bound = per_cell.filter(F.col("have") == k).groupBy("qid").agg(F.count("*").alias("cells"), F.max("kth").alias("kth"))
        told = home.drop("radius").withColumnRenamed("node", "home").join(bound, "qid", "left")
        told = told.withColumn("radius", F.when(F.col("cells") == missing, F.col("kth")))
        again = told.select("space", zero.alias("node"), "qid", "x", "radius")
        away = _descend(again, levels, d, id_type, False).join(home.select("qid", "node"), ["qid", "node"], "left_anti")
        found = first(found.unionByName(best_in(checkpointed(away))))
    means = found.groupBy("qid").pivot("target", list(range(d))).agg(F.avg("v"))
    fills = F.array(*[F.col(str(t)) for t in range(d)]).alias("fills")
    return asked.join(means, "qid", "left").select("x", "n", fills)
