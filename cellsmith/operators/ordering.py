"""Exact global ranks and exact quantiles without sending a whole column through one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cellsmith.functions.scalars import name
from cellsmith.session import checkpointed

SMALL = 100_000


def global_rank(df: DataFrame, order: Sequence[str], rank: str = "rank") -> DataFrame:
    """0-based position in the order of unique keys.

    Range partitions are ranked on their own and shifted by the sizes of the
    partitions before them; only the partition sizes meet in one place.
    """
    keys = [name(c) for c in order]
    ranged = checkpointed(df.repartitionByRange(*keys).withColumn("_part", F.spark_partition_id()))
    sizes = ranged.groupBy("_part").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    inside = F.row_number().over(Window.partitionBy("_part").orderBy(*keys))
    ranked = ranged.withColumn("_inside", inside).join(F.broadcast(offsets), "_part")
    return ranked.select(*[name(c) for c in df.columns], (F.col("_offset") + F.col("_inside") - 1).alias(rank))


def _exact(values: DataFrame, ranks: list[int]) -> dict[int, float]:
    """Values at given 0-based ranks; narrows each rank's bracket until few distinct values remain."""
    total = values.agg(F.count("*"), F.approx_count_distinct("v")).first()
    if total[1] <= SMALL:
        counts = values.groupBy("v").agg(F.count("*").alias("n"))
        running = F.sum("n").over(Window.orderBy("v"))
        cumulative = counts.withColumn("upto", running)
        row = cumulative.agg(*[F.min(F.when(F.col("upto") > r, F.col("v"))).alias(f"r{r}") for r in ranks]).first()
        return {r: row[f"r{r}"] for r in ranks}
    found = {}
    n = total[0]
    for r in ranks:
        share = (r + 0.5) / n
        low, high = values.agg(
            F.percentile_approx("v", [max(0.0, share - 5e-4), min(1.0, share + 5e-4)], 20_000)
        ).first()[0]
        below = values.agg(F.sum((F.col("v") < low).cast("bigint")), F.sum((F.col("v") <= high).cast("bigint"))).first()
        if not below[0] <= r < below[1]:
            low, high = (None, high) if r < below[0] else (low, None)
            below = (0 if low is None else below[0], None)
        inner = values
        if low is not None:
            inner = inner.filter(F.col("v") >= low)
        if high is not None:
            inner = inner.filter(F.col("v") <= high)
        found[r] = low if low == high else _exact(inner, [r - below[0]])[r - below[0]]
    return found


def exact_quantiles(df: DataFrame, value: Column, shares: Sequence[float]) -> list[float | None]:
    """Linearly interpolated quantiles, exact at any size. NULLs are ignored.

    Brackets shrink about a thousandfold per pass; equal values are counted,
    not shipped, so a value holding a third of the rows costs one row.
    """
    values = df.select(value.cast("double").alias("v")).filter("v is not null and not isnan(v)")
    n = values.count()
    if n == 0:
        return [None for _ in shares]
    spots = [(n - 1) * s for s in shares]
    ranks = sorted({int(p) for p in spots} | {min(int(p) + 1, n - 1) for p in spots})
    at = _exact(values, ranks)
    out = []
    for p in spots:
        low, high = at[int(p)], at[min(int(p) + 1, n - 1)]
        out.append(low + (high - low) * (p - int(p)))
    return out
