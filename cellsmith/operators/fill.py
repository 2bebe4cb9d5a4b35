"""Mode fill, missing-aware nearest-neighbour fill, and the baseline corrector built from them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cellsmith.functions.scalars import name, number_or_null, total
from cellsmith.operators.bands import nearest_donors
from cellsmith.operators.encode import decode_column, encode_columns, label_dictionary
from cellsmith.operators.lookup import lookup_join
from cellsmith.sources.tables import blank_by_mask, is_numeric


def fresh(taken: Sequence[str], base: str) -> str:
    """A column name that the table does not use."""
    used = {c.lower() for c in taken}
    while base.lower() in used:
        base += "_"
    return base


def _family(field: T.StructField) -> str:
    if isinstance(field.dataType, (T.FloatType, T.DoubleType, T.DecimalType)):
        return "double"
    if isinstance(field.dataType, (T.IntegralType, T.BooleanType)):
        return "bigint"
    return "string"


def column_modes(df: DataFrame, columns: Sequence[str]) -> dict[str, object]:
    """Most frequent value per column, smallest on a tie.

    Values are counted with map-side combine, so a dominant value shuffles as one row per task.
    """
    fields = {f.name: f for f in df.schema.fields}
    modes: dict[str, object] = {}
    for family in ("string", "bigint", "double"):
        group = [c for c in columns if _family(fields[c]) == family]
        if not group:
            continue
        cells = df.select(*[name(c).cast(family).alias(c) for c in group]).unpivot(
            [], [name(c) for c in group], "col", "value"
        )
        counts = cells.filter("value is not null").groupBy("col", "value").agg(F.count("*").alias("n"))
        best = counts.groupBy("col").agg(F.min(F.struct((-F.col("n")).alias("n"), F.col("value"))).alias("best"))
        modes.update({r["col"]: r["best"]["value"] for r in best.collect()})
    return modes


def mode_fill(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    modes = column_modes(df, columns)
    types = {f.name: f.dataType for f in df.schema.fields}
    return df.select(
        *[
            F.coalesce(name(c), F.lit(modes[c]).cast(types[c])).alias(c) if c in modes else name(c)
            for c in df.columns
        ]
    )


def knn_fill(df: DataFrame, key: str, columns: Sequence[str], k: int = 5) -> DataFrame:
    """Fill NULL and NaN by the mean of the k nearest donors.

    Distance = sqrt(d / shared * sum of squared gaps) over the coordinates both
    rows have; donors must hold the target cell; no donor gives the column mean.
    Equal rows are asked once. One tree of bands serves every pattern of gaps
    (``bands.py``); the result is exact.
    """
    columns = list(columns)
    number = [number_or_null(name(c)) for c in columns]
    cells = fresh(df.columns, "_x")
    rows = df.withColumn(cells, F.array(*number))
    means = df.agg(*[F.avg(v).alias(f"m{i}") for i, v in enumerate(number)]).first()
    found = nearest_donors(rows.select(name(key).alias("id"), F.col(cells).alias("x")), len(columns), k)
    fills, weight = fresh(rows.columns, "_fills"), fresh(rows.columns, "_n")
    joined = lookup_join(rows, found.select(F.col("x").alias(cells), F.col("fills").alias(fills), F.col("n").alias(weight)), [cells], weight)
    spot = {c: i for i, c in enumerate(columns)}
    return joined.select(
        *[F.coalesce(number[spot[c]], F.get(fills, F.lit(spot[c])), F.lit(means[spot[c]])).alias(c) if c in spot else name(c) for c in df.columns]
    )


def baseline_correct(
    dirty: DataFrame, mask: DataFrame, key: str, strategy: str = "most_frequent", k: int = 5
) -> DataFrame:
    """Blank the flagged cells, then fill every NULL by mode or by neighbours over label codes."""
    columns = [c for c in dirty.columns if c != key]
    blanked = blank_by_mask(dirty, mask, key, columns, blank_when=1)
    if strategy == "most_frequent":
        return mode_fill(blanked, columns)
    texts = [f.name for f in blanked.schema.fields if f.name != key and not is_numeric(f)]
    dictionaries = {c: label_dictionary(blanked, c) for c in texts}
    filled = knn_fill(encode_columns(blanked, texts, dictionaries), key, columns, k)
    for c in texts:
        filled = decode_column(filled, c, dictionaries[c])
    return filled


def missing_count(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.agg(total([F.sum(name(c).isNull().cast("bigint")) for c in columns]).alias("missing"))
