"""Wide table <-> long cell table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellsmith.functions.scalars import any_true, name, null_text
from cellsmith.sources.tables import align


def unpivot_cells(df: DataFrame, key: str, columns: Sequence[str], value: str = "value") -> DataFrame:
    """(row id, col, text value); NULL cells are kept."""
    texts = df.select(name(key), *[name(c).cast("string").alias(c) for c in columns])
    return texts.unpivot([name(key)], [name(c) for c in columns], "col", value)


def pivot_cells(cells: DataFrame, key: str, columns: Sequence[str], value: str = "value") -> DataFrame:
    """Back to wide over a known column list; no discovery pass."""
    picked = [F.max(F.when(F.col("col") == c, F.col(value))).alias(c) for c in columns]
    return cells.groupBy(name(key)).agg(*picked)


def flagged_columns(mask: DataFrame, key: str) -> DataFrame:
    """One row per column: number of flagged cells and whether the column needs any work."""
    columns = [c for c in mask.columns if c != key]
    sums = mask.agg(*[F.coalesce(F.sum(name(c).cast("boolean").cast("bigint")), F.lit(0)).alias(c) for c in columns])
    counts = sums.unpivot([], [name(c) for c in columns], "col", "flags")
    return counts.withColumn("needed", F.col("flags") > 0)


def flagged_column_list(mask: DataFrame, key: str) -> list[str]:
    return [r["col"] for r in flagged_columns(mask, key).filter("needed").collect()]


def error_report(df: DataFrame, mask: DataFrame, key: str) -> DataFrame:
    """(row id, col, value) of every flagged cell, with the overall count.

    Mask rows without a flag drop out before the join.
    """
    columns = [c for c in df.columns if c != key and c in mask.columns]
    marked = mask.filter(any_true([name(c) for c in columns]))
    joined = align({"m": marked, "d": df}, key, {"d": columns, "m": columns})
    entries = F.filter(
        F.array(
            *[
                F.struct(
                    F.lit(c).alias("col"),
                    F.col("d").getField(c).cast("string").alias("value"),
                    F.coalesce(F.col("m").getField(c).cast("boolean"), F.lit(False)).alias("flag"),
                )
                for c in columns
            ]
        ),
        lambda e: e["flag"],
    )
    return joined.select(name(key), F.explode(entries).alias("e")).select(name(key), "e.col", "e.value")


def error_total(report: DataFrame) -> DataFrame:
    return report.agg(F.count("*").alias("total_errors"))


def row_any(mask: DataFrame, key: str) -> DataFrame:
    """Row label: 1 when any cell of the row is flagged."""
    return mask.select(name(key), any_true([name(c) for c in mask.columns if c != key]).cast("int").alias("label"))


def repair_overlay(
    dirty: DataFrame, truth: DataFrame, mask: DataFrame, chosen: DataFrame, key: str
) -> tuple[DataFrame, DataFrame]:
    """Chosen rows take their truth values and lose their flags; returns (table, mask)."""
    columns = [c for c in dirty.columns if c != key]
    picked = truth.join(chosen.select(name(key)), key, "left_semi").select(
        name(key), F.struct(*[name(c).cast("string").alias(c) for c in columns]).alias("t")
    )
    overlaid = dirty.join(picked, key, "left").select(
        name(key),
        *[
            F.when(F.col("t").isNotNull(), F.col("t").getField(c)).otherwise(name(c).cast("string")).alias(c)
            for c in columns
        ],
    )
    marks = chosen.select(name(key), F.lit(True).alias("chosen_row"))
    flag_columns = [c for c in mask.columns if c != key]
    cleared = mask.join(marks, key, "left").select(
        name(key),
        *[
            F.when(F.col("chosen_row"), F.lit(False)).otherwise(name(c).cast("boolean")).alias(c)
            for c in flag_columns
        ],
    )
    return overlaid, cleared


def _differs(left: Column, right: Column) -> Column:
    return null_text(left) != null_text(right)


def diff_mark(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """(row id, col, value_a, value_b) of cells that differ, NULL read as ``null``."""
    joined = align({"a": a, "b": b}, key)
    columns = joined.schema["a"].dataType.names
    entries = F.filter(
        F.array(
            *[
                F.struct(
                    F.lit(c).alias("col"),
                    null_text(F.col("a").getField(c)).alias("value_a"),
                    null_text(F.col("b").getField(c)).alias("value_b"),
                )
                for c in columns
            ]
        ),
        lambda e: e["value_a"] != e["value_b"],
    )
    return joined.select(name(key), F.explode(entries).alias("e")).select(name(key), "e.*")


def diff_summary(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Number of differing cells and their percentage of all cells."""
    joined = align({"a": a, "b": b}, key)
    columns = joined.schema["a"].dataType.names
    differing = [F.sum(_differs(F.col("a").getField(c), F.col("b").getField(c)).cast("bigint")) for c in columns]
    count = differing[0]
    for d in differing[1:]:
        count = count + d
    cells = F.count("*") * F.lit(len(columns))
    return joined.agg(
        F.coalesce(count, F.lit(0)).alias("diff_count"),
        F.coalesce(F.try_divide(count.cast("double") * 100.0, cells.cast("double")), F.lit(0.0)).alias("diff_percent"),
    )
