"""Column profiles and fixed distribution analyses."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cellsmith.functions.scalars import name
from cellsmith.operators.ordering import exact_quantiles
from cellsmith.sources.tables import column_kinds

# Age bands of the recorded distribution analysis, left-closed.
BAND_EDGES = [0.0, 18.0, 25.0, 35.0, 45.0, 60.0, float("inf")]
BAND_LABELS = ["Under 18", "18-25", "26-35", "36-45", "46-60", "Over 60"]


def profile(df: DataFrame, columns: Sequence[str] | None = None, approx: bool = False) -> DataFrame:
    """One row per column: kind, missing count, and rounded moments or the distinct count."""
    kinds = column_kinds(df)
    columns = list(columns or df.columns)
    distinct = F.approx_count_distinct if approx else F.count_distinct
    aggregates = []
    for i, c in enumerate(columns):
        value = name(c)
        aggregates.append(F.coalesce(F.sum(value.isNull().cast("bigint")), F.lit(0)).alias(f"missing{i}"))
        if kinds[c] == "Numeric":
            number = value.cast("double")
            aggregates += [
                F.round(F.avg(number), 2).alias(f"mean{i}"),
                F.round(F.stddev_samp(number), 2).alias(f"std{i}"),
                F.round(F.min(number), 2).alias(f"min{i}"),
                F.round(F.max(number), 2).alias(f"max{i}"),
            ]
        else:
            aggregates.append(distinct(value).alias(f"unique{i}"))
    nothing = F.lit(None).cast("double")
    rows = []
    for i, c in enumerate(columns):
        numeric = kinds[c] == "Numeric"
        rows.append(
            F.struct(
                F.lit(c).alias("name"),
                F.lit(kinds[c]).alias("type"),
                F.col(f"missing{i}").alias("missing"),
                *[(F.col(f"{s}{i}") if numeric else nothing).alias(s) for s in ("mean", "std", "min", "max")],
                (F.lit(None).cast("bigint") if numeric else F.col(f"unique{i}")).alias("unique"),
            )
        )
    return df.agg(*aggregates).select(F.inline(F.array(*rows)))


def row_sample(df: DataFrame, key: str, n: int = 10, seed: int = 0) -> DataFrame:
    """Seeded sample of n rows rendered ``col: value, ...``, one text per row."""
    order = F.md5(F.concat_ws("|", F.lit(str(seed)), name(key).cast("string")))
    line = F.concat_ws(
        ", ", *[F.concat(F.lit(f"{c}: "), F.coalesce(name(c).cast("string"), F.lit("nan"))) for c in df.columns]
    )
    return df.orderBy(order, name(key)).limit(n).select(name(key), line.alias("example"))


def value_counts(df: DataFrame, column: str) -> DataFrame:
    return df.filter(name(column).isNotNull()).groupBy(name(column).cast("string").alias("value")).agg(
        F.count("*").alias("n")
    )


def top_values(df: DataFrame, column: str, k: int = 5) -> DataFrame:
    """The k most frequent values, ties by value."""
    return value_counts(df, column).orderBy(F.desc("n"), F.asc("value")).limit(k)


def rare_values(df: DataFrame, column: str, below: int = 3) -> DataFrame:
    return value_counts(df, column).filter(F.col("n") < below)


def histogram(df: DataFrame, column: str, edges: Sequence[float] = BAND_EDGES, labels: Sequence[str] = BAND_LABELS) -> DataFrame:
    """Counts per left-closed band; empty bands show 0."""
    value = name(column).cast("double")
    counts = [
        F.coalesce(F.sum(((value >= low) & (value < high)).cast("bigint")), F.lit(0)).alias(f"n{i}")
        for i, (low, high) in enumerate(zip(edges, edges[1:]))
    ]
    rows = [F.struct(F.lit(label).alias("band"), F.col(f"n{i}").alias("n")) for i, label in enumerate(labels)]
    return df.agg(*counts).select(F.inline(F.array(*rows)))


def length_describe(df: DataFrame, column: str) -> DataFrame:
    """count, mean, std, min, quartiles, max of the text length, as (metric, value)."""
    lengths = df.select(F.length(name(column).cast("string")).cast("double").alias("len")).filter("len is not null")
    q1, q2, q3 = exact_quantiles(lengths, F.col("len"), [0.25, 0.5, 0.75])
    moments = lengths.agg(
        F.count("*").cast("double").alias("count"),
        F.avg("len").alias("mean"),
        F.stddev_samp("len").alias("std"),
        F.min("len").alias("min"),
        F.lit(q1).cast("double").alias("25%"),
        F.lit(q2).cast("double").alias("50%"),
        F.lit(q3).cast("double").alias("75%"),
        F.max("len").alias("max"),
    )
    return moments.unpivot([], [name(c) for c in moments.columns], "metric", "value")


def iqr_outliers(df: DataFrame, key: str, column: str, width: float = 1.5) -> DataFrame:
    """Rows beyond the inter-quartile fences."""
    q1, q3 = exact_quantiles(df, name(column), [0.25, 0.75])
    if q1 is None:
        return df.select(name(key), name(column).cast("double").alias("value")).limit(0)
    low, high = q1 - width * (q3 - q1), q3 + width * (q3 - q1)
    value = name(column).cast("double")
    return df.filter((value < low) | (value > high)).select(name(key), value.alias("value"))


def distribution_report(df: DataFrame, column: str, lines: int = 30) -> DataFrame:
    """The frequency and length analyses of one column as text lines, each analysis held to ``lines`` lines."""
    ranked = Window.partitionBy("analysis").orderBy("position", "line")
    top = top_values(df, column).select(
        F.lit("top values").alias("analysis"), (-F.col("n")).alias("position"), F.format_string("%s: %d", "value", "n").alias("line")
    )
    rare = rare_values(df, column).orderBy("value").limit(lines + 1).select(
        F.lit("rare values").alias("analysis"), F.col("n").alias("position"), F.format_string("%s: %d", "value", "n").alias("line")
    )
    described = length_describe(df, column).select(
        F.lit("text length").alias("analysis"), F.lit(0).cast("bigint").alias("position"), F.format_string("%s: %.4f", "metric", "value").alias("line")
    )
    numbered = top.unionByName(rare).unionByName(described).withColumn("line_no", F.row_number().over(ranked))
    cut = F.lit("... Too long, only sample some examples.")
    return numbered.filter(F.col("line_no") <= lines + 1).select(
        "analysis", "line_no", F.when(F.col("line_no") > lines, cut).otherwise(F.col("line")).alias("line")
    )
