"""Label encoding by sorted distinct text, and its inverse; rounding of category-like numbers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellsmith.functions.scalars import name
from cellsmith.operators.lookup import lookup_join
from cellsmith.operators.ordering import global_rank

CATEGORY_LIMIT = 20


def label_dictionary(df: DataFrame, column: str) -> DataFrame:
    """(value, copies, code): 0-based position of each distinct non-null text."""
    values = df.select(name(column).cast("string").alias("value")).filter("value is not null")
    return global_rank(values.groupBy("value").agg(F.count("*").alias("copies")), ["value"], "code")


def encode_columns(df: DataFrame, columns: Sequence[str], dictionaries: dict[str, DataFrame] | None = None) -> DataFrame:
    """Replace texts by their codes; NULL stays NULL."""
    out = df
    for i, column in enumerate(columns):
        dictionary = (dictionaries or {}).get(column) or label_dictionary(df, column)
        coded = dictionary.select(F.col("value").alias(f"_v{i}"), "copies", F.col("code").cast("double").alias(f"_c{i}"))
        out = lookup_join(out.withColumn(f"_v{i}", name(column).cast("string")), coded, [f"_v{i}"], "copies")
    kept = []
    for c in df.columns:
        kept.append(F.col(f"_c{list(columns).index(c)}").alias(c) if c in columns else name(c))
    return out.select(*kept)


def decode_column(df: DataFrame, column: str, dictionary: DataFrame) -> DataFrame:
    """Round half-even, clip into the code range, look the text up."""
    size = dictionary.agg(F.max("code")).first()[0]
    if size is None:
        return df.withColumn(column, F.lit(None).cast("string"))
    rounded = F.bround(name(column).cast("double"), 0).cast("bigint")
    code = F.when(rounded.isNotNull(), F.greatest(F.lit(0), F.least(F.lit(size), rounded)))
    texts = dictionary.select(F.col("value").alias("_text"), F.col("code").cast("bigint").alias("_at"), "copies")
    joined = lookup_join(df.withColumn("_at", code), texts, ["_at"], "copies")
    return joined.select(*[F.col("_text").alias(c) if c == column else name(c) for c in df.columns])


def category_like(df: DataFrame, columns: Sequence[str], limit: int = CATEGORY_LIMIT) -> list[str]:
    """Columns with fewer than ``limit`` distinct observed values.

    A sketch rules out the wide columns in one pass; only near candidates are counted exactly.
    """
    sketch = df.agg(*[F.approx_count_distinct(name(c)).alias(f"n{i}") for i, c in enumerate(columns)]).first()
    near = [c for i, c in enumerate(columns) if sketch[f"n{i}"] < 2 * limit + 10]
    if not near:
        return []
    exact = df.agg(*[F.count_distinct(name(c)).alias(f"n{i}") for i, c in enumerate(near)]).first()
    return [c for i, c in enumerate(near) if exact[f"n{i}"] < limit]


def round_category_like(imputed: DataFrame, original: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Round half-even the imputed columns whose observed values look like categories."""
    chosen = set(category_like(original, columns))
    return imputed.select(
        *[F.bround(name(c).cast("double"), 0).alias(c) if c in chosen else name(c) for c in imputed.columns]
    )
