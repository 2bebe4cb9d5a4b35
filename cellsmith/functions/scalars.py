"""Scalar expressions on single cells (features, compare forms, coercion, scaling)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FEATURES = [f"f{i}" for i in range(9)]


def name(column: str) -> Column:
    """Column by exact name; source headers may hold hyphens, dots or blanks."""
    return F.col("`" + column.replace("`", "``") + "`")


def total(columns: Sequence[Column]) -> Column:
    out = columns[0]
    for column in columns[1:]:
        out = out + column
    return out


def any_true(columns: Sequence[Column]) -> Column:
    out = F.lit(False)
    for column in columns:
        out = out | F.coalesce(column.cast("boolean"), F.lit(False))
    return out


def trimmed_text(column: Column) -> Column:
    """NULL becomes the empty text; surrounding white space is ignored."""
    return F.trim(F.coalesce(column.cast("string"), F.lit("")))


def plain_text(column: Column) -> Column:
    """NULL becomes the empty text; white space counts."""
    return F.coalesce(column.cast("string"), F.lit(""))


def null_text(column: Column) -> Column:
    """All-text view used by correction: NULL becomes the text ``null``."""
    return F.coalesce(column.cast("string"), F.lit("null"))


def to_number(column: Column) -> Column:
    return column.try_cast("double")


def zero_if_missing(column: Column) -> Column:
    return F.coalesce(F.nanvl(column.cast("double"), F.lit(0.0)), F.lit(0.0))


def number_or_null(value: Column) -> Column:
    """The cell as a double; NaN counts as missing and becomes NULL."""
    return F.nanvl(value.cast("double"), F.lit(None).cast("double"))


def mask_flag(column: Column) -> Column:
    """Mask literal to boolean; an unknown literal raises instead of turning into a flag."""
    text = F.lower(F.trim(column.cast("string")))
    return (
        F.when(text.isin("true", "1", "1.0"), F.lit(True))
        .when(text.isin("false", "0", "0.0"), F.lit(False))
        .otherwise(F.raise_error(F.concat(F.lit("not a mask literal: "), F.coalesce(text, F.lit("NULL")))))
    )


def hash_bucket(text: Column, buckets: int) -> Column:
    """Stable bucket of a text: the same value in every session and in plain SQL."""
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint") % F.lit(buckets)


def hash_unit(*parts: Column, buckets: int = 1_000_000) -> Column:
    """Repeatable uniform in [0, 1) from a key; independent of partitioning."""
    return hash_bucket(F.concat_ws("|", *[p.cast("string") for p in parts]), buckets) / F.lit(float(buckets))


def cell_features(value: Column) -> list[Column]:
    """Nine numbers per cell: number, length, digits, letters, other, first, last, hash, missing."""
    text = value.cast("string")
    text = F.when(text.isNull() | (text == ""), F.lit("nan")).otherwise(text)
    missing = text == "nan"
    number = F.regexp_replace(text, r"[^0-9.\-]", "").try_cast("double")
    length = F.length(text).cast("double")
    digits = F.regexp_count(text, F.lit(r"\p{Nd}")).cast("double")
    letters = F.regexp_count(text, F.lit("[a-zA-Z]")).cast("double")
    zero = F.lit(0.0)
    columns = [
        F.coalesce(number, zero),
        length,
        digits,
        letters,
        length - digits - letters,
        F.when(missing, zero).otherwise(F.ascii(text).cast("double")),
        F.when(missing, zero).otherwise(F.ascii(F.substring(text, -1, 1)).cast("double")),
        F.when(missing, zero).otherwise(hash_bucket(text, 10_000) / 10_000.0),
        missing.cast("double"),
    ]
    return [c.alias(n) for c, n in zip(columns, FEATURES)]


def feature_dictionary(df: DataFrame, column: str) -> DataFrame:
    """One feature row per distinct text value; join it back on ``value``."""
    values = df.select(name(column).cast("string").alias("value")).distinct()
    return values.select("value", *cell_features(F.col("value")))


def batch_features(df: DataFrame, key: str, column: str) -> DataFrame:
    """Features of every row in place: cheaper than shipping texts to a dictionary and back."""
    return df.select(name(key), name(column).cast("string").alias("value"), *cell_features(name(column)))


def minmax_stats(df: DataFrame, columns: Sequence[str], shifted: bool = False) -> dict[str, dict[str, float]]:
    """Range of each column from one aggregate.

    ``shifted=False``: den = max - min, 0 becomes 1e-6.
    ``shifted=True``: den = (max - min) + 1e-6 always.
    """
    row = df.agg(
        *[F.min(F.nanvl(name(c).cast("double"), F.lit(None).cast("double"))).alias(f"lo{i}") for i, c in enumerate(columns)],
        *[F.max(F.nanvl(name(c).cast("double"), F.lit(None).cast("double"))).alias(f"hi{i}") for i, c in enumerate(columns)],
    ).first()
    stats = {}
    for i, column in enumerate(columns):
        low, high = row[f"lo{i}"], row[f"hi{i}"]
        if low is None:
            low = high = 0.0
        span = high - low
        stats[column] = {"min": low, "max": high, "den": span + 1e-6 if shifted else (span or 1e-6)}
    return stats


def scaled(column: Column, stat: Mapping[str, float]) -> Column:
    return (column.cast("double") - F.lit(stat["min"])) / F.lit(stat["den"])


def unscaled(column: Column, stat: Mapping[str, float]) -> Column:
    return column * F.lit(stat["den"]) + F.lit(stat["min"])


def noise(key: Column, column: str, seed: int, high: float = 0.01) -> Column:
    """Uniform noise in [0, high) for one missing cell, repeatable by key."""
    return hash_unit(F.lit(f"noise{seed}"), key, F.lit(column)) * F.lit(high)


def bernoulli_above(key: Column, column: str, p: float, seed: int) -> Column:
    """1 where the key's uniform exceeds ``p`` (hint draw)."""
    return (hash_unit(F.lit(f"hint{seed}"), key, F.lit(column)) > F.lit(p)).cast("int")


def bernoulli_below(key: Column, column: str, p: float, seed: int = 50) -> Column:
    """1 where the key's uniform is below ``p``."""
    return (hash_unit(F.lit(f"mask{seed}"), key, F.lit(column)) < F.lit(p)).cast("int")
