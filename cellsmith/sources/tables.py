"""Reading, aligning and writing tables keyed by an explicit row id."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, DataFrameReader, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cellsmith.functions.scalars import any_true, mask_flag, name, null_text


def _csv(spark: SparkSession, multi_line: bool) -> DataFrameReader:
    return spark.read.option("header", True).option("quote", '"').option("escape", '"').option("multiLine", multi_line)


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str | None = None, multi_line: bool = False) -> DataFrame:
    """CSV with header. Pass a schema for large inputs; inference costs one more scan.

    ``multi_line``: cells may hold line breaks. Such a file cannot be split and is read by one task.
    """
    reader = _csv(spark, multi_line)
    if schema is None:
        return reader.option("inferSchema", True).csv(path)
    return reader.schema(schema).csv(path)


def read_csv_text(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """CSV as all text with NULL written ``null``."""
    raw = _csv(spark, multi_line).csv(path)
    return raw.select(*[null_text(name(c)).alias(c) for c in raw.columns])


def table_shape(df: DataFrame) -> tuple[int, int, list[str]]:
    return df.count(), len(df.columns), list(df.columns)


def is_numeric(field: T.StructField) -> bool:
    return isinstance(field.dataType, (T.NumericType, T.BooleanType))


def column_kinds(df: DataFrame) -> dict[str, str]:
    return {f.name: "Numeric" if is_numeric(f) else "Categorical" for f in df.schema.fields}


def drop_position_columns(df: DataFrame) -> DataFrame:
    return df.drop(*[c for c in ("index", "Unnamed: 0", "_c0") if c in df.columns])


def normalise_mask(mask: DataFrame, key: str) -> DataFrame:
    """Mask literals (True/False/1/0 in any form) to booleans."""
    return mask.select(name(key), *[mask_flag(name(c)).alias(c) for c in mask.columns if c != key])


def missing_mask(df: DataFrame, key: str, columns: Sequence[str], beside: str | None = None) -> DataFrame:
    """1 = observed, 0 = missing, from NULL or NaN; with ``beside`` as a struct of that name behind the columns of ``df``."""
    kinds = {f.name: f.dataType for f in df.schema.fields}

    def observed(c: str):
        present = name(c).isNotNull()
        if isinstance(kinds[c], (T.DoubleType, T.FloatType)):
            present = present & ~F.isnan(name(c))
        return present.cast("int").alias(c)

    flags = [observed(c) for c in columns]
    return df.withColumn(beside, F.struct(*flags)) if beside else df.select(name(key), *flags)


def blank_by_mask(df: DataFrame, mask: DataFrame, key: str, columns: Sequence[str], blank_when: int) -> DataFrame:
    """NULL the cells whose mask equals ``blank_when``; other columns pass through."""
    joined = align({"d": df, "m": mask}, key, {"d": [c for c in df.columns if c != key], "m": list(columns)})
    kept = []
    for c in df.columns:
        if c == key:
            kept.append(name(key))
        elif c in columns:
            kept.append(F.when(F.col("m").getField(c).cast("int") != F.lit(blank_when), F.col("d").getField(c)).alias(c))
        else:
            kept.append(F.col("d").getField(c).alias(c))
    return joined.select(*kept)


def common_columns(tables: Sequence[DataFrame], key: str) -> list[str]:
    first, *rest = tables
    return [c for c in first.columns if c != key and all(c in t.columns for t in rest)]


def align(tables: Mapping[str, DataFrame], key: str, columns: Mapping[str, Sequence[str]] | None = None) -> DataFrame:
    """Inner join on the row id; each table becomes one struct column named by its alias.

    All joins share the key, so every table is shuffled at most once.
    """
    shared = common_columns(list(tables.values()), key)
    out = None
    for alias, table in tables.items():
        picked = list(columns[alias]) if columns else shared
        part = table.select(name(key), F.struct(*[name(c) for c in picked]).alias(alias))
        out = part if out is None else out.join(part, key, "inner")
    return out


def detection_inputs(dirty: DataFrame, mask: DataFrame, key: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Dirty table, its mode-filled label-encoded copy, and the row truth (any flagged cell)."""
    from cellsmith.operators.encode import encode_columns
    from cellsmith.operators.fill import mode_fill

    dirty = dirty.drop(*[c for c in ("index",) if c != key])
    mask = mask.drop(*[c for c in ("index",) if c != key])
    flags = normalise_mask(mask, key)
    truth = flags.select(name(key), any_true([name(c) for c in flags.columns if c != key]).cast("int").alias("label"))
    columns = [c for c in dirty.columns if c != key]
    filled = mode_fill(dirty, columns)
    text_columns = [f.name for f in dirty.schema.fields if f.name != key and not is_numeric(f)]
    return dirty, encode_columns(filled, text_columns), truth


def preview(df: DataFrame, key: str, rows: int = 1000) -> DataFrame:
    return df.orderBy(name(key)).limit(rows)


def result_payload(df: DataFrame, mask: DataFrame, key: str, rows: int = 1000) -> DataFrame:
    """First ``rows`` rows as JSON objects, each with its mask row.

    The limit runs before the join, so only the head of the table meets the mask.
    """
    columns = [c for c in df.columns if c != key]
    shown = [c for c in columns if c in mask.columns]
    head = preview(df, key, rows).select(
        name(key), F.to_json(F.struct(*[name(c) for c in columns]), {"ignoreNullFields": "false"}).alias("row")
    )
    # The head has at most ``rows`` rows, so it goes to the mask and not the mask to it.
    flags = mask.join(F.broadcast(head.limit(rows)), key, "inner")
    rendered = F.to_json(F.struct(*[name(c).cast("boolean").alias(c) for c in shown])).alias("mask")
    return flags.select(name(key), F.col("row"), rendered)


def write_corrections(df: DataFrame, path: str, fmt: str = "csv", mode: str = "overwrite") -> None:
    writer = df.write.mode(mode)
    if fmt == "csv":
        writer.option("header", True).option("quote", '"').option("escape", '"').csv(path)
    else:
        writer.format(fmt).save(path)


def save_state(spark: SparkSession, state: dict, path: str) -> None:
    """Small fitted state (numbers, names, weights) as one JSON line in shared storage."""
    spark.createDataFrame([(json.dumps(state),)], "state string").coalesce(1).write.mode("overwrite").text(path)


def load_state(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(path, wholetext=True).first()[0])
