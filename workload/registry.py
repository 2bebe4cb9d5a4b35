"""Name -> (Spark query, reference SQL or None)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"registered twice: {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def r6(column: Column, alias: str) -> Column:
    """Six decimals; a negative zero becomes zero."""
    return (F.round(column.cast("double"), 6) + F.lit(0.0)).alias(alias)


def sql_bucket(text: str, buckets: int) -> str:
    return f"(CAST('0x' || substr(md5({text}), 1, 8) AS BIGINT) % {buckets})"


def sql_unit(text: str) -> str:
    return f"({sql_bucket(text, 1_000_000)} / 1000000.0::DOUBLE)"
