"""Dirty variants of the shared tables, each as a Spark frame and as SQL with the same rule."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellsmith.operators.detect import inject_missing
from cellsmith.session import spread
from workload.registry import sql_unit, table

# --- orders joined with the customer segment; the segment is blanked or overwritten by key ---------------------

ORDERS_SQL = """
clean AS (
  SELECT o_orderkey AS row_id, CAST(o_custkey AS VARCHAR) AS custkey, o_orderstatus AS status, c_mktsegment AS segment
  FROM orders JOIN customer ON o_custkey = c_custkey),
dirty AS (
  SELECT row_id, custkey, status,
         CASE WHEN row_id % 10 = 3 THEN NULL WHEN row_id % 10 = 7 THEN 'XX' ELSE segment END AS segment FROM clean),
mask AS (
  SELECT row_id, false AS custkey, false AS status, (row_id % 10 = 3 OR row_id % 10 = 7) AS segment FROM clean)"""


def orders_clean(spark: SparkSession, sf: str) -> DataFrame:
    orders = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    customer = table(spark, sf, "customer").select("c_custkey", "c_mktsegment")
    joined = orders.join(customer, orders.o_custkey == customer.c_custkey)
    return joined.select(
        F.col("o_orderkey").alias("row_id"),
        F.col("o_custkey").cast("string").alias("custkey"),
        F.col("o_orderstatus").alias("status"),
        F.col("c_mktsegment").alias("segment"),
    )


def orders_dirty(clean: DataFrame) -> DataFrame:
    step = F.col("row_id") % 10
    segment = F.when(step == 3, F.lit(None)).when(step == 7, F.lit("XX")).otherwise(F.col("segment"))
    return clean.select("row_id", "custkey", "status", segment.alias("segment"))


def orders_mask(clean: DataFrame) -> DataFrame:
    no = F.lit(False)
    return clean.select(
        "row_id", no.alias("custkey"), no.alias("status"), (F.col("row_id") % 10).isin(3, 7).alias("segment")
    )


# --- order priority with formatting errors and gaps ------------------------------------------------------------

PRIORITY_SQL = """
clean AS (SELECT o_orderkey AS row_id, o_orderstatus AS status, o_orderpriority AS priority FROM orders),
dirty AS (
  SELECT row_id, status,
         CASE WHEN row_id % 13 = 5 THEN lower(priority) WHEN row_id % 13 = 8 THEN priority || ' oz'
              WHEN row_id % 13 = 11 THEN NULL ELSE priority END AS priority FROM clean),
mask AS (SELECT row_id, false AS status, row_id % 13 IN (5, 8, 11) AS priority FROM clean)"""


def priority_clean(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("row_id"), F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority")
    )


def priority_dirty(clean: DataFrame) -> DataFrame:
    step = F.col("row_id") % 13
    priority = (
        F.when(step == 5, F.lower("priority"))
        .when(step == 8, F.concat("priority", F.lit(" oz")))
        .when(step == 11, F.lit(None))
        .otherwise(F.col("priority"))
    )
    return clean.select("row_id", "status", priority.alias("priority"))


def priority_formatted(clean: DataFrame) -> DataFrame:
    """The formatting errors of ``priority_dirty`` without its gaps, so that a function of the cell can give every truth."""
    dirty = priority_dirty(clean).select("row_id", F.col("priority").alias("_priority"))
    filled = F.coalesce("_priority", "priority").alias("priority")
    return clean.join(dirty, "row_id").select("row_id", "status", filled)


def priority_mask(clean: DataFrame) -> DataFrame:
    return clean.select(
        "row_id", F.lit(False).alias("status"), (F.col("row_id") % 13).isin(5, 8, 11).alias("priority")
    )


# --- part names with a typo ------------------------------------------------------------------------------------

TYPO_SQL = """
clean AS (SELECT p_partkey AS row_id, p_name AS name, p_brand AS brand, p_type AS kind FROM part),
dirty AS (
  SELECT row_id, CASE WHEN row_id % 9 = 4 THEN substr(name, 1, 1) || 'x' || substr(name, 3) ELSE name END AS name, brand, kind
  FROM clean),
mask AS (SELECT row_id, row_id % 9 = 4 AS name, false AS brand, false AS kind FROM clean)"""


def typo_clean(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").select(
        F.col("p_partkey").alias("row_id"), F.col("p_name").alias("name"), F.col("p_brand").alias("brand"), F.col("p_type").alias("kind")
    )


def typo_dirty(clean: DataFrame) -> DataFrame:
    typo = F.concat(F.substring("name", 1, 1), F.lit("x"), F.substring("name", 3, 10_000))
    name = F.when(F.col("row_id") % 9 == 4, typo).otherwise(F.col("name"))
    return clean.select("row_id", name.alias("name"), "brand", "kind")


def typo_mask(clean: DataFrame) -> DataFrame:
    no = F.lit(False)
    return clean.select("row_id", (F.col("row_id") % 9 == 4).alias("name"), no.alias("brand"), no.alias("kind"))


# --- correlated line-item numbers with gaps --------------------------------------------------------------------

PRICE_COLUMNS = ["price", "net", "charge", "qty"]
GAP_RATE = 0.2

_ROW_ID_SQL = (
    "md5(concat_ws('|', l_orderkey, l_partkey, l_suppkey, l_linenumber, CAST(l_quantity AS DECIMAL(18,2)), "
    "CAST(l_extendedprice AS DECIMAL(18,2)), CAST(l_discount AS DECIMAL(18,2)), CAST(l_tax AS DECIMAL(18,2)), "
    "l_returnflag, l_linestatus, strftime(l_shipdate, '%Y-%m-%d')))"
)


def _gap(column: str) -> str:
    unit = sql_unit(f"'gap0|' || row_id || '|{column}'")
    return f"CASE WHEN {unit} >= {GAP_RATE} THEN {column} END AS {column}"


PRICE_SQL = f"""
truth AS (
  SELECT {_ROW_ID_SQL} AS row_id, l_extendedprice AS price, l_extendedprice * (1 - l_discount) AS net,
         l_extendedprice * (1 - l_discount) * (1 + l_tax) AS charge, l_quantity AS qty FROM lineitem),
gaps AS (SELECT row_id, {', '.join(_gap(c) for c in PRICE_COLUMNS)} FROM truth)"""


def price_truth(spark: SparkSession, sf: str) -> DataFrame:
    line = spread(table(spark, sf, "lineitem"))

    def fixed(c: str):
        return F.col(c).cast("decimal(18,2)").cast("string")

    row_id = F.md5(
        F.concat_ws(
            "|",
            "l_orderkey",
            "l_partkey",
            "l_suppkey",
            "l_linenumber",
            fixed("l_quantity"),
            fixed("l_extendedprice"),
            fixed("l_discount"),
            fixed("l_tax"),
            "l_returnflag",
            "l_linestatus",
            F.date_format("l_shipdate", "yyyy-MM-dd"),
        )
    )
    net = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    return line.select(
        row_id.alias("row_id"),
        F.col("l_extendedprice").alias("price"),
        net.alias("net"),
        (net * (1 + F.col("l_tax"))).alias("charge"),
        F.col("l_quantity").alias("qty"),
    )


def price_gaps(truth: DataFrame) -> DataFrame:
    return inject_missing(truth, "row_id", PRICE_COLUMNS, GAP_RATE)


# --- part numbers with gaps ------------------------------------------------------------------------------------

PART_COLUMNS = ["size", "price", "width"]

PART_SQL = """
truth AS (
  SELECT p_partkey AS row_id, CAST(p_size AS DOUBLE) AS size, p_retailprice AS price, CAST(length(p_name) AS DOUBLE) AS width
  FROM part),
gaps AS (
  SELECT row_id, CASE WHEN row_id % 7 <> 2 THEN size END AS size, CASE WHEN row_id % 11 <> 5 THEN price END AS price, width
  FROM truth)"""


def part_truth(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").select(
        F.col("p_partkey").alias("row_id"),
        F.col("p_size").cast("double").alias("size"),
        F.col("p_retailprice").alias("price"),
        F.length("p_name").cast("double").alias("width"),
    )


def part_gaps(truth: DataFrame) -> DataFrame:
    return truth.select(
        "row_id",
        F.when(F.col("row_id") % 7 != 2, F.col("size")).alias("size"),
        F.when(F.col("row_id") % 11 != 5, F.col("price")).alias("price"),
        "width",
    )


# --- vectors ---------------------------------------------------------------------------------------------------

VECTOR_DIMS = 64

VECTOR_SQL = "vecs AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v, label FROM embeddings)"


def vectors(spark: SparkSession, sf: str) -> DataFrame:
    base = table(spark, sf, "embeddings")
    return base.select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("vec"), "label")


def sql_d2(a: str, b: str) -> str:
    """Squared distance of two lists, summed by list functions."""
    return f"list_sum(list_transform(list_zip({a}, {b}), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"


# --- nation and region beside every customer -------------------------------------------------------------------

CHAIN_COLUMNS = ["nation", "region", "segment"]

CHAIN_SQL = """
chain AS (
  SELECT c_custkey AS row_id, n_name AS nation, r_name AS region, c_mktsegment AS segment
  FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""


def chain(spark: SparkSession, sf: str) -> DataFrame:
    customer = table(spark, sf, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    nation = table(spark, sf, "nation")
    region = table(spark, sf, "region")
    return (
        customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
        .join(region, F.col("n_regionkey") == F.col("r_regionkey"))
        .select(
            F.col("c_custkey").alias("row_id"),
            F.col("n_name").alias("nation"),
            F.col("r_name").alias("region"),
            F.col("c_mktsegment").alias("segment"),
        )
    )
