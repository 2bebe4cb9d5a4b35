"""Left join to a table with unique keys when one key may hold a third of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cellsmith.functions.scalars import name
from cellsmith.session import checkpointed

BROADCAST_ROWS = 100_000
BROADCAST_BYTES = 64 << 20
HOT_KEYS = 1_000


def _small(lookup: DataFrame) -> bool:
    """Counted, not estimated: at most BROADCAST_ROWS rows and BROADCAST_BYTES of content."""
    head = lookup.limit(BROADCAST_ROWS + 1).select(F.length(F.to_json(F.struct("*"))).alias("n"))
    rows, size = head.agg(F.count("*"), F.sum("n")).first()
    return rows <= BROADCAST_ROWS and (size or 0) <= BROADCAST_BYTES


def lookup_join(rows: DataFrame, lookup: DataFrame, keys: Sequence[str], weight: str, how: str = "left") -> DataFrame:
    """``rows`` with the lookup's other columns added; ``weight`` = rows each key stands for, dropped from the result.

    A lookup of checked size is broadcast and ``rows`` never shuffles. Beyond that
    the HOT_KEYS heaviest keys, as far as their content fits BROADCAST_BYTES, are broadcast and only the remaining keys meet by
    shuffle; rows already served are spread evenly by a salt that matches nothing.
    """
    keys = list(keys)
    extra = [c for c in lookup.columns if c not in keys and c != weight]
    lookup = checkpointed(lookup)
    if _small(lookup):
        return rows.join(F.broadcast(lookup.drop(weight)), keys, how)
    heaviest = lookup.orderBy(F.desc(weight), *keys).limit(HOT_KEYS)
    size = F.length(F.to_json(F.struct(*[name(c) for c in lookup.columns])))
    upto = F.sum(size).over(Window.orderBy(F.desc(weight), *keys).rowsBetween(Window.unboundedPreceding, 0))
    hot = heaviest.withColumn("_upto", upto).filter(F.col("_upto") <= BROADCAST_BYTES).drop("_upto")
    held = [F.col(f"_hot_{c}") for c in extra]
    heavy = hot.select(*keys, F.lit(True).alias("_is_hot"), *[name(c).alias(f"_hot_{c}") for c in extra])
    marked = rows.join(F.broadcast(heavy), keys, "left")
    done = F.col("_is_hot").isNotNull()
    for k in keys:
        done = done | name(k).isNull()
    salt = F.when(done, 1 + F.pmod(F.xxhash64(*[name(c) for c in rows.columns]), F.lit(1 << 20))).otherwise(F.lit(0))
    cold = lookup.select(*keys, F.lit(0).cast("bigint").alias("_salt"), F.lit(True).alias("_is_cold"), *[name(c).alias(f"_cold_{c}") for c in extra])
    joined = marked.withColumn("_salt", salt.cast("bigint")).join(cold, [*keys, "_salt"], "left")
    if how == "inner":
        joined = joined.filter(F.col("_is_hot").isNotNull() | F.col("_is_cold").isNotNull())
    out = [F.when(F.col("_is_hot").isNotNull(), h).otherwise(F.col(f"_cold_{c}")).alias(c) for c, h in zip(extra, held)]
    return joined.select(*[name(c) for c in rows.columns], *out)
