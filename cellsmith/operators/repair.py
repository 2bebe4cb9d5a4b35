"""Correction of flagged cells: embeddings, retrieval, examples, value functions, provider repair."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from cellsmith.functions.scalars import any_true, name, null_text, total
from cellsmith.functions.text import unflagged_json
from cellsmith.operators.lookup import lookup_join
from cellsmith.operators.similarity import knn_join
from cellsmith.session import checkpointed, spread_rows
from cellsmith.sources.tables import align

EMBED_DIMS = 32
NEIGHBOURS = 30
KEEP = 3
GRAM_MIX = (7919, 104729, 1299709)
GRAM_MODULUS = 1_000_003

# Texts that stand for a missing cell, and the error type names.
NULL_TOKENS = ["", "null", "nan", "n/a", "na", "none", "unknown"]
MISSING_VALUE = "Missing Value"
FORMATTING_ISSUE = "Formatting Issue"
TYPO = "Typo"
FD_VIOLATION = "Violation of Functional Dependency"
CLEAN = "clean"


def cell_embedding(value: Column, dims: int = EMBED_DIMS) -> Column:
    """L2-normalised counts of hashed character trigrams of ``^text$``; NULL reads ``null``.

    A trigram's slot is a fixed linear mix of its three code points: integer work only. Tasks embed a batch of texts at a time.
    """

    @F.arrow_udf(T.ArrayType(T.DoubleType()))
    def embedded(texts: pa.Array) -> pa.Array:
        vectors = trigram_vectors(texts.to_pylist(), dims)
        ends = np.arange(0, vectors.size + 1, dims, dtype="int32")
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(vectors.ravel()))

    return embedded(null_text(value))


def trigram_vectors(texts: Sequence[str], dims: int) -> np.ndarray:
    """One row per text; a text of two code points with its marks (an empty one) has one trigram that ends with 0."""
    lengths = np.fromiter((len(t) + 2 for t in texts), dtype="int64", count=len(texts))
    codes = np.frombuffer("".join(f"^{t}$" for t in texts).encode("utf-32-le", "surrogatepass"), dtype="uint32").astype("int64")
    codes = np.append(codes, [0, 0])
    grams = np.maximum(lengths - 2, 1)
    row = np.repeat(np.arange(len(texts)), grams)
    first = np.repeat(np.cumsum(lengths) - lengths - (np.cumsum(grams) - grams), grams) + np.arange(len(row))
    third = np.where(lengths[row] > 2, codes[first + 2], 0)
    mixed = codes[first] * GRAM_MIX[0] + codes[first + 1] * GRAM_MIX[1] + third * GRAM_MIX[2]
    counts = np.bincount(row * dims + mixed % GRAM_MODULUS % dims, minlength=len(texts) * dims).reshape(-1, dims).astype(float)
    return counts / np.sqrt((counts * counts).sum(1))[:, None]


def _times(vec: Column, factor: Column) -> Column:
    return F.transform(vec, lambda v: v.cast("double") * factor)


def embedding_dictionary(df: DataFrame, columns: Sequence[str], dims: int = EMBED_DIMS) -> DataFrame:
    """(value, vec) once per distinct text over the given columns."""
    cells = df.select(*[null_text(name(c)).alias(c) for c in columns]).unpivot([], [name(c) for c in columns], "col", "value")
    values = cells.select("value").distinct()
    return values.select("value", cell_embedding(F.col("value"), dims).alias("vec"))


def row_vector(columns: Sequence[str], dims: int = EMBED_DIMS, flags: Mapping[str, Column] | None = None, weights: Mapping[str, float] | None = None) -> Column:
    """Concatenated cell embeddings of a row; flagged cells become zeros, each block takes its weight."""
    blocks = []
    for c in columns:
        block = cell_embedding(name(c), dims)
        if weights is not None:
            block = _times(block, F.lit(float(weights[c])))
        if flags is not None:
            block = F.when(F.coalesce(flags[c].cast("boolean"), F.lit(False)), F.array_repeat(F.lit(0.0), dims)).otherwise(block)
        blocks.append(block)
    return F.concat(*blocks)


def masked_row_vectors(df: DataFrame, mask: DataFrame, key: str, columns: Sequence[str], dims: int = EMBED_DIMS) -> DataFrame:
    """(key, vec) of rows with at least one flag; only the flagged cells carry their embedding."""
    flags = mask.select(name(key), *[name(c).cast("boolean").alias(f"_f_{c}") for c in columns])
    joined = spread_rows(df.join(flags.filter(any_true([name(f"_f_{c}") for c in columns])), key), df.count())
    clean = {c: ~F.coalesce(name(f"_f_{c}"), F.lit(False)) for c in columns}
    return joined.select(name(key), row_vector(columns, dims, clean).alias("vec"))


def retrieval_index(df: DataFrame, mask: DataFrame, key: str, target: str, columns: Sequence[str], dims: int = EMBED_DIMS) -> DataFrame:
    """One entry per row: unmasked vector, context of unflagged cells, target flag and flag count."""
    joined = align({"d": df, "m": mask}, key)
    # The join leaves small rows to few tasks; embeddings make them large.
    joined = spread_rows(joined, df.count())
    opened = joined.select(name(key), "d.*", *[F.col("m").getField(c).cast("boolean").alias(f"_f_{c}") for c in columns if c != target], F.col("m").getField(target).cast("boolean").alias(f"_f_{target}"))
    flags = {c: name(f"_f_{c}") for c in columns}
    return opened.select(
        name(key).alias("id"),
        row_vector(columns, dims).alias("vec"),
        unflagged_json(columns, list(flags.values())).alias("context"),
        name(target).cast("string").alias("target_value"),
        F.coalesce(name(f"_f_{target}"), F.lit(False)).cast("int").alias("target_flag"),
        total([F.coalesce(f.cast("int"), F.lit(0)) for f in flags.values()]).alias("flag_count"),
    )


def query_vectors(df: DataFrame, mask: DataFrame, key: str, cells: DataFrame, weights: Mapping[str, float], dims: int = EMBED_DIMS) -> DataFrame:
    """Vectors of the query rows in ``cells``: flagged cells zeroed, blocks weighted."""
    columns = list(weights)
    flags = mask.select(name(key), *[name(c).cast("boolean").alias(f"_f_{c}") for c in columns])
    rows = spread_rows(df.join(cells.select(name(key)).distinct(), key, "left_semi").join(flags, key), df.count())
    vec = row_vector(columns, dims, {c: name(f"_f_{c}") for c in columns}, weights)
    return rows.select(name(key).alias("id"), vec.alias("vec"))


def zero_and_weight(vec: Column, flags: Sequence[Column], weights: Sequence[float], dims: int) -> Column:
    """The same for a ready-made vector of equal blocks."""
    out = []
    for i, (flag, weight) in enumerate(zip(flags, weights)):
        block = F.slice(vec, i * dims + 1, dims)
        keep = F.when(F.coalesce(flag.cast("boolean"), F.lit(False)), F.lit(0.0)).otherwise(F.lit(float(weight)))
        out.append(_times(block, keep))
    return F.concat(*out)


def retrieve(queries: DataFrame, index: DataFrame, dims: int, k: int = NEIGHBOURS, digits: int = 9) -> DataFrame:
    """k nearest entries of each query joined to their context columns."""
    near = checkpointed(knn_join(queries.select("id", "vec"), index.select("id", "vec"), k, dims, digits=digits))
    degree = near.groupBy("iid").agg(F.count("*").alias("links"))
    extra = index.drop("vec").withColumnRenamed("id", "iid").join(degree, "iid")
    return lookup_join(near, extra, ["iid"], "links", "inner")


def rerank(hits: DataFrame, keep: int = KEEP) -> DataFrame:
    """Best ``keep`` per query by (score to 2 decimals, target flagged, flag count, id)."""
    order = Window.partitionBy("qid").orderBy(F.round("d2", 2), "target_flag", "flag_count", "iid")
    return hits.withColumn("position", F.row_number().over(order)).filter(F.col("position") <= keep)


def joined_contexts(kept: DataFrame) -> DataFrame:
    """(qid, neighbours): kept contexts in order, one per line."""
    ordered = F.sort_array(F.collect_list(F.struct("position", "context")))
    return kept.groupBy("qid").agg(F.array_join(F.transform(ordered, lambda e: e["context"]), "\n").alias("neighbours"))


def upsert_index(index: DataFrame, entries: DataFrame, key: str = "id") -> DataFrame:
    """Replace the entries of repaired rows."""
    return index.join(entries.select(name(key)), key, "left_anti").unionByName(entries.select(*index.columns))


def neighbour_majority(hits: DataFrame) -> DataFrame:
    """Most frequent target value among the unflagged neighbours of each query, least on a tie."""
    votes = hits.filter((F.col("target_flag") == 0) & F.col("target_value").isNotNull())
    counts = votes.groupBy("qid", "target_value").agg(F.count("*").alias("n"))
    best = counts.groupBy("qid").agg(F.min(F.struct((-F.col("n")).alias("n"), "target_value")).alias("b"))
    return best.select("qid", F.col("b.target_value").alias("correction"))


def _squeezed(value: Column) -> Column:
    """Case, punctuation and trailing units removed."""
    return F.regexp_replace(F.regexp_replace(F.lower(value), r"\s*(oz|ounces|%)\.?$", ""), r"[^a-z0-9]", "")


def error_type(dirty: Column, truth: Column) -> Column:
    return (
        F.when(F.lower(F.trim(null_text(dirty))).isin(*NULL_TOKENS), F.lit(MISSING_VALUE))
        .when((_squeezed(dirty) == _squeezed(truth)) & (_squeezed(truth) != ""), F.lit(FORMATTING_ISSUE))
        .when(F.levenshtein(dirty, truth) <= 2, F.lit(TYPO))
        .otherwise(F.lit(FD_VIOLATION))
    )


def repair_examples(dirty: DataFrame, truth: DataFrame, chosen: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """(row id, col, context, dirty, truth, error_type) for chosen rows whose cell differs from the truth."""
    picked = chosen.select(name(key))
    joined = align(
        {
            "d": dirty.join(picked, key, "left_semi").select(name(key), *[null_text(name(c)).alias(c) for c in columns]),
            "t": truth.join(picked, key, "left_semi").select(name(key), *[null_text(name(c)).alias(c) for c in columns]),
        },
        key,
    )
    entries = F.filter(
        F.array(
            *[
                F.struct(
                    F.lit(c).alias("col"),
                    F.col("d").getField(c).alias("dirty"),
                    F.col("t").getField(c).alias("truth"),
                )
                for c in columns
            ]
        ),
        lambda e: e["dirty"] != e["truth"],
    )
    opened = joined.select(name(key), F.to_json("d").alias("context"), F.explode(entries).alias("e"))
    return opened.select(
        name(key), "e.col", "context", "e.dirty", "e.truth", error_type(F.col("e.dirty"), F.col("e.truth")).alias("error_type")
    )


def clean_examples(dirty: DataFrame, clean_rows: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """Every cell of the clean rows, in the needed columns, as an example that must stay."""
    rows = dirty.join(clean_rows.select(name(key)), key, "left_semi").select(
        name(key), *[null_text(name(c)).alias(c) for c in columns]
    )
    context = F.to_json(F.struct(*[name(c) for c in columns]))
    cells = rows.withColumn("context", context).unpivot([name(key), "context"], [name(c) for c in columns], "col", "dirty")
    return cells.select(name(key), "col", "context", "dirty", F.col("dirty").alias("truth"), F.lit(CLEAN).alias("error_type"))


def split_half(examples: DataFrame, key: str, seed: int = 0, group: str = "col") -> DataFrame:
    """Adds ``part``: an exact seeded half per column; the odd one goes to validation.

    Examples are counted per column and first digits of their hash; only the stretch of
    hashes that holds the middle is ranked row by row, so no task sees a whole column.
    """
    order = F.md5(F.concat_ws("|", F.lit(str(seed)), name(key).cast("string")))
    marked = examples.withColumn("_order", order).withColumn("_stretch", F.substring("_order", 1, 3))
    upto = Window.partitionBy(group).orderBy("_stretch")
    counts = (
        marked.groupBy(group, "_stretch")
        .agg(F.count("*").alias("_n"))
        .withColumn("_before", F.sum("_n").over(upto) - F.col("_n"))
        .withColumn("_half", F.floor(F.sum("_n").over(Window.partitionBy(group)) / 2))
        .drop("_n")
    )
    spot = F.col("_before") + F.row_number().over(Window.partitionBy(group, "_stretch").orderBy("_order", name(key)))
    part = F.when(spot <= F.col("_half"), F.lit("train")).otherwise(F.lit("validation"))
    placed = marked.join(counts, [group, "_stretch"]).withColumn("part", part)
    return placed.select(*[name(c) for c in examples.columns], "part")


def route_columns(examples: DataFrame) -> DataFrame:
    """Path per column: value functions when every example is clean or a formatting issue, else dependency."""
    formatting = F.bool_and(F.col("error_type").isin(CLEAN, FORMATTING_ISSUE))
    return examples.groupBy("col").agg(F.when(formatting, F.lit("value")).otherwise(F.lit("dependency")).alias("path"))


# Value functions tried in order; {v} is the cell text.
VALUE_FUNCTIONS = {
    "same": "{v}",
    "trim": "trim({v})",
    "upper": "upper({v})",
    "lower": "lower({v})",
    "title": "initcap({v})",
    "strip_unit": "regexp_replace({v}, ' *(oz|ounces|%)[.]?$', '')",
    "strip_unit_upper": "upper(regexp_replace({v}, ' *(oz|ounces|%)[.]?$', ''))",
    "strip_unit_lower": "lower(regexp_replace({v}, ' *(oz|ounces|%)[.]?$', ''))",
    "digits_only": "regexp_replace({v}, '[^0-9.]', '')",
    "whole_number": "regexp_replace({v}, '[.]0+$', '')",
    "zero_pad_5": "lpad({v}, 5, '0')",
    "date_iso": "date_format(try_to_timestamp({v}, 'M/d/yy'), 'yyyy-MM-dd')",
    "date_short": "date_format(try_to_timestamp({v}, 'yyyy-MM-dd'), 'M/d/yy')",
}


def value_function_scores(examples: DataFrame, functions: Mapping[str, str] = VALUE_FUNCTIONS) -> DataFrame:
    """(col, function, passes): whether the function reproduces every truth of the column; all in one pass."""
    tests = [
        F.bool_and(F.coalesce(F.expr(f.format(v="dirty")) == F.col("truth"), F.lit(False))).alias(f"ok{i}")
        for i, f in enumerate(functions.values())
    ]
    rows = F.array(
        *[F.struct(F.lit(i).alias("position"), F.lit(n).alias("function"), F.col(f"ok{i}").alias("passes")) for i, n in enumerate(functions)]
    )
    return examples.groupBy("col").agg(*tests).select("col", F.inline(rows))


def choose_value_functions(examples: DataFrame, functions: Mapping[str, str] = VALUE_FUNCTIONS) -> dict[str, str]:
    """First passing function per column."""
    scores = value_function_scores(examples, functions).filter("passes")
    first = scores.groupBy("col").agg(F.min_by("function", "position").alias("function"))
    return {r["col"]: r["function"] for r in first.collect()}


def apply_value_function(df: DataFrame, column: str, flag: Column, expression: str) -> DataFrame:
    """Rewrite the flagged cells of one column; no shuffle."""
    fixed = F.expr(expression.format(v=f"`{column}`"))
    wrong = F.coalesce(flag.cast("boolean"), F.lit(False))
    return df.select(
        *[F.when(wrong, F.coalesce(fixed, name(c))).otherwise(name(c)).alias(c) if c == column else name(c) for c in df.columns]
    )


def residual_cells(dirty: DataFrame, corrected: DataFrame, mask: DataFrame, key: str) -> DataFrame:
    """(row id, col, dirty) of flagged cells whose value no step has changed."""
    marked = mask.filter(any_true([name(c) for c in mask.columns if c != key]))
    joined = align({"m": marked, "d": dirty, "c": corrected}, key)
    columns = joined.schema["d"].dataType.names
    entries = F.filter(
        F.array(
            *[
                F.struct(
                    F.lit(c).alias("col"),
                    null_text(F.col("d").getField(c)).alias("dirty"),
                    null_text(F.col("c").getField(c)).alias("now"),
                    F.coalesce(F.col("m").getField(c).cast("boolean"), F.lit(False)).alias("flag"),
                )
                for c in columns
            ]
        ),
        lambda e: e["flag"] & (e["dirty"] == e["now"]),
    )
    return joined.select(name(key), F.explode(entries).alias("e")).select(name(key), "e.col", "e.dirty")


def apply_cells(df: DataFrame, cells: DataFrame, key: str, value: str = "correction") -> DataFrame:
    """Write (row id, col, value) cells into the wide table."""
    columns = [c for c in df.columns if c != key]
    wide = cells.groupBy(name(key)).agg(*[F.max(F.when(F.col("col") == c, F.col(value))).alias(f"_n_{c}") for c in columns])
    joined = df.join(wide, key, "left")
    return joined.select(name(key), *[F.coalesce(name(f"_n_{c}"), name(c).cast("string")).alias(c) for c in columns])


def repair_log(attempted: DataFrame, key: str) -> DataFrame:
    """One row per attempted cell (row id, col, dirty, correction, source, neighbours), ordered by row id."""
    wanted = [key, "col", "dirty", "correction", "source", "neighbours"]
    return attempted.select(*[name(c) for c in wanted]).orderBy(name(key), "col")
