"""Dependency between columns: mutual information, functional dependencies, declared rules.

All column pairs are counted in one pass (pair id, left value, right value) with
map-side combine; entropies follow from the counts, so no pair needs a job or a join of its own.
"""

from __future__ import annotations

import json
import re
from collections.abc import Mapping, Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cellsmith.functions.scalars import name
from cellsmith.operators.lookup import lookup_join

MISSING = "nan"


def _pairs(columns: Sequence[str]) -> list[tuple[int, str, str]]:
    return [(i, a, b) for i, (a, b) in enumerate(combinations(columns, 2))]


def pair_counts(df: DataFrame, pairs: Sequence[tuple[int, str, str]], missing: str | None = MISSING) -> DataFrame:
    """(pair, a, b, n) for all column pairs; with ``missing`` set, rows holding that text on either side drop out."""
    columns = sorted({c for _, a, b in pairs for c in (a, b)})
    texts = df.select(*[F.coalesce(name(c).cast("string"), F.lit(missing or "null")).alias(c) for c in columns])
    entries = F.array(*[F.struct(F.lit(i).alias("pair"), name(a).alias("a"), name(b).alias("b")) for i, a, b in pairs])
    opened = texts.select(F.explode(entries).alias("e")).select("e.pair", "e.a", "e.b")
    if missing is not None:
        opened = opened.filter((F.col("a") != missing) & (F.col("b") != missing))
    return opened.groupBy("pair", "a", "b").agg(F.count("*").alias("n"))


def _entropy_sums(counts: DataFrame) -> DataFrame:
    """Per pair: n and the sums of n*ln(n) over joint, left and right counts."""
    sides = F.array(
        F.struct(F.lit("ab").alias("side"), F.col("a").alias("u"), F.col("b").alias("v")),
        F.struct(F.lit("a").alias("side"), F.col("a").alias("u"), F.lit(None).cast("string").alias("v")),
        F.struct(F.lit("b").alias("side"), F.lit(None).cast("string").alias("u"), F.col("b").alias("v")),
    )
    margins = (
        counts.select("pair", "n", F.explode(sides).alias("s"))
        .groupBy("pair", "s.side", "s.u", "s.v")
        .agg(F.sum("n").cast("double").alias("n"))
    )
    log_sum = margins.groupBy("pair", "side").agg(F.sum(F.col("n") * F.log("n")).alias("s"), F.sum("n").alias("n"))
    return log_sum.groupBy("pair").agg(
        F.max("n").alias("n"),
        *[F.max(F.when(F.col("side") == side, F.col("s"))).alias(f"s_{side}") for side in ("ab", "a", "b")],
    )


def _named_pairs(spark: SparkSession, pairs: Sequence[tuple[int, str, str]]) -> DataFrame:
    return spark.createDataFrame(list(pairs), "pair int, col_a string, col_b string")


def nmi_pairs(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Normalised mutual information of every column pair: 2*MI / (H1 + H2), MI in nats, entropies in bits."""
    pairs = _pairs(columns)
    sums = _entropy_sums(pair_counts(df, pairs))
    n, ln_n = F.col("n"), F.log("n")
    mutual = F.greatest(ln_n + (F.col("s_ab") - F.col("s_a") - F.col("s_b")) / n, F.lit(0.0))
    entropy = (2 * ln_n - (F.col("s_a") + F.col("s_b")) / n) / F.log(F.lit(2.0))
    scored = sums.select("pair", F.when(entropy > 1e-12, 2 * mutual / entropy).otherwise(0.0).alias("nmi"))
    named = _named_pairs(df.sparkSession, pairs)
    return named.join(scored, "pair", "left").select("pair", "col_a", "col_b", F.coalesce("nmi", F.lit(0.0)).alias("nmi"))


def related_columns(scores: DataFrame, top: int = 1) -> DataFrame:
    """Best ``top`` partners of each column, ties in pair order."""
    both = scores.select("pair", F.col("col_a").alias("col"), F.col("col_b").alias("related"), "nmi").unionByName(
        scores.select("pair", F.col("col_b").alias("col"), F.col("col_a").alias("related"), "nmi")
    )
    order = Window.partitionBy("col").orderBy(F.desc(F.round("nmi", 9)), "pair")
    return both.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top).select(
        "col", "related", "nmi", "rank"
    )


def cooccurrence_mi(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(target, col, score) for every ordered pair: MI over distinct value pairs seen more than once,

    each with weight one; a column against itself scores its entropy; each target's
    scores are divided by their maximum. NULL reads as ``null``.
    """
    pairs = _pairs(columns)
    counts = pair_counts(df, pairs, missing=None)
    repeated = counts.filter(F.col("n") > 1).withColumn("n", F.lit(1))
    sums = _entropy_sums(repeated)
    mutual = F.log("n") + (F.col("s_ab") - F.col("s_a") - F.col("s_b")) / F.col("n")
    cross = _named_pairs(df.sparkSession, pairs).join(sums, "pair", "left").select(
        "col_a", "col_b", F.greatest(F.coalesce(mutual, F.lit(0.0)), F.lit(0.0)).alias("mi")
    )
    texts = df.select(*[F.coalesce(name(c).cast("string"), F.lit("null")).alias(c) for c in columns])
    singles = texts.unpivot([], [name(c) for c in columns], "col", "value").groupBy("col", "value").agg(
        F.count("*").cast("double").alias("n")
    )
    own = singles.groupBy("col").agg((F.log(F.sum("n")) - F.sum(F.col("n") * F.log("n")) / F.sum("n")).alias("mi"))
    scores = (
        cross.select(F.col("col_a").alias("target"), F.col("col_b").alias("col"), "mi")
        .unionByName(cross.select(F.col("col_b").alias("target"), F.col("col_a").alias("col"), "mi"))
        .unionByName(own.select(F.col("col").alias("target"), "col", "mi"))
    )
    best = F.max("mi").over(Window.partitionBy("target"))
    return scores.select(
        "target", "col", F.when(best > 1e-12, F.col("mi") / best).otherwise(0.0).alias("score")
    )


def informative_columns(scores: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Columns whose score, rounded half-even to one decimal, reaches the threshold; the rounded score is their weight."""
    weight = F.bround(F.round("score", 9), 1)
    return scores.select("target", "col", weight.alias("weight")).filter(F.col("weight") >= threshold)


# Fixed value: the written form of a dependency.
FD_PATTERN = r"^(.+?)\s*→\s*(.+)$"


def parse_fds(rules: DataFrame, text: str = "fd") -> DataFrame:
    """Split ``A → B``; anything else, or A = None, gives NULL sides and accepted = false."""
    left = F.nullif(F.regexp_extract(name(text), FD_PATTERN, 1), F.lit(""))
    right = F.nullif(F.regexp_extract(name(text), FD_PATTERN, 2), F.lit(""))
    accepted = left.isNotNull() & (left != "None")
    return rules.select(
        *[name(c) for c in rules.columns],
        F.when(accepted, left).alias("determinant"),
        F.when(accepted, right).alias("dependent"),
        F.coalesce(accepted, F.lit(False)).alias("accepted"),
    )


def parse_fd(text: str) -> tuple[str, str] | None:
    match = re.match(FD_PATTERN, text)
    if not match or match.group(1) == "None":
        return None
    return match.group(1), match.group(2)


def fd_lookup(rows: DataFrame, determinant: Column, dependent: Column, clean: Column | None = None) -> DataFrame:
    """(fd_key, fd_value, fd_rows): most frequent B per A over clean rows, least on a tie.

    Counted per (A, B) first, so a hot A costs one row per distinct B.
    """
    base = rows if clean is None else rows.filter(clean)
    counts = (
        base.select(determinant.alias("fd_key"), dependent.alias("fd_value"))
        .filter("fd_key is not null and fd_value is not null")
        .groupBy("fd_key", "fd_value")
        .agg(F.count("*").alias("n"))
    )
    best = counts.groupBy("fd_key").agg(
        F.min(F.struct((-F.col("n")).alias("n"), F.col("fd_value"))).alias("b"), F.sum("n").alias("fd_rows")
    )
    return best.select("fd_key", F.col("b.fd_value").alias("fd_value"), "fd_rows")


def with_fd_value(rows: DataFrame, determinant: Column, lookup: DataFrame, value: str = "fd_value") -> DataFrame:
    """``rows`` with the looked-up value of their determinant, NULL where no clean row shares it."""
    keyed = rows.withColumn("fd_key", determinant)
    found = lookup.select("fd_key", F.col("fd_value").alias(value), "fd_rows")
    return lookup_join(keyed, found, ["fd_key"], "fd_rows").drop("fd_key")


def fd_validate(examples: DataFrame, lookup: DataFrame, determinant: str = "key_value") -> DataFrame:
    """Whether the looked-up value equals the truth on every example (dirty value where no key matches).

    Examples: (key_value, dirty_value, truth).
    """
    joined = examples.join(lookup.drop("fd_rows"), name(determinant) == F.col("fd_key"), "left")
    predicted = F.coalesce("fd_value", "dirty_value")
    return joined.agg(
        F.count("*").alias("examples"),
        F.coalesce(F.sum((~predicted.eqNullSafe(F.col("truth"))).cast("bigint")), F.lit(0)).alias("mismatches"),
        F.coalesce(F.bool_and(predicted.eqNullSafe(F.col("truth"))), F.lit(True)).alias("accepted"),
    )


def fd_repair(rows: DataFrame, determinant: str, dependent: str, flag: Column, clean: Column) -> DataFrame:
    """Flagged cells take the clean mode of their determinant group; others pass untouched.

    Only the flagged rows meet the lookup table; the rest never shuffle.
    """
    lookup = fd_lookup(rows, name(determinant), name(dependent), clean)
    wrong = F.coalesce(flag.cast("boolean"), F.lit(False))
    fixed = with_fd_value(rows.filter(wrong), name(determinant), lookup)
    repaired = fixed.select(
        *[F.coalesce(F.col("fd_value"), name(c)).alias(c) if c == dependent else name(c) for c in rows.columns]
    )
    return rows.filter(~wrong).unionByName(repaired)


def fd_propose(df: DataFrame, columns: Sequence[str], target: str | None = None, key_share: float = 0.9) -> DataFrame:
    """Purity of every single-column dependency A → B: rows kept by the majority B of each A, over all rows.

    Groups of one row say nothing and drop out; key-like determinants are excluded.
    """
    pairs = _pairs(columns)
    if target is not None:
        pairs = [p for p in pairs if target in p[1:]]
    counts = pair_counts(df, pairs)
    named = _named_pairs(df.sparkSession, pairs)
    sides = F.array(
        F.struct(F.lit("ab").alias("way"), F.col("a").alias("u"), F.col("b").alias("v")),
        F.struct(F.lit("ba").alias("way"), F.col("b").alias("u"), F.col("a").alias("v")),
    )
    groups = (
        counts.select("pair", "n", F.explode(sides).alias("s"))
        .groupBy("pair", "s.way", "s.u")
        .agg(F.sum("n").alias("size"), F.max("n").alias("most"))
    )
    scored = groups.groupBy("pair", "way").agg(
        F.count("*").alias("keys"),
        F.sum("size").alias("all_rows"),
        F.sum(F.when(F.col("size") >= 2, F.col("size"))).alias("support"),
        F.sum(F.when(F.col("size") >= 2, F.col("most"))).alias("kept"),
    )
    out = named.join(scored, "pair").select(
        F.when(F.col("way") == "ab", F.col("col_a")).otherwise(F.col("col_b")).alias("determinant"),
        F.when(F.col("way") == "ab", F.col("col_b")).otherwise(F.col("col_a")).alias("dependent"),
        F.coalesce(F.col("support"), F.lit(0)).alias("support"),
        F.coalesce(F.col("kept") / F.col("support"), F.lit(0.0)).alias("purity"),
        (F.col("keys") / F.col("all_rows")).alias("key_share"),
    )
    out = out.filter((F.col("key_share") <= key_share) & (F.col("support") > 0))
    if target is not None:
        out = out.filter(F.col("dependent") == target)
    return out.select("determinant", "dependent", "support", "purity")


def read_declared_fds(text: str) -> list[tuple[list[str], str]]:
    """``{dependent: [determinant, ...]}`` to (determinants, dependent); repeated keys are all kept."""
    entries = json.loads(text, object_pairs_hook=list)
    return [(list(determinants), dependent) for dependent, determinants in entries]


def fd_violations(df: DataFrame, key: str, determinants: Sequence[str], dependent: str) -> DataFrame:
    """Rows whose B differs from the majority B of their A group, with that majority."""
    rows = df.select(
        name(key),
        F.to_json(F.struct(*[name(c).cast("string").alias(c) for c in determinants])).alias("group_key")
        if len(determinants) > 1
        else name(determinants[0]).cast("string").alias("group_key"),
        name(dependent).cast("string").alias("actual"),
    )
    lookup = fd_lookup(rows, F.col("group_key"), F.col("actual"))
    joined = with_fd_value(rows, F.col("group_key"), lookup).filter("fd_value is not null")
    return joined.filter(~F.col("actual").eqNullSafe(F.col("fd_value"))).select(
        name(key), "group_key", "actual", F.col("fd_value").alias("expected")
    )


def type_rule(column: Column, rule: str, values: Sequence[str] | None = None) -> Column:
    """True where the cell obeys a declared rule; NULL obeys only where the rule allows it (never)."""
    text = column.cast("string")
    digits = re.fullmatch(r"(\d+) (formatted )?digits", rule)
    letters = re.fullmatch(r"(\d+) letters", rule)
    if rule == "not null":
        test = text.isNotNull() & (F.trim(text) != "") & ~F.lower(text).isin("nan", "null")
    elif rule == "date":
        formats = ["M/d/yy", "M/d/yyyy", "yyyy-MM-dd", "yyyy-MM-dd HH:mm:ss"]
        test = F.coalesce(*[F.try_to_timestamp(text, F.lit(f)) for f in formats]).isNotNull()
    elif digits and digits.group(2):
        test = F.length(F.regexp_replace(text, "[^0-9]", "")).eqNullSafe(F.lit(int(digits.group(1)))) & text.rlike(r"^[0-9().\- ]+$")
    elif digits:
        test = text.rlike(rf"^[0-9]{{{digits.group(1)}}}$")
    elif letters:
        test = text.rlike(rf"^[A-Za-z]{{{letters.group(1)}}}$")
    elif rule == "digits":
        test = text.rlike(r"^[0-9]+$")
    elif rule == "non-zero-leading digits":
        test = text.rlike(r"^[1-9][0-9]*$")
    elif rule in ("predefined list", "predifined list"):
        if values is None:
            raise ValueError("a predefined list needs its values")
        test = text.isin(*values)
    else:
        raise ValueError(f"unknown rule: {rule}")
    return F.coalesce(test, F.lit(False))


def type_check(
    df: DataFrame, key: str, rules: Mapping[str, str], values: Mapping[str, Sequence[str]] | None = None
) -> DataFrame:
    """One boolean per ruled column: true where the cell obeys its rule."""
    return df.select(name(key), *[type_rule(name(c), r, (values or {}).get(c)).alias(c) for c, r in rules.items()])


def fd_rank(df: DataFrame, flags: Mapping[str, Column], targets: Sequence[str], columns: Sequence[str], key_share: float = 0.9) -> DataFrame:
    """(dependent, determinant, support, purity) of ``fd_propose`` for several dependents in one pass.

    A row counts for a dependent unless that cell is flagged. Cells are text without NULL.
    """
    entries = [
        F.when(~flags[b], F.struct(F.lit(b).alias("dependent"), F.lit(a).alias("determinant"), name(a).alias("a"), name(b).alias("b")))
        for b in targets
        for a in columns
        if a != b
    ]
    opened = df.select(F.explode(F.array_compact(F.array(*entries))).alias("e")).select("e.*")
    counts = opened.filter((F.col("a") != MISSING) & (F.col("b") != MISSING)).groupBy("dependent", "determinant", "a", "b").agg(F.count("*").alias("n"))
    groups = counts.groupBy("dependent", "determinant", "a").agg(F.sum("n").alias("size"), F.max("n").alias("most"))
    several = F.col("size") >= 2
    scored = groups.groupBy("dependent", "determinant").agg(
        (F.count("*") / F.sum("size")).alias("key_share"),
        F.coalesce(F.sum(F.when(several, F.col("size"))), F.lit(0)).alias("support"),
        F.sum(F.when(several, F.col("most"))).alias("kept"),
    )
    fit = scored.filter((F.col("key_share") <= key_share) & (F.col("support") > 0))
    return fit.select("dependent", "determinant", "support", (F.col("kept") / F.col("support")).alias("purity"))


def fd_verdicts(df: DataFrame, flags: Mapping[str, Column], examples: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(dependent, determinant, accepted) for every determinant of all examples in one grouped pass.

    Examples: (dependent, determinant, key_value, dirty_value, truth), a bounded table. Only rows of ``df`` that hold a key of some
    example are counted, without a cell flagged on either side; the mode of a key (least on a tie) is the looked-up value.
    """
    asked = examples.select("dependent", "determinant", F.col("key_value").alias("a")).distinct()
    targets = [r["dependent"] for r in asked.select("dependent").distinct().collect()]
    entries = [
        F.when(~flags[a] & ~flags[b], F.struct(F.lit(b).alias("dependent"), F.lit(a).alias("determinant"), name(a).alias("a"), name(b).alias("b")))
        for b in targets
        for a in columns
        if a != b
    ]
    if not entries:
        return examples.select("dependent", "determinant", F.lit(True).alias("accepted")).limit(0)
    opened = df.select(F.explode(F.array_compact(F.array(*entries))).alias("e")).select("e.*")
    counts = opened.join(asked, ["dependent", "determinant", "a"], "left_semi").groupBy("dependent", "determinant", "a", "b").agg(F.count("*").alias("n"))
    modes = counts.groupBy("dependent", "determinant", F.col("a").alias("key_value")).agg(F.min(F.struct((-F.col("n")).alias("n"), "b")).alias("m"))
    joined = examples.join(modes, ["dependent", "determinant", "key_value"], "left")
    right = F.coalesce("m.b", "dirty_value").eqNullSafe(F.col("truth"))
    return joined.groupBy("dependent", "determinant").agg(F.bool_and(right).alias("accepted"))
