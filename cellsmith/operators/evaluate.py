"""Mask-aware scores. Every metric is one aligned join and one single-row aggregate; no cell is spread to rows."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellsmith.functions.scalars import any_true, minmax_stats, name, plain_text, scaled, total, trimmed_text
from cellsmith.sources.tables import align, common_columns


def _ratio(top: Column, bottom: Column) -> Column:
    return F.coalesce(F.try_divide(top.cast("double"), bottom.cast("double")), F.lit(0.0))


def _harmonic(p: Column, r: Column) -> Column:
    return F.coalesce(F.try_divide(F.lit(2.0) * p * r, p + r), F.lit(0.0))


def _count(condition: Column) -> Column:
    return F.coalesce(F.sum(condition.cast("bigint")), F.lit(0))


def _field(alias: str, column: str) -> Column:
    return F.col(alias).getField(column)


def _masked_errors(joined: DataFrame, columns: Sequence[str], truth: Callable[[str], Column], imputed: Callable[[str], Column], mask: Callable[[str], Column]) -> DataFrame:
    def gap(c: str) -> Column:
        return F.when(mask(c) == 0, truth(c).cast("double") - imputed(c).cast("double"))

    missing = total([_count(mask(c) == 0) for c in columns])
    squares = total([F.coalesce(F.sum(gap(c) * gap(c)), F.lit(0.0)) for c in columns])
    absolutes = total([F.coalesce(F.sum(F.abs(gap(c))), F.lit(0.0)) for c in columns])
    return joined.agg(
        F.sqrt(_ratio(squares, missing)).alias("rmse"), _ratio(absolutes, missing).alias("mae"), missing.alias("n_missing")
    )


def masked_rmse_mae(truth: DataFrame | str, imputed: DataFrame, mask: DataFrame | str, key: str) -> DataFrame:
    """RMSE and MAE over cells whose mask is 0; no such cell gives 0.

    ``truth`` and ``mask`` are tables, or the names of struct columns that ``imputed`` has beside its cells: then no row moves.
    """
    if isinstance(truth, str):
        fields = [set(imputed.schema[c].dataType.names) for c in (truth, mask)]
        columns = [c for c in imputed.columns if c not in (key, truth, mask)]
        if any(f != set(columns) for f in fields):
            raise ValueError("truth, imputed and mask must have the same columns")
        return _masked_errors(imputed, columns, lambda c: _field(truth, c), name, lambda c: _field(mask, c))
    expected = set(truth.columns)
    if expected != set(imputed.columns) or expected != set(mask.columns):
        raise ValueError("truth, imputed and mask must have the same columns")
    # Rows that are wholly observed add nothing; they leave before the join.
    gappy = mask.filter(any_true([name(c).cast("int") == 0 for c in mask.columns if c != key]))
    joined = align({"t": truth, "p": imputed, "m": gappy}, key)
    columns = joined.schema["t"].dataType.names
    return _masked_errors(joined, columns, lambda c: _field("t", c), lambda c: _field("p", c), lambda c: _field("m", c))


def norm_rmse_mae(truth: DataFrame, imputed: DataFrame, mask: DataFrame, key: str) -> DataFrame:
    """The same errors after each table is scaled by its own shifted range."""
    columns = common_columns([truth, imputed, mask], key)

    def rescale(df: DataFrame) -> DataFrame:
        stats = minmax_stats(df, columns, shifted=True)
        return df.select(name(key), *[scaled(name(c), stats[c]).alias(c) for c in columns])

    return masked_rmse_mae(rescale(truth), rescale(imputed), mask.select(name(key), *[name(c) for c in columns]), key)


def row_prf(truth: DataFrame, predicted: DataFrame, key: str, label: str = "label") -> DataFrame:
    """Precision, recall, F1 of row labels, 4 decimals, zero division gives 0."""
    joined = truth.select(name(key), name(label).cast("int").alias("t")).join(
        predicted.select(name(key), name(label).cast("int").alias("p")), key, "inner"
    )
    counts = joined.agg(
        _count((F.col("t") == 1) & (F.col("p") == 1)).alias("tp"),
        _count((F.col("t") == 0) & (F.col("p") == 1)).alias("fp"),
        _count((F.col("t") == 1) & (F.col("p") == 0)).alias("fn"),
    )
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return counts.select(
        F.round(_ratio(tp, tp + fp), 4).alias("precision"),
        F.round(_ratio(tp, tp + fn), 4).alias("recall"),
        F.round(_ratio(tp * 2, tp * 2 + fp + fn), 4).alias("f1"),
    )


def correction_prf(clean: DataFrame, dirty: DataFrame, corrected: DataFrame, mask: DataFrame, key: str) -> DataFrame:
    """Console form: right = trimmed text equals truth and flagged, changed or not.

    Recall is over flagged cells; precision over all changed cells anywhere.
    """
    joined = align({"c": clean, "d": dirty, "p": corrected, "m": mask}, key)
    columns = joined.schema["c"].dataType.names
    right, changed, flagged = [], [], []
    for c in columns:
        flag = F.coalesce(_field("m", c).cast("boolean"), F.lit(False))
        now, truth, before = (trimmed_text(_field(a, c)) for a in ("p", "c", "d"))
        right.append(_count((now == truth) & flag))
        changed.append(_count(now != before))
        flagged.append(_count(flag))
    counts = joined.agg(total(right).alias("right"), total(changed).alias("changed"), total(flagged).alias("flagged"))
    empty = F.col("flagged") == 0
    rated = counts.select(
        F.when(empty, 0.0).otherwise(_ratio(F.col("right"), F.col("changed"))).alias("precision"),
        F.when(empty, 0.0).otherwise(_ratio(F.col("right"), F.col("flagged"))).alias("recall"),
    )
    return rated.withColumn("f1", _harmonic(F.col("precision"), F.col("recall")))


def error_drop_rate(dirty: DataFrame, repaired: DataFrame, clean: DataFrame, key: str) -> DataFrame:
    """(wrong before - wrong after) / wrong before, with wrong-to-right and right-to-wrong counts."""
    joined = align({"d": dirty, "r": repaired, "c": clean}, key)
    columns = joined.schema["d"].dataType.names
    before, after, fixed, broken = [], [], [], []
    for c in columns:
        was = plain_text(_field("d", c)) != plain_text(_field("c", c))
        now = plain_text(_field("r", c)) != plain_text(_field("c", c))
        before.append(_count(was))
        after.append(_count(now))
        fixed.append(_count(was & ~now))
        broken.append(_count(~was & now))
    counts = joined.agg(
        total(before).alias("wrong_before"),
        total(after).alias("wrong_after"),
        total(fixed).alias("wrong_to_right"),
        total(broken).alias("right_to_wrong"),
    )
    rate = _ratio(F.col("wrong_before") - F.col("wrong_after"), F.col("wrong_before"))
    return counts.withColumn("edr", rate)


def library_prf(clean: DataFrame, dirty: DataFrame, corrected: DataFrame, key: str) -> DataFrame:
    """Library form: precision over changed cells, recall over cells that were wrong. NULL reads as ``null``."""
    from cellsmith.functions.scalars import null_text

    joined = align({"c": clean, "d": dirty, "p": corrected}, key)
    columns = joined.schema["c"].dataType.names
    changed, changed_right, wrong, wrong_right = [], [], [], []
    for c in columns:
        now, truth, before = (null_text(_field(a, c)) for a in ("p", "c", "d"))
        changed.append(_count(now != before))
        changed_right.append(_count((now != before) & (now == truth)))
        wrong.append(_count(before != truth))
        wrong_right.append(_count((before != truth) & (now == truth)))
    counts = joined.agg(
        total(changed).alias("changed"),
        total(changed_right).alias("changed_right"),
        total(wrong).alias("wrong"),
        total(wrong_right).alias("wrong_right"),
    )
    rated = counts.select(
        _ratio(F.col("changed_right"), F.col("changed")).alias("precision"),
        _ratio(F.col("wrong_right"), F.col("wrong")).alias("recall"),
    )
    return rated.withColumn("f1", _harmonic(F.col("precision"), F.col("recall")))


def repair_accuracy(clean: DataFrame, corrected: DataFrame, mask: DataFrame, key: str) -> DataFrame:
    """Flagged cells whose trimmed text equals the truth, over all flagged cells."""
    joined = align({"c": clean, "p": corrected, "m": mask}, key)
    columns = joined.schema["c"].dataType.names
    fixed, flagged = [], []
    for c in columns:
        flag = F.coalesce(_field("m", c).cast("boolean"), F.lit(False))
        fixed.append(_count(flag & (trimmed_text(_field("p", c)) == trimmed_text(_field("c", c)))))
        flagged.append(_count(flag))
    counts = joined.agg(total(fixed).alias("fixed"), total(flagged).alias("total"))
    return counts.withColumn("accuracy", _ratio(F.col("fixed"), F.col("total")))


def compare_methods(scores: dict[str, DataFrame], metrics: Sequence[str]) -> DataFrame:
    """One row per metric, one column per method."""
    long = None
    for method, score in scores.items():
        part = score.select(*[name(m).cast("double").alias(m) for m in metrics]).unpivot(
            [], [name(m) for m in metrics], "metric", "value"
        )
        part = part.select(F.lit(method).alias("method"), "metric", "value")
        long = part if long is None else long.unionByName(part)
    return long.groupBy("metric").agg(
        *[F.max(F.when(F.col("method") == m, F.col("value"))).alias(m) for m in scores]
    )
