"""Evaluation metrics and mask reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from cellsmith.operators.cells import diff_mark, diff_summary, error_report, error_total, flagged_columns, pivot_cells, repair_overlay, row_any, unpivot_cells
from cellsmith.operators.detect import inject_missing
from cellsmith.operators.evaluate import (
    compare_methods,
    correction_prf,
    error_drop_rate,
    library_prf,
    masked_rmse_mae,
    norm_rmse_mae,
    repair_accuracy,
    row_prf,
)
from cellsmith.operators.fill import baseline_correct, column_modes
from cellsmith.operators.impute import blend
from cellsmith.session import checkpointed
from cellsmith.sources.tables import missing_mask
from workload import fixtures as fx
from workload.registry import query, r6

# Mean fill of the line-item gaps: the simplest imputation to score.
_MEAN_SQL = f"""{fx.PRICE_SQL},
means AS (SELECT {', '.join(f'avg({c}) AS {c}' for c in fx.PRICE_COLUMNS)} FROM gaps),
filled AS (SELECT row_id, {', '.join(f'coalesce(g.{c}, m.{c}) AS {c}' for c in fx.PRICE_COLUMNS)} FROM gaps g, means m),
cells AS ({' UNION ALL '.join(f"SELECT t.{c} AS t, f.{c} AS p, g.{c} IS NULL AS gap, '{c}' AS col FROM truth t JOIN filled f USING (row_id) JOIN gaps g USING (row_id)" for c in fx.PRICE_COLUMNS)})"""


def _mean_filled(spark, sf):
    # Row ids and gaps are hashed once, not again for every table and filter that reads them.
    truth = checkpointed(fx.price_truth(spark, sf))
    gaps = checkpointed(fx.price_gaps(truth))
    means = gaps.agg(*[F.avg(c).alias(c) for c in fx.PRICE_COLUMNS]).first()
    filled = gaps.select("row_id", *[F.coalesce(c, F.lit(means[c])).alias(c) for c in fx.PRICE_COLUMNS])
    return truth, gaps, filled, missing_mask(gaps, "row_id", fx.PRICE_COLUMNS)


@query(
    "masked_rmse_mae",
    f"WITH {_MEAN_SQL} SELECT round(sqrt(avg((t - p) * (t - p))), 6) AS rmse, round(avg(abs(t - p)), 6) AS mae, count(*) AS n_missing FROM cells WHERE gap",
)
def masked_rmse_mae_query(spark, sf):
    truth, _, filled, mask = _mean_filled(spark, sf)
    score = masked_rmse_mae(truth, filled, mask, "row_id")
    return score.select(r6(F.col("rmse"), "rmse"), r6(F.col("mae"), "mae"), "n_missing")


@query(
    "norm_rmse_mae",
    f"""WITH {_MEAN_SQL}, r AS (SELECT col, min(t) AS tl, max(t) - min(t) + 1e-6 AS td, min(p) AS pl, max(p) - min(p) + 1e-6 AS pd FROM cells GROUP BY col),
    n AS (SELECT gap, (t - tl) / td - (p - pl) / pd AS e FROM cells JOIN r USING (col))
    SELECT round(sqrt(avg(e * e)), 6) AS rmse, round(avg(abs(e)), 6) AS mae, count(*) AS n_missing FROM n WHERE gap""",
)
def norm_rmse_mae_query(spark, sf):
    truth, _, filled, mask = _mean_filled(spark, sf)
    score = norm_rmse_mae(truth, filled, mask, "row_id")
    return score.select(r6(F.col("rmse"), "rmse"), r6(F.col("mae"), "mae"), "n_missing")


@query(
    "blend_fill",
    f"WITH {fx.PRICE_SQL} SELECT row_id, round(coalesce(price, net * 2), 6) AS price, round(coalesce(qty, 7.0), 6) AS qty FROM gaps",
)
def blend_fill(spark, sf):
    gaps = fx.price_gaps(fx.price_truth(spark, sf))
    made = gaps.select("row_id", (F.col("net") * 2).alias("price"), F.lit(7.0).alias("qty"))
    out = blend(gaps.select("row_id", "price", "qty"), made, "row_id", ["price", "qty"])
    return out.select("row_id", r6(F.col("price"), "price"), r6(F.col("qty"), "qty"))


@query("inject_missing", f"WITH {fx.PRICE_SQL} SELECT row_id, round(price, 6) AS price, round(net, 6) AS net, round(charge, 6) AS charge, qty FROM gaps")
def inject_missing_query(spark, sf):
    gaps = inject_missing(fx.price_truth(spark, sf), "row_id", fx.PRICE_COLUMNS, fx.GAP_RATE)
    return gaps.select("row_id", *[r6(F.col(c), c) for c in ("price", "net", "charge")], "qty")


@query(
    "row_prf",
    f"""WITH {fx.PRIORITY_SQL}, p AS (SELECT CAST(m.priority AS INTEGER) AS t, CAST(d.priority IS NULL OR d.priority = lower(d.priority) OR row_id % 17 = 1 AS INTEGER) AS p
      FROM mask m JOIN dirty d USING (row_id)),
    n AS (SELECT sum(t * p) AS tp, sum((1 - t) * p) AS fp, sum(t * (1 - p)) AS fn FROM p)
    SELECT round(tp * 1.0::DOUBLE / (tp + fp), 4) AS precision, round(tp * 1.0::DOUBLE / (tp + fn), 4) AS recall, round(2.0::DOUBLE * tp / (2 * tp + fp + fn), 4) AS f1 FROM n""",
)
def row_prf_query(spark, sf):
    clean = fx.priority_clean(spark, sf)
    truth = row_any(fx.priority_mask(clean), "row_id")
    value = F.col("priority")
    guess = (value.isNull() | (value == F.lower(value)) | (F.col("row_id") % 17 == 1)).cast("int")
    return row_prf(truth, fx.priority_dirty(clean).select("row_id", guess.alias("label")), "row_id")


_MODE_SQL = """
best AS (SELECT d.priority AS v FROM dirty d JOIN mask m USING (row_id) WHERE NOT m.priority AND d.priority IS NOT NULL
  GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1),
fixed AS (SELECT d.row_id, d.status, CASE WHEN m.priority OR d.priority IS NULL THEN (SELECT v FROM best) ELSE d.priority END AS priority
  FROM dirty d JOIN mask m USING (row_id)),
j AS (SELECT c.priority AS c, d.priority AS d, f.priority AS f, m.priority AS flag
  FROM clean c JOIN dirty d USING (row_id) JOIN fixed f USING (row_id) JOIN mask m USING (row_id))"""


def _mode_fixed(spark, sf):
    clean = fx.priority_clean(spark, sf)
    dirty, mask = fx.priority_dirty(clean), fx.priority_mask(clean)
    return clean, dirty, mask, baseline_correct(dirty, mask, "row_id")


@query("baseline_correct", f"WITH {fx.PRIORITY_SQL}, {_MODE_SQL} SELECT * FROM fixed")
def baseline_correct_query(spark, sf):
    return _mode_fixed(spark, sf)[3]


@query(
    "mode_fill",
    f"""WITH {fx.PRIORITY_SQL}, b AS (SELECT priority AS v FROM dirty WHERE priority IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1),
    g AS (SELECT CASE WHEN p_partkey % 7 <> 2 THEN p_size END AS size FROM part), s AS (SELECT size AS v FROM g WHERE size IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)
    SELECT 'priority' AS col, (SELECT v FROM b) AS value UNION ALL SELECT 'size', CAST((SELECT v FROM s) AS VARCHAR)""",
)
def mode_fill_query(spark, sf):
    dirty = fx.priority_dirty(fx.priority_clean(spark, sf))
    sizes = fx.part_gaps(fx.part_truth(spark, sf)).select(F.col("size").cast("int").alias("size"))
    found = {**column_modes(dirty, ["priority"]), **column_modes(sizes, ["size"])}
    filled = dirty.select(F.lit("priority").alias("col"), F.lit(found["priority"]).alias("value")).limit(1)
    return filled.unionByName(sizes.select(F.lit("size").alias("col"), F.lit(str(found["size"])).alias("value")).limit(1))


@query(
    "correction_prf",
    f"""WITH {fx.PRIORITY_SQL}, {_MODE_SQL}, n AS (SELECT count(*) FILTER (WHERE trim(f) = trim(c) AND flag) AS good,
      count(*) FILTER (WHERE trim(coalesce(f, '')) <> trim(coalesce(d, ''))) AS changed, count(*) FILTER (WHERE flag) AS flagged FROM j),
    r AS (SELECT good * 1.0::DOUBLE / changed AS p, good * 1.0::DOUBLE / flagged AS r FROM n)
    SELECT round(p, 6) AS precision, round(r, 6) AS recall, round(2 * p * r / (p + r), 6) AS f1 FROM r""",
)
def correction_prf_query(spark, sf):
    clean, dirty, mask, fixed = _mode_fixed(spark, sf)
    score = correction_prf(clean, dirty, fixed, mask, "row_id")
    return score.select(*[r6(F.col(c), c) for c in ("precision", "recall", "f1")])


@query(
    "edr",
    f"""WITH {fx.PRIORITY_SQL}, {_MODE_SQL}, n AS (SELECT count(*) FILTER (WHERE coalesce(d, '') <> c) AS wrong_before, count(*) FILTER (WHERE f <> c) AS wrong_after,
      count(*) FILTER (WHERE coalesce(d, '') <> c AND f = c) AS wrong_to_right, count(*) FILTER (WHERE coalesce(d, '') = c AND f <> c) AS right_to_wrong FROM j)
    SELECT *, round((wrong_before - wrong_after) * 1.0::DOUBLE / wrong_before, 6) AS edr FROM n""",
)
def edr(spark, sf):
    clean, dirty, _, fixed = _mode_fixed(spark, sf)
    score = error_drop_rate(dirty, fixed, clean, "row_id")
    return score.withColumn("edr", r6(F.col("edr"), "edr"))


@query(
    "library_prf",
    f"""WITH {fx.PRIORITY_SQL}, {_MODE_SQL}, t AS (SELECT c, coalesce(d, 'null') AS d, f FROM j),
    n AS (SELECT count(*) FILTER (WHERE f <> d) AS ch, count(*) FILTER (WHERE f <> d AND f = c) AS cr, count(*) FILTER (WHERE d <> c) AS w,
      count(*) FILTER (WHERE d <> c AND f = c) AS wr FROM t), r AS (SELECT cr * 1.0::DOUBLE / ch AS p, wr * 1.0::DOUBLE / w AS r FROM n)
    SELECT round(p, 6) AS precision, round(r, 6) AS recall, round(2 * p * r / (p + r), 6) AS f1 FROM r""",
)
def library_prf_query(spark, sf):
    clean, dirty, _, fixed = _mode_fixed(spark, sf)
    score = library_prf(clean, dirty, fixed, "row_id")
    return score.select(*[r6(F.col(c), c) for c in ("precision", "recall", "f1")])


@query(
    "repair_accuracy",
    f"WITH {fx.PRIORITY_SQL}, {_MODE_SQL} SELECT count(*) FILTER (WHERE flag AND trim(f) = trim(c)) AS fixed, count(*) FILTER (WHERE flag) AS total, "
    "round(count(*) FILTER (WHERE flag AND trim(f) = trim(c)) * 1.0::DOUBLE / count(*) FILTER (WHERE flag), 6) AS accuracy FROM j",
)
def repair_accuracy_query(spark, sf):
    clean, _, mask, fixed = _mode_fixed(spark, sf)
    score = repair_accuracy(clean, fixed, mask, "row_id")
    return score.withColumn("accuracy", r6(F.col("accuracy"), "accuracy"))


@query(
    "method_compare",
    f"""WITH {fx.PRIORITY_SQL}, {_MODE_SQL}, a AS (SELECT count(*) FILTER (WHERE flag AND f = c) * 1.0::DOUBLE / count(*) FILTER (WHERE flag) AS m,
      count(*) FILTER (WHERE flag AND trim(coalesce(d, '')) = c) * 1.0::DOUBLE / count(*) FILTER (WHERE flag) AS k FROM j)
    SELECT 'accuracy' AS metric, round(k, 6) AS keep, round(m, 6) AS mode FROM a""",
)
def method_compare(spark, sf):
    clean, dirty, mask, fixed = _mode_fixed(spark, sf)
    scores = {
        "keep": repair_accuracy(clean, dirty, mask, "row_id"),
        "mode": repair_accuracy(clean, fixed, mask, "row_id"),
    }
    out = compare_methods(scores, ["accuracy"])
    return out.select("metric", r6(F.col("keep"), "keep"), r6(F.col("mode"), "mode"))


@query(
    "row_any",
    f"WITH {fx.PRIORITY_SQL} SELECT row_id, CAST(status OR priority AS INTEGER) AS label FROM mask",
)
def row_any_query(spark, sf):
    return row_any(fx.priority_mask(fx.priority_clean(spark, sf)), "row_id")


@query(
    "error_report",
    f"WITH {fx.ORDERS_SQL} SELECT row_id, 'segment' AS col, d.segment AS value FROM dirty d JOIN mask m USING (row_id) WHERE m.segment",
)
def error_report_query(spark, sf):
    clean = fx.orders_clean(spark, sf)
    return error_report(fx.orders_dirty(clean), fx.orders_mask(clean), "row_id")


@query("error_total", f"WITH {fx.ORDERS_SQL} SELECT count(*) AS total_errors FROM mask WHERE segment")
def error_total_query(spark, sf):
    clean = fx.orders_clean(spark, sf)
    return error_total(error_report(fx.orders_dirty(clean), fx.orders_mask(clean), "row_id"))


@query(
    "flagged_columns",
    f"""WITH {fx.ORDERS_SQL} SELECT 'custkey' AS col, count(*) FILTER (WHERE custkey) AS flags, bool_or(custkey) AS needed FROM mask UNION ALL
    SELECT 'status', count(*) FILTER (WHERE status), bool_or(status) FROM mask UNION ALL SELECT 'segment', count(*) FILTER (WHERE segment), bool_or(segment) FROM mask""",
)
def flagged_columns_query(spark, sf):
    return flagged_columns(fx.orders_mask(fx.orders_clean(spark, sf)), "row_id")


@query(
    "repair_overlay",
    f"""WITH {fx.ORDERS_SQL}, t AS (SELECT row_id, row_id % 100 IN (3, 7) AS pick FROM clean)
    SELECT row_id, CASE WHEN pick THEN c.custkey ELSE d.custkey END AS custkey, CASE WHEN pick THEN c.segment ELSE d.segment END AS segment,
      m.segment AND NOT pick AS segment_flag FROM clean c JOIN dirty d USING (row_id) JOIN mask m USING (row_id) JOIN t USING (row_id)""",
)
def repair_overlay_query(spark, sf):
    clean = fx.orders_clean(spark, sf)
    chosen = clean.filter((F.col("row_id") % 100).isin(3, 7)).select("row_id")
    table_, mask = repair_overlay(fx.orders_dirty(clean), clean, fx.orders_mask(clean), chosen, "row_id")
    return table_.select("row_id", "custkey", "segment").join(mask.select("row_id", F.col("segment").alias("segment_flag")), "row_id")


@query(
    "diff_mark",
    f"WITH {fx.ORDERS_SQL} SELECT row_id, 'segment' AS col, c.segment AS value_a, coalesce(d.segment, 'null') AS value_b FROM clean c JOIN dirty d USING (row_id) WHERE c.segment <> coalesce(d.segment, 'null')",
)
def diff_mark_query(spark, sf):
    clean = fx.orders_clean(spark, sf)
    return diff_mark(clean, fx.orders_dirty(clean), "row_id")


@query(
    "diff_summary",
    f"""WITH {fx.ORDERS_SQL} SELECT count(*) FILTER (WHERE c.segment <> coalesce(d.segment, 'null')) AS diff_count,
      round(count(*) FILTER (WHERE c.segment <> coalesce(d.segment, 'null')) * 100.0::DOUBLE / (3 * count(*)), 6) AS diff_percent FROM clean c JOIN dirty d USING (row_id)""",
)
def diff_summary_query(spark, sf):
    clean = fx.orders_clean(spark, sf)
    out = diff_summary(clean, fx.orders_dirty(clean), "row_id")
    return out.select("diff_count", r6(F.col("diff_percent"), "diff_percent"))


@query("cells_round_trip", f"WITH {fx.ORDERS_SQL} SELECT * FROM dirty")
def cells_round_trip(spark, sf):
    columns = ["custkey", "status", "segment"]
    cells = unpivot_cells(fx.orders_dirty(fx.orders_clean(spark, sf)), "row_id", columns)
    return pivot_cells(cells, "row_id", columns)
