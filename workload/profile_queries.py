"""Sources, profiles, scalars and text queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from cellsmith.functions import text as tx
from cellsmith.functions.scalars import (
    FEATURES,
    batch_features,
    bernoulli_above,
    bernoulli_below,
    feature_dictionary,
    minmax_stats,
    noise,
    plain_text,
    scaled,
    to_number,
    trimmed_text,
    unscaled,
    zero_if_missing,
)
from cellsmith.operators.encode import decode_column, encode_columns, label_dictionary, round_category_like
from cellsmith.operators.profile import (
    BAND_EDGES,
    BAND_LABELS,
    histogram,
    iqr_outliers,
    length_describe,
    profile,
    rare_values,
    row_sample,
    top_values,
)
from cellsmith.sources.tables import align, blank_by_mask, detection_inputs, missing_mask, normalise_mask, preview, result_payload
from workload import fixtures as fx
from workload.registry import query, r6, sql_bucket, sql_unit, table


def _numeric_profile(table_name: str, columns: list[str]) -> str:
    return " UNION ALL ".join(
        f"SELECT '{c}' AS name, 'Numeric' AS type, count(*) - count({c}) AS missing, round(avg({c}), 2) AS mean, "
        f"round(stddev_samp({c}), 2) AS std, round(CAST(min({c}) AS DOUBLE), 2) AS min, round(CAST(max({c}) AS DOUBLE), 2) AS max, "
        f"CAST(NULL AS BIGINT) AS \"unique\" FROM {table_name}"
        for c in columns
    )


NUMERIC = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linenumber"]


@query("profile_numeric", _numeric_profile("lineitem", NUMERIC))
def profile_numeric(spark, sf):
    return profile(table(spark, sf, "lineitem"), NUMERIC)


CATEGORICAL = ["status", "priority"]


@query(
    "profile_categorical",
    f"WITH {fx.PRIORITY_SQL} "
    + " UNION ALL ".join(
        f"SELECT '{c}' AS name, 'Categorical' AS type, count(*) - count({c}) AS missing, CAST(NULL AS DOUBLE) AS mean, CAST(NULL AS DOUBLE) AS std, "
        f"CAST(NULL AS DOUBLE) AS min, CAST(NULL AS DOUBLE) AS max, count(DISTINCT {c}) AS \"unique\" FROM dirty"
        for c in CATEGORICAL
    ),
)
def profile_categorical(spark, sf):
    return profile(fx.priority_dirty(fx.priority_clean(spark, sf)), CATEGORICAL)


@query("preview_top", f"WITH {fx.PRIORITY_SQL} SELECT * FROM dirty ORDER BY row_id LIMIT 1000")
def preview_top(spark, sf):
    return preview(fx.priority_dirty(fx.priority_clean(spark, sf)), "row_id", 1000)


@query(
    "result_payload",
    f"""WITH {fx.ORDERS_SQL}
    SELECT d.row_id, CAST(json_object('custkey', d.custkey, 'status', d.status, 'segment', d.segment) AS VARCHAR) AS row,
           CAST(json_object('custkey', m.custkey, 'status', m.status, 'segment', m.segment) AS VARCHAR) AS mask
    FROM dirty d JOIN mask m USING (row_id) ORDER BY row_id LIMIT 1000""",
)
def result_payload_query(spark, sf):
    clean = fx.orders_clean(spark, sf)
    return result_payload(fx.orders_dirty(clean), fx.orders_mask(clean), "row_id", 1000)


@query(
    "freq_top_rare",
    """WITH c AS (SELECT p_name || ' ' || p_type AS value, count(*) AS n FROM part GROUP BY 1),
    t AS (SELECT 'top' AS kind, value, n FROM c ORDER BY n DESC, value LIMIT 5)
    SELECT * FROM t UNION ALL SELECT 'rare', value, n FROM c WHERE n < 3""",
)
def freq_top_rare(spark, sf):
    part = table(spark, sf, "part").select(F.concat_ws(" ", "p_name", "p_type").alias("label"))
    top = top_values(part, "label").select(F.lit("top").alias("kind"), "value", "n")
    return top.unionByName(rare_values(part, "label").select(F.lit("rare").alias("kind"), "value", "n"))


_BANDS = list(zip(BAND_EDGES, BAND_EDGES[1:], BAND_LABELS))


@query(
    "histogram",
    " UNION ALL ".join(
        f"SELECT '{label}' AS band, count(*) FILTER (WHERE value >= {low}"
        + (f" AND value < {high}" if high != float("inf") else "")
        + ") AS n FROM events"
        for low, high, label in _BANDS
    ),
)
def histogram_query(spark, sf):
    return histogram(table(spark, sf, "events"), "value")


@query(
    "length_describe",
    """WITH l AS (SELECT CAST(length(text) AS DOUBLE) AS len FROM documents)
    SELECT 'count' AS metric, CAST(count(*) AS DOUBLE) AS value FROM l UNION ALL
    SELECT 'mean', round(avg(len), 6) FROM l UNION ALL SELECT 'std', round(stddev_samp(len), 6) FROM l UNION ALL
    SELECT 'min', min(len) FROM l UNION ALL SELECT '25%', quantile_cont(len, 0.25) FROM l UNION ALL
    SELECT '50%', quantile_cont(len, 0.5) FROM l UNION ALL SELECT '75%', quantile_cont(len, 0.75) FROM l UNION ALL
    SELECT 'max', max(len) FROM l""",
)
def length_describe_query(spark, sf):
    return length_describe(table(spark, sf, "documents"), "text").select("metric", r6(F.col("value"), "value"))


@query(
    "iqr_outliers",
    """WITH q AS (SELECT quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM events)
    SELECT event_id, value FROM events, q WHERE value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1)""",
)
def iqr_outliers_query(spark, sf):
    return iqr_outliers(table(spark, sf, "events"), "event_id", "value")


@query(
    "row_sample",
    """SELECT p_partkey, 'p_partkey: ' || p_partkey || ', p_name: ' || coalesce(p_name, 'nan') || ', p_brand: ' || coalesce(p_brand, 'nan') AS example
    FROM part ORDER BY md5('1|' || p_partkey), p_partkey LIMIT 10""",
)
def row_sample_query(spark, sf):
    part = table(spark, sf, "part").select("p_partkey", "p_name", "p_brand")
    return row_sample(part, "p_partkey", 10, seed=1)


def _features_sql(value: str) -> str:
    bucket = sql_bucket("v", 10_000)
    return f"""
      coalesce(try_cast(regexp_replace(v, '[^0-9.\\-]', '', 'g') AS DOUBLE), 0.0::DOUBLE) AS f0, CAST(length(v) AS DOUBLE) AS f1,
      CAST(length(regexp_replace(v, '[^\\p{{Nd}}]', '', 'g')) AS DOUBLE) AS f2,
      CAST(length(regexp_replace(v, '[^a-zA-Z]', '', 'g')) AS DOUBLE) AS f3,
      CAST(length(v) - length(regexp_replace(v, '[^\\p{{Nd}}]', '', 'g')) - length(regexp_replace(v, '[^a-zA-Z]', '', 'g')) AS DOUBLE) AS f4,
      CASE WHEN v = 'nan' THEN 0.0::DOUBLE ELSE CAST(unicode(substr(v, 1, 1)) AS DOUBLE) END AS f5,
      CASE WHEN v = 'nan' THEN 0.0::DOUBLE ELSE CAST(unicode(substr(v, length(v), 1)) AS DOUBLE) END AS f6,
      CASE WHEN v = 'nan' THEN 0.0::DOUBLE ELSE round({bucket} / 10000.0::DOUBLE, 6) END AS f7,
      CASE WHEN v = 'nan' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS f8"""


@query(
    "cell_features",
    f"""WITH {fx.PRIORITY_SQL}, vals AS (
      SELECT DISTINCT 'name' AS source, p_name AS value FROM part UNION ALL
      SELECT DISTINCT 'props', props FROM events UNION ALL SELECT DISTINCT 'lang', lang FROM documents UNION ALL
      SELECT DISTINCT 'priority', priority FROM dirty),
    x AS (SELECT source, value, CASE WHEN value IS NULL OR value = '' THEN 'nan' ELSE value END AS v FROM vals)
    SELECT source, value, {_features_sql('v')} FROM x""",
)
def cell_features_query(spark, sf):
    parts = [
        ("name", table(spark, sf, "part"), "p_name"),
        ("props", table(spark, sf, "events"), "props"),
        ("lang", table(spark, sf, "documents"), "lang"),
        ("priority", fx.priority_dirty(fx.priority_clean(spark, sf)), "priority"),
    ]
    out = None
    for source, df, column in parts:
        part = feature_dictionary(df, column).select(
            F.lit(source).alias("source"), "value", *[r6(F.col(f), f) if f == "f7" else F.col(f) for f in FEATURES]
        )
        out = part if out is None else out.unionByName(part)
    return out


@query(
    "batch_features",
    f"""WITH x AS (SELECT doc_id, CASE WHEN text IS NULL OR text = '' THEN 'nan' ELSE text END AS v FROM documents),
    y AS (SELECT doc_id, {_features_sql('v')} FROM x)
    SELECT doc_id, f0, f1, f2, f3, f4, f5, f6, f7, f8 FROM y""",
)
def batch_features_query(spark, sf):
    out = batch_features(table(spark, sf, "documents"), "doc_id", "text")
    return out.select("doc_id", *[r6(F.col(f), f) if f == "f7" else F.col(f) for f in FEATURES])


@query(
    "minmax_scale_inverse",
    f"""WITH {fx.PRICE_SQL}, s AS (SELECT min(price) AS lo, max(price) AS hi, min(qty) AS ql, max(qty) AS qh FROM gaps)
    SELECT row_id, round((price - lo) / (hi - lo), 6) AS scaled, round((price - lo) / (hi - lo) * (hi - lo) + lo, 6) AS back,
           round((qty - ql) / ((qh - ql) + 1e-6), 6) AS shifted,
           round((qty - ql) / ((qh - ql) + 1e-6) * ((qh - ql) + 1e-6) + ql, 6) AS shifted_back FROM gaps, s""",
)
def minmax_scale_inverse(spark, sf):
    gaps = fx.price_gaps(fx.price_truth(spark, sf))
    stats = minmax_stats(gaps, ["price", "qty"])
    plain, range_of = stats["price"], stats["qty"]
    shifted = {**range_of, "den": range_of["max"] - range_of["min"] + 1e-6}
    return gaps.select(
        "row_id",
        r6(scaled(F.col("price"), plain), "scaled"),
        r6(unscaled(scaled(F.col("price"), plain), plain), "back"),
        r6(scaled(F.col("qty"), shifted), "shifted"),
        r6(unscaled(scaled(F.col("qty"), shifted), shifted), "shifted_back"),
    )


@query(
    "label_encode",
    f"""WITH {fx.PRIORITY_SQL}, codes AS (
      SELECT priority, row_number() OVER (ORDER BY priority) - 1 AS code FROM (SELECT DISTINCT priority FROM dirty WHERE priority IS NOT NULL)),
    x AS (SELECT row_id, CAST(code AS DOUBLE) AS code FROM dirty LEFT JOIN codes USING (priority))
    SELECT x.row_id, x.code, codes.priority AS decoded FROM x
    LEFT JOIN codes ON x.code IS NOT NULL AND codes.code = greatest(0, least((SELECT max(code) FROM codes), CAST(round_even(x.code + 0.5, 0) AS BIGINT)))""",
)
def label_encode(spark, sf):
    dirty = fx.priority_dirty(fx.priority_clean(spark, sf))
    dictionary = label_dictionary(dirty, "priority")
    coded = encode_columns(dirty, ["priority"], {"priority": dictionary})
    shifted = coded.select("row_id", F.col("priority").alias("code"), (F.col("priority") + 0.5).alias("decoded"))
    return decode_column(shifted, "decoded", dictionary)


@query(
    "round_categorical",
    """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round_even(l_linenumber + 0.5, 0) AS line, round(l_quantity + 0.25, 6) AS qty FROM lineitem""",
)
def round_categorical(spark, sf):
    line = table(spark, sf, "lineitem")
    keys = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    original = line.select(*keys, F.col("l_linenumber").cast("double").alias("line"), F.col("l_quantity").alias("qty"))
    imputed = line.select(*keys, (F.col("l_linenumber") + 0.5).alias("line"), (F.col("l_quantity") + 0.25).alias("qty"))
    return round_category_like(imputed, original, ["line", "qty"])


# Answers of several shapes around the event payload.
_ANSWER_SQL = """
answers AS (SELECT event_id, CASE event_id % 6
  WHEN 0 THEN props WHEN 1 THEN 'note ```json ' || props || ' ``` end' WHEN 2 THEN 'x ``` ' || props || ' ``` y'
  WHEN 3 THEN '{"correction": ' || props || '} tail' WHEN 4 THEN '```json {"k": ``` broken' ELSE 'plain words' END AS answer FROM events)"""


def _answers(spark, sf):
    step = F.col("event_id") % 6
    answer = (
        F.when(step == 0, F.col("props"))
        .when(step == 1, F.concat(F.lit("note ```json "), "props", F.lit(" ``` end")))
        .when(step == 2, F.concat(F.lit("x ``` "), "props", F.lit(" ``` y")))
        .when(step == 3, F.concat(F.lit('{"correction": '), "props", F.lit("} tail")))
        .when(step == 4, F.lit('```json {"k": ``` broken'))
        .otherwise(F.lit("plain words"))
    )
    return table(spark, sf, "events").select("event_id", answer.alias("answer"))


@query(
    "text_json_extract",
    f"""WITH {_ANSWER_SQL}, picked AS (SELECT event_id, answer, trim(CASE
      WHEN contains(answer, '```json') THEN coalesce(nullif(regexp_extract(answer, '(?s)```json(.*?)```', 1), ''), answer)
      WHEN contains(answer, '```') THEN coalesce(nullif(regexp_extract(answer, '(?s)```(.*?)```', 1), ''), answer) ELSE answer END) AS body FROM answers)
    SELECT event_id, CASE WHEN json_valid(body) THEN body END AS payload,
      trim(replace(replace(answer, '```json', ''), '```', '')) AS unfenced,
      nullif(regexp_extract(answer, '"correction":\\s*(\\{{[^}}]+\\}})', 1), '') AS correction FROM picked""",
)
def text_json_extract(spark, sf):
    return _answers(spark, sf).select(
        "event_id",
        tx.json_in_text(F.col("answer")).alias("payload"),
        tx.strip_fences(F.col("answer")).alias("unfenced"),
        tx.correction_object(F.col("answer")).alias("correction"),
    )


@query(
    "code_blocks",
    """WITH x AS (SELECT conv_id, turn, 'Intro ```python' || chr(10) || 'def is_clean_a(row, attr):' || chr(10) || '    return True' || chr(10) || '``` '
        || text || CASE WHEN turn % 2 = 0 THEN ' ```python x = 1```' ELSE '' END AS body FROM conversations)
    SELECT conv_id, turn, CAST(len(regexp_extract_all(body, '(?s)```python(.*?)```', 1)) AS BIGINT) AS blocks,
      regexp_extract_all(body, '(?s)```python(.*?)```', 1)[1] AS first_block,
      regexp_extract(body, '(def \\w+\\([^\\n]*?\\):\\n( [^\\n]*\\n)+)', 1) AS first_function FROM x""",
)
def code_blocks_query(spark, sf):
    body = F.concat(
        F.lit("Intro ```python\ndef is_clean_a(row, attr):\n    return True\n``` "),
        "text",
        F.when(F.col("turn") % 2 == 0, F.lit(" ```python x = 1```")).otherwise(F.lit("")),
    )
    rows = table(spark, sf, "conversations").select("conv_id", "turn", body.alias("body"))
    return rows.select(
        "conv_id",
        "turn",
        F.size(tx.code_blocks(F.col("body"))).cast("bigint").alias("blocks"),
        F.element_at(tx.code_blocks(F.col("body")), 1).alias("first_block"),
        F.element_at(tx.function_blocks(F.col("body")), 1).alias("first_function"),
    )


@query(
    "row_json_forms",
    f"""WITH {fx.ORDERS_SQL} SELECT d.row_id,
      CAST(json_object('custkey', d.custkey, 'status', d.status, 'segment', d.segment) AS VARCHAR) AS whole,
      CASE WHEN m.segment THEN CAST(json_object('custkey', d.custkey, 'status', d.status) AS VARCHAR)
           ELSE CAST(json_object('custkey', d.custkey, 'status', d.status, 'segment', d.segment) AS VARCHAR) END AS unflagged
    FROM dirty d JOIN mask m USING (row_id)""",
)
def row_json_forms(spark, sf):
    clean = fx.orders_clean(spark, sf)
    columns = ["custkey", "status", "segment"]
    joined = align({"d": fx.orders_dirty(clean), "m": fx.orders_mask(clean)}, "row_id")
    opened = joined.select("row_id", "d.*", *[F.col("m").getField(c).alias(f"_m_{c}") for c in columns])
    return opened.select(
        "row_id",
        tx.row_json(columns).alias("whole"),
        tx.unflagged_json(columns, [F.col(f"_m_{c}") for c in columns]).alias("unflagged"),
    )


@query(
    "compare_forms",
    f"""WITH {fx.PRIORITY_SQL} SELECT row_id, trim(coalesce(' ' || priority || '  ', '')) AS trimmed, coalesce(' ' || priority || '  ', '') AS plain,
      try_cast(substr(priority, 1, 1) AS DOUBLE) AS number, coalesce(try_cast(priority AS DOUBLE), 0.0::DOUBLE) AS zeroed FROM dirty""",
)
def compare_forms(spark, sf):
    dirty = fx.priority_dirty(fx.priority_clean(spark, sf))
    padded = F.concat(F.lit(" "), "priority", F.lit("  "))
    return dirty.select(
        "row_id",
        trimmed_text(padded).alias("trimmed"),
        plain_text(padded).alias("plain"),
        to_number(F.substring("priority", 1, 1)).alias("number"),
        zero_if_missing(to_number(F.col("priority"))).alias("zeroed"),
    )


@query(
    "mask_normalise",
    "SELECT o_orderkey AS row_id, o_orderkey % 4 IN (0, 2) AS a, o_orderkey % 3 = 0 AS b FROM orders",
)
def mask_normalise(spark, sf):
    key = F.col("o_orderkey")
    a = F.element_at(F.array(*[F.lit(v) for v in ("True", "False", "1", "0")]), (key % 4).cast("int") + 1)
    b = F.when(key % 3 == 0, 1).otherwise(0)
    raw = table(spark, sf, "orders").select(key.alias("row_id"), a.alias("a"), b.alias("b"))
    return normalise_mask(raw, "row_id")


@query(
    "align_tables",
    f"""WITH {fx.ORDERS_SQL} SELECT c.row_id, c.segment AS clean_segment, d.segment AS dirty_segment, m.segment AS flag, d.status
    FROM clean c JOIN dirty d USING (row_id) JOIN mask m USING (row_id) WHERE c.row_id % 5 <> 0 AND d.row_id % 7 <> 0""",
)
def align_tables(spark, sf):
    clean = fx.orders_clean(spark, sf)
    tables = {
        "c": clean.filter("row_id % 5 <> 0").withColumn("extra", F.lit(1)),
        "d": fx.orders_dirty(clean).filter("row_id % 7 <> 0"),
        "m": fx.orders_mask(clean),
    }
    return align(tables, "row_id").select(
        "row_id",
        F.col("c.segment").alias("clean_segment"),
        F.col("d.segment").alias("dirty_segment"),
        F.col("m.segment").alias("flag"),
        F.col("d.status").alias("status"),
    )


@query(
    "detection_inputs",
    f"""WITH {fx.PRIORITY_SQL},
    best AS (SELECT priority FROM dirty WHERE priority IS NOT NULL GROUP BY priority ORDER BY count(*) DESC, priority LIMIT 1),
    filled AS (SELECT row_id, status, coalesce(priority, (SELECT priority FROM best)) AS priority FROM dirty),
    s AS (SELECT status, row_number() OVER (ORDER BY status) - 1 AS code FROM (SELECT DISTINCT status FROM filled)),
    p AS (SELECT priority, row_number() OVER (ORDER BY priority) - 1 AS code FROM (SELECT DISTINCT priority FROM filled))
    SELECT row_id, CAST(s.code AS DOUBLE) AS status, CAST(p.code AS DOUBLE) AS priority, CAST(m.priority AS INTEGER) AS label
    FROM filled f JOIN s USING (status) JOIN p USING (priority) JOIN mask m USING (row_id)""",
)
def detection_inputs_query(spark, sf):
    clean = fx.priority_clean(spark, sf)
    literal = F.when(F.col("priority"), "True").otherwise("False")
    mask = fx.priority_mask(clean).select("row_id", F.lit(7).alias("index"), F.lit("0").alias("status"), literal.alias("priority"))
    _, coded, truth = detection_inputs(fx.priority_dirty(clean), mask, "row_id")
    return coded.join(truth, "row_id")


@query(
    "missing_mask",
    f"""WITH {fx.PART_SQL} SELECT row_id, CAST(size IS NOT NULL AS INTEGER) AS size_seen, CAST(price IS NOT NULL AS INTEGER) AS price_seen,
      CAST(width IS NOT NULL AS INTEGER) AS width_seen, CASE WHEN row_id % 3 <> 0 THEN size END AS size_blanked FROM gaps""",
)
def missing_mask_query(spark, sf):
    gaps = fx.part_gaps(fx.part_truth(spark, sf))
    seen = missing_mask(gaps, "row_id", fx.PART_COLUMNS)
    given = gaps.select("row_id", (F.col("row_id") % 3 != 0).cast("int").alias("size"))
    blanked = blank_by_mask(gaps, given, "row_id", ["size"], blank_when=0).select("row_id", F.col("size").alias("size_blanked"))
    renamed = seen.select("row_id", *[F.col(c).alias(f"{c}_seen") for c in fx.PART_COLUMNS])
    return renamed.join(blanked, "row_id")


@query(
    "noise_and_hint",
    f"""SELECT p_partkey AS row_id, round({sql_unit("'noise3|' || p_partkey || '|size'")} * 0.01, 9) AS z,
      CAST({sql_unit("'hint3|' || p_partkey || '|size'")} > 0.1 AS INTEGER) AS hint,
      CAST({sql_unit("'mask50|' || p_partkey || '|size'")} < 0.9 AS INTEGER) AS drawn FROM part""",
)
def noise_and_hint(spark, sf):
    part = table(spark, sf, "part").select(F.col("p_partkey").alias("row_id"))
    key = F.col("row_id")
    return part.select(
        "row_id",
        F.round(noise(key, "size", 3), 9).alias("z"),
        bernoulli_above(key, "size", 0.1, 3).alias("hint"),
        bernoulli_below(key, "size", 0.9).alias("drawn"),
    )
