"""Mutual information, dependencies, declared rules."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import functions as F

from cellsmith.operators.dependency import (
    cooccurrence_mi,
    fd_lookup,
    fd_propose,
    fd_repair,
    fd_validate,
    fd_violations,
    informative_columns,
    nmi_pairs,
    parse_fds,
    related_columns,
    type_check,
)
from cellsmith.operators.evaluate import error_drop_rate
from workload import fixtures as fx
from workload.registry import query, r6, table

SHOP_COLUMNS = ["name", "brand", "kind"]


def _entropy(table_name: str, column: str, where: str) -> str:
    return f"(SELECT -sum(p * ln(p)) FROM (SELECT count(*) * 1.0::DOUBLE / sum(count(*)) OVER () AS p FROM {table_name} WHERE {where} GROUP BY {column}))"


def _nmi_sql(table_name: str, columns: list[str]) -> str:
    parts = []
    for i, (a, b) in enumerate(combinations(columns, 2)):
        where = f"coalesce({a}, 'nan') <> 'nan' AND coalesce({b}, 'nan') <> 'nan'"
        ha, hb, hab = (_entropy(table_name, c, where) for c in (a, b, f"{a}, {b}"))
        parts.append(
            f"SELECT {i} AS pair, '{a}' AS col_a, '{b}' AS col_b, coalesce(round(2 * greatest({ha} + {hb} - {hab}, 0) / nullif(({ha} + {hb}) / ln(2), 0), 6), 0.0::DOUBLE) AS nmi"
        )
    return " UNION ALL ".join(parts)


@query("nmi_pairs", f"WITH {fx.CHAIN_SQL} {_nmi_sql('chain', fx.CHAIN_COLUMNS)}")
def nmi_pairs_query(spark, sf):
    scores = nmi_pairs(fx.chain(spark, sf), fx.CHAIN_COLUMNS)
    return scores.select("pair", "col_a", "col_b", r6(F.col("nmi"), "nmi"))


@query("nmi_pairs_gaps", f"WITH {fx.ORDERS_SQL} {_nmi_sql('dirty', ['custkey', 'status', 'segment'])}")
def nmi_pairs_gaps(spark, sf):
    scores = nmi_pairs(fx.orders_dirty(fx.orders_clean(spark, sf)), ["custkey", "status", "segment"])
    return scores.select("pair", "col_a", "col_b", r6(F.col("nmi"), "nmi"))


@query(
    "nmi_topk",
    f"""WITH {fx.CHAIN_SQL}, s AS ({_nmi_sql('chain', fx.CHAIN_COLUMNS)}),
    b AS (SELECT pair, col_a AS col, col_b AS related, nmi FROM s UNION ALL SELECT pair, col_b, col_a, nmi FROM s)
    SELECT col, related, nmi, row_number() OVER (PARTITION BY col ORDER BY nmi DESC, pair) AS rank FROM b
    QUALIFY row_number() OVER (PARTITION BY col ORDER BY nmi DESC, pair) <= 1""",
)
def nmi_topk(spark, sf):
    best = related_columns(nmi_pairs(fx.chain(spark, sf), fx.CHAIN_COLUMNS), 1)
    return best.select("col", "related", r6(F.col("nmi"), "nmi"), "rank")


def _cooccurrence_sql(table_name: str, columns: list[str]) -> str:
    parts = []
    for t in columns:
        for c in columns:
            if t == c:
                body = _entropy(table_name, f"coalesce({t}, 'null')", "true")
            else:
                pairs = f"(SELECT coalesce({t}, 'null') AS t, coalesce({c}, 'null') AS c FROM {table_name} GROUP BY 1, 2 HAVING count(*) > 1)"
                ht, hc, hp = (_entropy(pairs, g, "true") for g in ("t", "c", "t, c"))
                body = f"coalesce(greatest({ht} + {hc} - {hp}, 0), 0)"
            parts.append(f"SELECT '{t}' AS target, '{c}' AS col, {body} AS mi")
    union = " UNION ALL ".join(parts)
    return f"SELECT target, col, mi / max(mi) OVER (PARTITION BY target) AS score FROM ({union})"


@query(
    "cooccurrence_mi",
    f"WITH {fx.ORDERS_SQL} SELECT target, col, round(score, 6) AS score FROM ({_cooccurrence_sql('dirty', ['custkey', 'status', 'segment'])})",
)
def cooccurrence_mi_query(spark, sf):
    dirty = fx.orders_dirty(fx.orders_clean(spark, sf))
    return cooccurrence_mi(dirty, ["custkey", "status", "segment"]).select("target", "col", r6(F.col("score"), "score"))


@query(
    "informative_columns",
    f"""WITH {fx.CHAIN_SQL} SELECT target, col, round_even(round(score, 9), 1) AS weight
    FROM ({_cooccurrence_sql('chain', fx.CHAIN_COLUMNS)}) WHERE round_even(round(score, 9), 1) >= 0.5""",
)
def informative_columns_query(spark, sf):
    return informative_columns(cooccurrence_mi(fx.chain(spark, sf), fx.CHAIN_COLUMNS))


@query(
    "fd_parse",
    """WITH r AS (SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN c_name || ' → ' || c_mktsegment WHEN 1 THEN 'None → ' || c_mktsegment
      ELSE c_name || ' -> ' || c_mktsegment END AS fd FROM customer),
    p AS (SELECT *, nullif(regexp_extract(fd, '^(.+?)\\s*→\\s*(.+)$', 1), '') AS a, nullif(regexp_extract(fd, '^(.+?)\\s*→\\s*(.+)$', 2), '') AS b FROM r)
    SELECT c_custkey, fd, CASE WHEN a <> 'None' THEN a END AS determinant, CASE WHEN a <> 'None' THEN b END AS dependent,
      coalesce(a <> 'None', false) AS accepted FROM p""",
)
def fd_parse(spark, sf):
    step = F.col("c_custkey") % 3
    fd = (
        F.when(step == 0, F.concat("c_name", F.lit(" → "), "c_mktsegment"))
        .when(step == 1, F.concat(F.lit("None → "), "c_mktsegment"))
        .otherwise(F.concat("c_name", F.lit(" -> "), "c_mktsegment"))
    )
    return parse_fds(table(spark, sf, "customer").select("c_custkey", fd.alias("fd")))


_LOOKUP_SQL = """
counts AS (SELECT d.custkey AS k, d.segment AS v, count(*) AS n FROM dirty d JOIN mask m USING (row_id)
  WHERE NOT m.segment AND d.custkey IS NOT NULL AND d.segment IS NOT NULL GROUP BY 1, 2),
best AS (SELECT k, v FROM counts QUALIFY row_number() OVER (PARTITION BY k ORDER BY n DESC, v) = 1)"""


@query(
    "fd_validate",
    f"""WITH {fx.ORDERS_SQL}, {_LOOKUP_SQL},
    ex AS (SELECT d.custkey, coalesce(d.segment, 'null') AS dirty_value, c.segment AS truth FROM dirty d JOIN clean c USING (row_id) JOIN mask m USING (row_id) WHERE m.segment)
    SELECT count(*) AS examples, count(*) FILTER (WHERE coalesce(v, dirty_value) <> truth) AS mismatches,
      bool_and(coalesce(v, dirty_value) = truth) AS accepted FROM ex LEFT JOIN best ON k = custkey""",
)
def fd_validate_query(spark, sf):
    clean = fx.orders_clean(spark, sf)
    dirty, mask = fx.orders_dirty(clean), fx.orders_mask(clean).select("row_id", F.col("segment").alias("flag"))
    rows = dirty.join(mask, "row_id")
    lookup = fd_lookup(rows, F.col("custkey"), F.col("segment"), ~F.col("flag"))
    examples = rows.filter("flag").join(clean.select("row_id", F.col("segment").alias("truth")), "row_id").select(
        F.col("custkey").alias("key_value"), F.coalesce("segment", F.lit("null")).alias("dirty_value"), "truth"
    )
    return fd_validate(examples, lookup)


@query(
    "fd_repair",
    f"""WITH {fx.ORDERS_SQL}, {_LOOKUP_SQL}
    SELECT d.row_id, d.custkey, d.status, CASE WHEN m.segment THEN coalesce(v, d.segment) ELSE d.segment END AS segment
    FROM dirty d JOIN mask m USING (row_id) LEFT JOIN best ON k = d.custkey""",
)
def fd_repair_query(spark, sf):
    clean = fx.orders_clean(spark, sf)
    rows = fx.orders_dirty(clean).withColumn("flag", (F.col("row_id") % 10).isin(3, 7))
    return fd_repair(rows, "custkey", "segment", F.col("flag"), ~F.col("flag")).drop("flag")


@query(
    "end_to_end_fd_repair",
    f"""WITH {fx.ORDERS_SQL}, {_LOOKUP_SQL},
    fixed AS (SELECT d.row_id, CASE WHEN m.segment THEN coalesce(v, d.segment) ELSE d.segment END AS segment
      FROM dirty d JOIN mask m USING (row_id) LEFT JOIN best ON k = d.custkey),
    w AS (SELECT coalesce(d.segment, '') <> c.segment AS was, coalesce(f.segment, '') <> c.segment AS now
      FROM clean c JOIN dirty d USING (row_id) JOIN fixed f USING (row_id)),
    t AS (SELECT count(*) FILTER (WHERE was) AS wrong_before, count(*) FILTER (WHERE now) AS wrong_after,
      count(*) FILTER (WHERE was AND NOT now) AS wrong_to_right, count(*) FILTER (WHERE NOT was AND now) AS right_to_wrong FROM w)
    SELECT *, round((wrong_before - wrong_after) * 1.0::DOUBLE / wrong_before, 6) AS edr FROM t""",
)
def end_to_end_fd_repair(spark, sf):
    """Flagship: inject, repair by dependency, score."""
    clean = fx.orders_clean(spark, sf)
    dirty = fx.orders_dirty(clean)
    rows = dirty.withColumn("flag", (F.col("row_id") % 10).isin(3, 7))
    fixed = fd_repair(rows, "custkey", "segment", F.col("flag"), ~F.col("flag")).drop("flag")
    score = error_drop_rate(dirty, fixed, clean, "row_id")
    return score.withColumn("edr", r6(F.col("edr"), "edr"))


def _purity(a: str, b: str, source: str) -> str:
    usable = f"coalesce({a}, 'nan') <> 'nan' AND coalesce({b}, 'nan') <> 'nan'"
    return f"""SELECT '{a}' AS determinant, '{b}' AS dependent, coalesce(sum(size) FILTER (WHERE size >= 2), 0)::BIGINT AS support,
      sum(most) FILTER (WHERE size >= 2) * 1.0::DOUBLE / sum(size) FILTER (WHERE size >= 2) AS purity, count(*) * 1.0::DOUBLE / sum(size) AS share
      FROM (SELECT k, sum(n) AS size, max(n) AS most FROM (SELECT {a} AS k, {b} AS v, count(*) AS n FROM {source} WHERE {usable} GROUP BY 1, 2) GROUP BY 1)"""


@query(
    "fd_propose",
    f"WITH {fx.CHAIN_SQL} SELECT determinant, dependent, support, round(purity, 6) AS purity FROM ("
    + " UNION ALL ".join(_purity(a, b, "chain") for a in fx.CHAIN_COLUMNS for b in fx.CHAIN_COLUMNS if a != b)
    + ") WHERE share <= 0.9 AND support > 0",
)
def fd_propose_query(spark, sf):
    scores = fd_propose(fx.chain(spark, sf), fx.CHAIN_COLUMNS)
    return scores.select("determinant", "dependent", "support", r6(F.col("purity"), "purity"))


@query(
    "fd_violations",
    f"""WITH {fx.ORDERS_SQL}, counts AS (SELECT custkey AS k, segment AS v, count(*) AS n FROM dirty WHERE segment IS NOT NULL GROUP BY 1, 2),
    best AS (SELECT k, v FROM counts QUALIFY row_number() OVER (PARTITION BY k ORDER BY n DESC, v) = 1)
    SELECT row_id, custkey AS group_key, segment AS actual, v AS expected FROM dirty JOIN best ON k = custkey
    WHERE segment IS DISTINCT FROM v""",
)
def fd_violations_query(spark, sf):
    return fd_violations(fx.orders_dirty(fx.orders_clean(spark, sf)), "row_id", ["custkey"], "segment")


@query(
    "type_constraint_check",
    f"""WITH {fx.ORDERS_SQL} SELECT d.row_id, coalesce(regexp_matches(custkey, '^[0-9]{{3}}$'), false) AS custkey,
      coalesce(regexp_matches(status, '^[A-Za-z]{{1}}$'), false) AS status,
      coalesce(segment IN ('AUTOMOBILE', 'BUILDING', 'FURNITURE', 'MACHINERY', 'HOUSEHOLD'), false) AS segment,
      o_orderkey % 4 <> 1 AS day, true AS phone, o_orderkey % 10 <> 3 AS present,
      coalesce(regexp_matches(custkey, '^[1-9][0-9]*$'), false) AS zip
    FROM dirty d JOIN orders ON o_orderkey = row_id""",
)
def type_constraint_check(spark, sf):
    dirty = fx.orders_dirty(fx.orders_clean(spark, sf))
    step = F.col("o_orderkey") % 4
    day = (
        F.when(step == 0, F.date_format("o_orderdate", "M/d/yy"))
        .when(step == 1, F.lit("13/45/99x"))
        .otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
    )
    dates = table(spark, sf, "orders").select(F.col("o_orderkey").alias("row_id"), day.alias("day"), F.lit("555-1234").alias("phone"))
    rules = {
        "custkey": "3 digits",
        "status": "1 letters",
        "segment": "predefined list",
        "day": "date",
        "phone": "7 formatted digits",
        "present": "not null",
        "zip": "non-zero-leading digits",
    }
    lists = {"segment": ["AUTOMOBILE", "BUILDING", "FURNITURE", "MACHINERY", "HOUSEHOLD"]}
    rows = dirty.join(dates, "row_id").withColumn("present", F.col("segment")).withColumn("zip", F.col("custkey"))
    return type_check(rows, "row_id", rules, lists)
