"""Detection rules, labels, examples, value functions, and the end-to-end flows."""

from __future__ import annotations

from pyspark.sql import functions as F

from cellsmith.operators import repair as rp
from cellsmith.operators.detect import fit_column_forest, rule_mask, rule_scores, score_cells, synthetic_errors
from cellsmith.operators.providers import labels_from_function, labels_from_predicates, labels_from_table
from cellsmith.plans.corrector import CellCorrector
from cellsmith.plans.detector import CellDetector
from workload import fixtures as fx
from workload.registry import query, r6, sql_bucket, table

RULES = {
    "no_typo": "substring(name, 2, 1) <> 'x'",
    "two_words": "size(split(name, ' ')) = 2",
    "short": "length(name) < 9",
    "number": "try_cast(name AS double) > 0",
}


def _labelled_parts(spark, sf):
    clean = fx.typo_clean(spark, sf)
    labels = fx.typo_mask(clean).select("row_id", F.col("name").cast("int").alias("label"))
    return fx.typo_dirty(clean).join(labels, "row_id")


@query(
    "rule_filter",
    f"""WITH {fx.TYPO_SQL}, l AS (SELECT d.name, m.name AS bad FROM dirty d JOIN mask m USING (row_id))
    SELECT 'no_typo' AS rule, round(avg(CAST((substr(name, 2, 1) <> 'x') = NOT bad AS INTEGER)), 6) AS accuracy FROM l UNION ALL
    SELECT 'two_words', round(avg(CAST((len(string_split(name, ' ')) = 2) = NOT bad AS INTEGER)), 6) FROM l UNION ALL
    SELECT 'short', round(avg(CAST((length(name) < 9) = NOT bad AS INTEGER)), 6) FROM l UNION ALL
    SELECT 'number', round(avg(CAST(coalesce(try_cast(name AS DOUBLE) > 0, true) = NOT bad AS INTEGER)), 6) FROM l""",
)
def rule_filter(spark, sf):
    return rule_scores(_labelled_parts(spark, sf), RULES).select("rule", r6(F.col("accuracy"), "accuracy"))


@query(
    "rule_detect",
    f"""WITH {fx.TYPO_SQL} SELECT row_id, substr(name, 2, 1) = 'x' OR len(string_split(name, ' ')) <> 2 AS name, coalesce(brand = 'Brand#7', false) AS brand FROM dirty""",
)
def rule_detect(spark, sf):
    dirty = fx.typo_dirty(fx.typo_clean(spark, sf))
    rules = {"name": [RULES["no_typo"], RULES["two_words"], RULES["number"]], "brand": ["brand <> 'Brand#7'"]}
    return rule_mask(dirty, "row_id", rules)


@query(
    "provider_labels",
    """SELECT d.doc_id, 'table' AS source, 1 - quality AS label FROM documents d JOIN labels USING (doc_id) UNION ALL
    SELECT doc_id, 'predicate', CAST(n_chars < 200 OR lang = 'fr' AS INTEGER) FROM documents UNION ALL
    SELECT doc_id, 'answer', CAST(n_chars % 2 = 1 AS INTEGER) FROM documents""",
)
def provider_labels(spark, sf):
    documents = table(spark, sf, "documents")
    labels = table(spark, sf, "labels").withColumn("wrong", 1 - F.col("quality"))

    def answer(pdf, column):
        return (pdf["n_chars"] % 2 == 1).map(lambda odd: '{"has_error_in_text_value": %s}' % ("true" if odd else "false"))

    providers = {
        "table": labels_from_table(labels, "wrong"),
        "predicate": labels_from_predicates({"text": "n_chars < 200 OR lang = 'fr'"}),
        "answer": labels_from_function(answer),
    }
    out = None
    for source, provider in providers.items():
        part = provider(documents.select("doc_id", "n_chars", "lang"), "doc_id", "text").select("doc_id", F.lit(source).alias("source"), "label")
        out = part if out is None else out.unionByName(part)
    return out


_KIND = sql_bucket("'err5|' || row_id", 4)


@query(
    "synthetic_errors",
    f"""WITH {fx.TYPO_SQL}, k AS (SELECT row_id, name, {_KIND} AS k FROM clean)
    SELECT row_id, CASE k WHEN 0 THEN 'missing' WHEN 1 THEN 'typo' WHEN 2 THEN 'pattern' ELSE 'domain' END AS kind, name AS clean,
      CASE k WHEN 0 THEN '' WHEN 1 THEN substr(name, 1, 1) || 'x' || substr(name, 3) WHEN 2 THEN '#' || name
        ELSE CASE WHEN try_cast(name AS DOUBLE) IS NOT NULL THEN name || '000' ELSE 'zz' || reverse(name) END END AS error FROM k""",
)
def synthetic_errors_query(spark, sf):
    return synthetic_errors(fx.typo_clean(spark, sf), "row_id", "name", seed=5)


def _chosen(clean):
    return clean.filter((F.col("row_id") % 260).isin(5, 8, 11, 18, 21)).select("row_id")


_SQUEEZE = "regexp_replace(regexp_replace(lower({v}), '\\s*(oz|ounces|%)\\.?$', ''), '[^a-z0-9]', '', 'g')"

_EXAMPLES_SQL = f"""{fx.PRIORITY_SQL},
ex AS (SELECT row_id, 'priority' AS col, '{{"status":"' || coalesce(d.status, 'null') || '","priority":"' || coalesce(d.priority, 'null') || '"}}' AS context, coalesce(d.priority, 'null') AS dirty, c.priority AS truth FROM dirty d JOIN clean c USING (row_id)
  WHERE row_id % 260 IN (5, 8, 11, 18, 21) AND coalesce(d.priority, 'null') <> c.priority),
typed AS (SELECT *, CASE WHEN dirty IN ('', 'null', 'nan') THEN 'Missing Value'
  WHEN {_SQUEEZE.format(v='dirty')} = {_SQUEEZE.format(v='truth')} THEN 'Formatting Issue' WHEN levenshtein(dirty, truth) <= 2 THEN 'Typo'
  ELSE 'Violation of Functional Dependency' END AS error_type FROM ex)"""


def _examples(spark, sf):
    clean = fx.priority_clean(spark, sf)
    dirty = fx.priority_dirty(clean)
    return rp.repair_examples(dirty, clean, _chosen(clean), "row_id", ["status", "priority"])


@query("repair_examples", f"WITH {_EXAMPLES_SQL} SELECT row_id, col, context, dirty, truth, error_type FROM typed")
def repair_examples_query(spark, sf):
    return _examples(spark, sf)


@query(
    "clean_examples",
    """WITH o AS (SELECT *, '{"status":"' || o_orderstatus || '","priority":"' || o_orderpriority || '"}' AS context FROM orders WHERE o_orderkey % 130 = 1)
    SELECT o_orderkey AS row_id, 'priority' AS col, context, o_orderpriority AS dirty, o_orderpriority AS truth, 'clean' AS error_type FROM o
    UNION ALL SELECT o_orderkey, 'status', context, o_orderstatus, o_orderstatus, 'clean' FROM o""",
)
def clean_examples_query(spark, sf):
    clean = fx.priority_clean(spark, sf)
    rows = clean.filter("row_id % 130 = 1").select("row_id")
    return rp.clean_examples(fx.priority_dirty(clean), rows, "row_id", ["status", "priority"])


@query(
    "split_half",
    f"""WITH {_EXAMPLES_SQL} SELECT row_id, col, CASE WHEN row_number() OVER (PARTITION BY col ORDER BY md5('3|' || row_id), row_id) <= floor(count(*) OVER (PARTITION BY col) / 2)
      THEN 'train' ELSE 'validation' END AS part FROM typed""",
)
def split_half_query(spark, sf):
    return rp.split_half(_examples(spark, sf), "row_id", seed=3).select("row_id", "col", "part")


@query(
    "route_columns",
    f"""WITH {_EXAMPLES_SQL}, mixed AS (SELECT col, error_type FROM typed UNION ALL SELECT 'formatted', error_type FROM typed WHERE error_type = 'Formatting Issue')
    SELECT col, CASE WHEN bool_and(error_type IN ('clean', 'Formatting Issue')) THEN 'value' ELSE 'dependency' END AS path FROM mixed GROUP BY col""",
)
def route_columns_query(spark, sf):
    examples = _examples(spark, sf).select("col", "error_type")
    formatted = examples.filter("error_type = 'Formatting Issue'").withColumn("col", F.lit("formatted"))
    return rp.route_columns(examples.unionByName(formatted))


@query(
    "value_function_repair",
    f"""WITH {fx.PRIORITY_SQL} SELECT d.row_id, d.status, CASE WHEN m.priority AND d.priority IS NOT NULL THEN upper(regexp_replace(d.priority, ' *(oz|ounces|%)[.]?$', ''))
      ELSE d.priority END AS priority FROM dirty d JOIN mask m USING (row_id)""",
)
def value_function_repair(spark, sf):
    """Repairs the table with its gaps. A gap holds nothing that a function of the cell could turn into the truth, so the
    function is chosen by the same rows with their formatting errors alone."""
    clean = fx.priority_clean(spark, sf)
    dirty = fx.priority_dirty(clean)
    examples = rp.repair_examples(fx.priority_formatted(clean), clean, _chosen(clean), "row_id", ["status", "priority"])
    chosen = rp.choose_value_functions(examples)
    rows = dirty.join(fx.priority_mask(clean).select("row_id", F.col("priority").alias("_flag")), "row_id")
    expression = rp.VALUE_FUNCTIONS[chosen["priority"]]
    return rp.apply_value_function(rows, "priority", F.col("_flag"), expression).drop("_flag")


@query(
    "residual_cells",
    f"""WITH {fx.PRIORITY_SQL}, fixed AS (SELECT row_id, status, CASE WHEN row_id % 13 = 5 THEN upper(priority) ELSE priority END AS priority FROM dirty)
    SELECT row_id, 'priority' AS col, coalesce(d.priority, 'null') AS dirty FROM dirty d JOIN fixed f USING (row_id) JOIN mask m USING (row_id)
    WHERE m.priority AND coalesce(d.priority, 'null') = coalesce(f.priority, 'null')""",
)
def residual_cells_query(spark, sf):
    clean = fx.priority_clean(spark, sf)
    dirty, mask = fx.priority_dirty(clean), fx.priority_mask(clean)
    fixed = rp.apply_value_function(dirty, "priority", F.col("row_id") % 13 == 5, "upper({v})")
    return rp.residual_cells(dirty, fixed, mask, "row_id")


_GRAM_DIMS = 32


@query(
    "cell_embeddings",
    f"""WITH {fx.TYPO_SQL}, vals AS (SELECT DISTINCT name AS value FROM dirty UNION SELECT DISTINCT brand FROM dirty),
    t AS (SELECT value, '^' || value || '$' AS s FROM vals), g AS (SELECT value, substr(s, CAST(i AS INTEGER), 3) AS gram FROM t, range(1, 200) r(i) WHERE i <= greatest(length(s) - 2, 1)),
    b AS (SELECT value, (unicode(substr(gram, 1, 1)) * 7919 + unicode(substr(gram, 2, 1)) * 104729 + unicode(substr(gram, 3, 1)) * 1299709) % 1000003 % {_GRAM_DIMS} AS slot, count(*) AS n FROM g GROUP BY 1, 2)
    SELECT value, CAST(slot AS INTEGER) AS slot, round(n / sqrt(sum(n * n) OVER (PARTITION BY value)), 6) AS weight FROM b""",
)
def cell_embeddings(spark, sf):
    dictionary = rp.embedding_dictionary(fx.typo_dirty(fx.typo_clean(spark, sf)), ["name", "brand"], _GRAM_DIMS)
    opened = dictionary.select("value", F.posexplode("vec").alias("slot", "weight")).filter("weight <> 0")
    return opened.select("value", "slot", r6(F.col("weight"), "weight"))


def _typo_values(spark, sf):
    return _labelled_parts(spark, sf).groupBy(F.col("name").alias("value"), "label").agg(F.count("*").alias("weight"))


@query("column_forest")
def column_forest(spark, sf):
    """Fitted on half of the distinct values, scored on the rows of the other half."""
    train = F.conv(F.substring(F.md5("value"), 1, 8), 16, 10).cast("bigint") % 2 == 0
    model = fit_column_forest(_typo_values(spark, sf).filter(train))
    rows = fx.typo_dirty(fx.typo_clean(spark, sf)).select("row_id", "name").withColumn("value", F.col("name"))
    scored = score_cells(rows.filter(~train).drop("value"), "row_id", {"name": model}, {})
    truth = fx.typo_mask(fx.typo_clean(spark, sf)).select("row_id", F.col("name").alias("truth"))
    return scored.join(truth, "row_id")


@query(
    "score_cells",
    f"WITH {fx.TYPO_SQL} SELECT row_id, substr(name, 2, 1) = 'x' AS name, false AS brand, false AS kind FROM dirty",
)
def score_cells_query(spark, sf):
    dirty = fx.typo_dirty(fx.typo_clean(spark, sf))
    return score_cells(dirty, "row_id", {}, {"name": [RULES["no_typo"]]}, use_model=False)


@query("detect_cells")
def detect_cells(spark, sf):
    dirty = fx.typo_dirty(fx.typo_clean(spark, sf))
    provider = labels_from_predicates({"name": "substring(name, 2, 1) = 'x'"})
    rules = {"name": {k: RULES[k] for k in ("no_typo", "two_words")}}
    return CellDetector("row_id", provider, rules).fit_transform(dirty)


@query("correct_cells", f"WITH {fx.ORDERS_SQL} SELECT * FROM clean")
def correct_cells(spark, sf):
    """Every injected error is repairable here, so the corrected table must equal the clean one."""
    clean = fx.orders_clean(spark, sf)
    return CellCorrector("row_id").fit_transform(fx.orders_dirty(clean), fx.orders_mask(clean), clean)


_TYPO_COLUMNS = ["name", "brand", "kind"]
_SLOT = f"(unicode(substr(gram, 1, 1)) * 7919 + unicode(substr(gram, 2, 1)) * 104729 + unicode(substr(gram, 3, 1)) * 1299709) % 1000003 % {rp.EMBED_DIMS}"


def _blocks_sql(rows: str, weights: dict[str, float]) -> str:
    """(row_id, slot, weight) of weighted trigram blocks side by side; a flagged cell has none."""
    cells = " UNION ALL ".join(
        f"SELECT row_id, {at * rp.EMBED_DIMS} AS base, {w}::DOUBLE AS w, '^' || {c} || '$' AS s FROM {rows} WHERE NOT _f_{c}"
        for at, (c, w) in enumerate(weights.items())
    )
    return f"""cells AS ({cells}),
    g AS (SELECT row_id, base, w, substr(s, CAST(i AS INTEGER), 3) AS gram FROM cells, range(1, 200) r(i) WHERE i <= greatest(length(s) - 2, 1)),
    slots AS (SELECT row_id, base, w, {_SLOT} AS slot, count(*) AS n FROM g GROUP BY ALL),
    vec AS (SELECT row_id, CAST(base + slot AS INTEGER) AS slot, w * n / sqrt(sum(n * n) OVER (PARTITION BY row_id, base)) AS weight FROM slots)"""


_FLAGGED_SQL = f"flat AS (SELECT d.*, {', '.join(f'm.{c} AS _f_{c}' for c in _TYPO_COLUMNS)} FROM dirty d JOIN mask m USING (row_id))"


@query(
    "retrieval_index",
    f"""WITH {fx.TYPO_SQL}, {_FLAGGED_SQL}, whole AS (SELECT row_id, name, brand, kind, false AS _f_name, false AS _f_brand, false AS _f_kind FROM flat),
    {_blocks_sql('whole', dict.fromkeys(_TYPO_COLUMNS, 1.0))},
    entry AS (SELECT row_id AS id, '{{' || CASE WHEN _f_name THEN '' ELSE '"name":"' || name || '",' END || '"brand":"' || brand || '","kind":"' || kind || '"}}' AS context,
      name AS target_value, CAST(_f_name AS INTEGER) AS target_flag, CAST(_f_name AS INTEGER) AS flag_count FROM flat)
    SELECT e.*, count(*) AS slots, round(sum(v.weight), 6) AS total, round(sum(v.weight * v.slot), 4) AS moment FROM entry e JOIN vec v ON v.row_id = e.id GROUP BY ALL""",
)
def retrieval_index_query(spark, sf):
    """Index entries; the vector enters the comparison by its size, sum and first moment."""
    clean = fx.typo_clean(spark, sf)
    index = rp.retrieval_index(fx.typo_dirty(clean), fx.typo_mask(clean), "row_id", "name", _TYPO_COLUMNS)
    # The outer form: of the plain one Spark infers a filter that embeds every row once more before it is spread.
    opened = index.select("*", F.posexplode_outer("vec").alias("slot", "weight")).filter("weight <> 0")
    keys = ["id", "context", "target_value", "target_flag", "flag_count"]
    return opened.groupBy(*keys).agg(
        F.count("*").alias("slots"), F.round(F.sum("weight"), 6).alias("total"), F.round(F.sum(F.col("weight") * F.col("slot")), 4).alias("moment")
    )


_WEIGHTS = {"name": 1.0, "brand": 0.5, "kind": 2.0}


@query(
    "masked_query_vectors",
    f"WITH {fx.TYPO_SQL}, {_FLAGGED_SQL}, asked AS (SELECT * FROM flat WHERE _f_name), {_blocks_sql('asked', _WEIGHTS)} SELECT row_id AS id, slot, round(weight, 6) AS weight FROM vec",
)
def masked_query_vectors(spark, sf):
    """Vectors that the retrieval route asks with: flagged cells left out, blocks weighted."""
    clean = fx.typo_clean(spark, sf)
    cells = fx.typo_mask(clean).filter("name").select("row_id")
    vectors = rp.query_vectors(fx.typo_dirty(clean), fx.typo_mask(clean), "row_id", cells, _WEIGHTS)
    opened = vectors.select("id", F.posexplode_outer("vec").alias("slot", "weight")).filter("weight <> 0")
    return opened.select("id", "slot", r6(F.col("weight"), "weight"))


@query(
    "repair_log",
    f"""WITH {fx.ORDERS_SQL} SELECT d.row_id, 'segment' AS col, coalesce(d.segment, 'null') AS dirty, c.segment AS correction
    FROM dirty d JOIN clean c USING (row_id) JOIN mask m USING (row_id) WHERE m.segment""",
)
def repair_log_query(spark, sf):
    """The log of the end-to-end corrector and the cells repaired by hand: together every flagged cell, once."""
    clean = fx.orders_clean(spark, sf)
    corrector = CellCorrector("row_id")
    corrector.fit_transform(fx.orders_dirty(clean), fx.orders_mask(clean), clean)
    by_hand = corrector.examples.filter("error_type <> 'clean'").select("row_id", "col", "dirty", F.col("truth").alias("correction"))
    return corrector.log.select("row_id", "col", "dirty", "correction").unionByName(by_hand)
