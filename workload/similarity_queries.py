"""Neighbours, clusters, representatives, outliers and fills over the shared vectors and parts."""

from __future__ import annotations

from pyspark.sql import functions as F

from cellsmith.functions.scalars import FEATURES, cell_features, minmax_stats, scaled
from cellsmith.operators.cluster import (
    clean_representatives,
    elbow_costs,
    eps_components,
    hierarchical_clusters,
    knee,
    medoids,
    nearest_to_mean,
    propagate_labels,
    repair_candidates,
)
from cellsmith.operators.detect import contamination, cut_by_share, isolation_scores, lof_scores
from cellsmith.operators.fill import baseline_correct, knn_fill
from cellsmith.operators.cells import row_any
from cellsmith.operators.repair import (
    joined_contexts,
    masked_row_vectors,
    neighbour_majority,
    rerank,
    retrieve,
    upsert_index,
    zero_and_weight,
)
from cellsmith.operators.similarity import knn_join
from cellsmith.session import checkpointed, spread_rows
from workload import fixtures as fx
from workload.registry import query, r6

D = fx.VECTOR_DIMS

_KNN_SQL = f"""{fx.VECTOR_SQL},
pairs AS (SELECT a.vec_id AS qid, b.vec_id AS iid, round({fx.sql_d2('a.v', 'b.v')}, 9) AS d2 FROM vecs a, vecs b)"""


@query(
    "knn_topk",
    f"""WITH {_KNN_SQL} SELECT qid, iid, round(d2, 6) AS d2, row_number() OVER (PARTITION BY qid ORDER BY d2, iid) AS rank FROM pairs
    QUALIFY row_number() OVER (PARTITION BY qid ORDER BY d2, iid) <= 30""",
)
def knn_topk(spark, sf):
    rows = fx.vectors(spark, sf).select(F.col("vec_id").alias("id"), "vec")
    return knn_join(rows, rows, 30, D).select("qid", "iid", r6(F.col("d2"), "d2"), "rank")


# Entries of the retrieval index: the label is the target column, every seventh label is flagged.
_INDEX_SQL = f"""{_KNN_SQL},
meta AS (SELECT vec_id AS iid, CAST(label AS VARCHAR) AS target_value, CAST(vec_id % 7 = 3 AS INTEGER) AS target_flag,
  CAST(vec_id % 7 = 3 AS INTEGER) + CAST(vec_id % 5 = 1 AS INTEGER) AS flag_count, 'row ' || vec_id AS context FROM vecs),
hits AS (SELECT p.*, target_value, target_flag, flag_count, context FROM (SELECT * FROM pairs WHERE qid % 7 = 3
  QUALIFY row_number() OVER (PARTITION BY qid ORDER BY d2, iid) <= 30) p JOIN meta USING (iid))"""


def _index(spark, sf):
    step = (F.col("vec_id") % 7 == 3).cast("int")
    return fx.vectors(spark, sf).select(
        F.col("vec_id").alias("id"),
        "vec",
        F.concat(F.lit("row "), "vec_id").alias("context"),
        F.col("label").cast("string").alias("target_value"),
        step.alias("target_flag"),
        (step + (F.col("vec_id") % 5 == 1).cast("int")).alias("flag_count"),
    )


def _hits(spark, sf):
    index = _index(spark, sf)
    return retrieve(index.filter("target_flag = 1").select("id", "vec"), index, D, 30)


@query(
    "knn_rerank",
    f"""WITH {_INDEX_SQL}, k AS (SELECT qid, context, row_number() OVER (PARTITION BY qid ORDER BY round(d2, 2), target_flag, flag_count, iid) AS position FROM hits)
    SELECT qid, string_agg(context, chr(10) ORDER BY position) AS neighbours FROM k WHERE position <= 3 GROUP BY qid""",
)
def knn_rerank(spark, sf):
    return joined_contexts(rerank(_hits(spark, sf)))


@query(
    "neighbour_repair",
    f"""WITH {_INDEX_SQL}, c AS (SELECT qid, target_value, count(*) AS n FROM hits WHERE target_flag = 0 GROUP BY 1, 2)
    SELECT qid, target_value AS correction FROM c QUALIFY row_number() OVER (PARTITION BY qid ORDER BY n DESC, target_value) = 1""",
)
def neighbour_repair(spark, sf):
    return neighbour_majority(_hits(spark, sf))


@query(
    "index_upsert",
    f"""WITH {fx.VECTOR_SQL} SELECT vec_id AS id, CASE WHEN vec_id % 10 = 4 THEN 'repaired ' ELSE 'row ' END || vec_id AS context,
      round(list_sum(list_transform(v, lambda z: CASE WHEN vec_id % 10 = 4 THEN 2 * z ELSE z END)), 6) AS total FROM vecs""",
)
def index_upsert(spark, sf):
    base = fx.vectors(spark, sf).select(F.col("vec_id").alias("id"), "vec", F.concat(F.lit("row "), "vec_id").alias("context"))
    doubled = F.transform("vec", lambda v: v * 2)
    fresh = base.filter("id % 10 = 4").select("id", doubled.alias("vec"), F.concat(F.lit("repaired "), "id").alias("context"))
    out = upsert_index(base, fresh)
    return out.select("id", "context", r6(F.aggregate("vec", F.lit(0.0), lambda s, v: s + v), "total"))


@query(
    "query_vectors",
    f"""WITH {fx.VECTOR_SQL} SELECT vec_id, i, round(v[i] * CASE WHEN i <= 16 THEN 1.0 WHEN i <= 32 THEN (CASE WHEN vec_id % 3 = 0 THEN 0.0 ELSE 0.7 END)
      WHEN i <= 48 THEN 0.5 ELSE (CASE WHEN vec_id % 4 = 1 THEN 0.0 ELSE 0.9 END) END, 6) + 0.0 AS value FROM vecs, range(1, 65) t(i)""",
)
def query_vectors_query(spark, sf):
    key = F.col("vec_id")
    flags = [F.lit(False), key % 3 == 0, F.lit(False), key % 4 == 1]
    vec = zero_and_weight(F.col("vec"), flags, [1.0, 0.7, 0.5, 0.9], 16)
    opened = fx.vectors(spark, sf).select("vec_id", F.posexplode(vec).alias("i", "value"))
    return opened.select("vec_id", (F.col("i") + 1).cast("bigint").alias("i"), r6(F.col("value"), "value"))


@query(
    "lof_scores",
    f"""WITH {_KNN_SQL}, e AS (SELECT qid, iid, sqrt(d2) AS dist FROM pairs WHERE qid <> iid QUALIFY row_number() OVER (PARTITION BY qid ORDER BY d2, iid) <= 20),
    k AS (SELECT qid, max(dist) AS kdist FROM e GROUP BY 1), l AS (SELECT e.qid, 1 / (avg(greatest(kdist, dist)) + 1e-10) AS lrd FROM e JOIN k ON k.qid = e.iid GROUP BY 1)
    SELECT e.qid AS vec_id, round(avg(o.lrd) / any_value(l.lrd), 6) AS score FROM e JOIN l o ON o.qid = e.iid JOIN l ON l.qid = e.qid GROUP BY e.qid""",
)
def lof_scores_query(spark, sf):
    return lof_scores(fx.vectors(spark, sf), "vec_id", D).select("vec_id", r6(F.col("score"), "score"))


@query(
    "cluster_representative",
    f"""WITH {fx.VECTOR_SQL}, m AS (SELECT label, i, avg(v[i]) AS c FROM vecs, range(1, 65) t(i) GROUP BY 1, 2),
    d AS (SELECT label, vec_id, round(sqrt(sum((v[i] - c) * (v[i] - c))), 9) AS distance FROM vecs JOIN m USING (label) GROUP BY 1, 2)
    SELECT label, vec_id AS representative, round(distance, 6) AS distance FROM d QUALIFY row_number() OVER (PARTITION BY label ORDER BY distance, vec_id) = 1""",
)
def cluster_representative(spark, sf):
    out = nearest_to_mean(fx.vectors(spark, sf), "vec_id", "label")
    return out.select("label", "representative", r6(F.col("distance"), "distance"))


_MEDOID_SQL = f"""{fx.VECTOR_SQL},
totals AS (SELECT a.label, a.vec_id, round(sum(sqrt({fx.sql_d2('a.v', 'b.v')})), 6) AS total FROM vecs a JOIN vecs b USING (label) GROUP BY 1, 2),
best AS (SELECT label, vec_id AS representative, total AS total_distance FROM totals QUALIFY row_number() OVER (PARTITION BY label ORDER BY total, vec_id) = 1)"""


@query("cluster_medoid", f"WITH {_MEDOID_SQL} SELECT label, representative, round(total_distance, 5) AS total_distance FROM best")
def cluster_medoid(spark, sf):
    out = medoids(fx.vectors(spark, sf), "vec_id", "label")
    return out.select("label", "representative", F.round("total_distance", 5).alias("total_distance"))


@query(
    "propagate_labels",
    f"""WITH {_MEDOID_SQL} SELECT vec_id, v.label AS cluster, CAST(representative % 2 AS INTEGER) AS label FROM vecs v JOIN best b ON b.label = v.label WHERE v.label % 3 <> 1""",
)
def propagate_labels_query(spark, sf):
    members = fx.vectors(spark, sf).withColumnRenamed("label", "cluster")
    chosen = medoids(members, "vec_id", "cluster").select("cluster", "representative")
    answers = chosen.filter("cluster % 3 <> 1").select(
        F.col("representative").alias("vec_id"), (F.col("representative") % 2).cast("int").alias("label")
    )
    return propagate_labels(members.select("vec_id", "cluster"), chosen, answers, "vec_id")


EPS = 1.1


@query(
    "eps_components",
    f"""WITH RECURSIVE {fx.VECTOR_SQL}, links AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b FROM vecs a JOIN vecs b ON a.vec_id <> b.vec_id AND sqrt({fx.sql_d2('a.v', 'b.v')}) <= {EPS}),
    reach(a, b) AS (SELECT a, b FROM links UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a)
    SELECT vec_id, CASE WHEN count(b) = 0 THEN -1 ELSE least(min(b), vec_id) END AS cluster FROM vecs LEFT JOIN reach ON a = vec_id GROUP BY vec_id""",
)
def eps_components_query(spark, sf):
    return eps_components(fx.vectors(spark, sf), "vec_id", EPS)


def _name_points(spark, sf):
    """Distinct dirty part names with scaled cell features and their multiplicity."""
    names = fx.typo_dirty(fx.typo_clean(spark, sf)).groupBy("name").agg(F.count("*").alias("copies"), F.min("row_id").alias("id"))
    rows = checkpointed(names.select("id", "name", "copies", *cell_features(F.col("name"))))
    stats = minmax_stats(rows, FEATURES)
    return rows.select("id", "name", "copies", F.array(*[scaled(F.col(f), stats[f]) for f in FEATURES]).alias("vec"))


@query("elbow_k")
def elbow_k_query(spark, sf):
    points = _name_points(spark, sf)
    costs = elbow_costs(points, "vec", "copies")
    best = F.lit(knee(costs))
    curve = F.array(*[F.struct(F.lit(i + 1).alias("k"), F.lit(c).alias("cost")) for i, c in enumerate(costs)])
    return points.agg(F.sum("copies").alias("rows")).select("rows", F.inline(curve)).withColumn("elbow", best)


@query("hierarchical_clusters")
def hierarchical_clusters_query(spark, sf):
    return hierarchical_clusters(_name_points(spark, sf), 4, "vec", "copies").select("id", "name", "copies", "cluster")


@query("isolation_forest")
def isolation_forest(spark, sf):
    orders = fx.priority_clean(spark, sf)
    truth = row_any(fx.priority_mask(orders), "row_id")
    price = fx.table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("row_id"),
        (F.col("o_totalprice") * F.when(F.col("o_orderkey") % 13 == 5, 40).otherwise(1)).alias("price"),
        F.col("o_custkey").cast("double").alias("customer"),
    )
    return cut_by_share(isolation_scores(price, "row_id", ["price", "customer"]), "row_id", contamination(truth))


@query(
    "knn_fill",
    f"""WITH {fx.PART_SQL},
    need AS (SELECT row_id, 0 AS t FROM gaps WHERE size IS NULL UNION ALL SELECT row_id, 1 FROM gaps WHERE price IS NULL),
    pairs AS (SELECT n.row_id, n.t, b.row_id AS donor, CASE n.t WHEN 0 THEN b.size ELSE b.price END AS v,
      round(3.0::DOUBLE / ((a.size IS NOT NULL AND b.size IS NOT NULL)::INT + (a.price IS NOT NULL AND b.price IS NOT NULL)::INT + 1)
        * (coalesce(pow(a.size - b.size, 2), 0) + coalesce(pow(a.price - b.price, 2), 0) + pow(a.width - b.width, 2)), 6) AS d2
      FROM need n JOIN gaps a ON a.row_id = n.row_id JOIN gaps b ON CASE n.t WHEN 0 THEN b.size ELSE b.price END IS NOT NULL),
    best AS (SELECT row_id, t, avg(v) AS v FROM (SELECT * FROM pairs QUALIFY row_number() OVER (PARTITION BY row_id, t ORDER BY d2, donor) <= 5) GROUP BY 1, 2)
    SELECT g.row_id, round(coalesce(size, s.v), 6) AS size, round(coalesce(price, p.v), 6) AS price, width FROM gaps g
    LEFT JOIN best s ON s.row_id = g.row_id AND s.t = 0 LEFT JOIN best p ON p.row_id = g.row_id AND p.t = 1""",
)
def knn_fill_query(spark, sf):
    filled = knn_fill(fx.part_gaps(fx.part_truth(spark, sf)), "row_id", fx.PART_COLUMNS)
    return filled.select("row_id", r6(F.col("size"), "size"), r6(F.col("price"), "price"), "width")


_CODED = [(c, f"(SELECT {c} AS v, row_number() OVER (ORDER BY {c}) - 1 AS code FROM (SELECT DISTINCT {c} FROM blank WHERE {c} IS NOT NULL))") for c in ("name", "brand", "kind")]
_GAP = " + ".join(f"coalesce(pow(a.{c} - b.{c}, 2), 0)" for c, _ in _CODED)
_SHARED = " + ".join(f"(a.{c} IS NOT NULL AND b.{c} IS NOT NULL)::INT" for c, _ in _CODED)


@query(
    "baseline_correct_knn",
    f"""WITH {fx.TYPO_SQL},
    blank AS (SELECT d.row_id, {', '.join(f"CASE WHEN m.{c} THEN NULL ELSE d.{c} END AS {c}" for c, _ in _CODED)} FROM dirty d JOIN mask m USING (row_id)),
    x AS (SELECT row_id, {', '.join(f"CAST({c}_k.code AS DOUBLE) AS {c}" for c, _ in _CODED)} FROM blank {' '.join(f"LEFT JOIN {t} {c}_k ON blank.{c} = {c}_k.v" for c, t in _CODED)}),
    need AS ({' UNION ALL '.join(f"SELECT row_id, '{c}' AS t FROM x WHERE {c} IS NULL" for c, _ in _CODED)}),
    pairs AS (SELECT n.row_id, n.t, b.row_id AS donor, CASE n.t {' '.join(f"WHEN '{c}' THEN b.{c}" for c, _ in _CODED)} END AS v,
      {_SHARED} AS shared, round(3.0::DOUBLE / nullif({_SHARED}, 0) * ({_GAP}), 6) AS d2
      FROM need n JOIN x a ON a.row_id = n.row_id JOIN x b ON CASE n.t {' '.join(f"WHEN '{c}' THEN b.{c}" for c, _ in _CODED)} END IS NOT NULL),
    best AS (SELECT row_id, t, avg(v) AS v FROM (SELECT * FROM pairs WHERE shared > 0 QUALIFY row_number() OVER (PARTITION BY row_id, t ORDER BY d2, donor) <= 5) GROUP BY 1, 2),
    full_x AS (SELECT x.row_id, {', '.join(f"coalesce(x.{c}, b_{c}.v, (SELECT avg({c}) FROM x)) AS {c}" for c, _ in _CODED)} FROM x {' '.join(f"LEFT JOIN best b_{c} ON b_{c}.row_id = x.row_id AND b_{c}.t = '{c}'" for c, _ in _CODED)})
    SELECT f.row_id, {', '.join(f"{c}_k.v AS {c}" for c, _ in _CODED)} FROM full_x f
    {' '.join(f"LEFT JOIN {t} {c}_k ON {c}_k.code = CAST(round_even(f.{c}, 0) AS BIGINT)" for c, t in _CODED)}""",
)
def baseline_correct_knn(spark, sf):
    clean = fx.typo_clean(spark, sf)
    return baseline_correct(fx.typo_dirty(clean), fx.typo_mask(clean), "row_id", strategy="knn")


def _typo_vectors(spark, sf):
    clean = fx.typo_clean(spark, sf)
    return fx.typo_dirty(clean), fx.typo_mask(clean)


@query("repair_candidates")
def repair_candidates_query(spark, sf):
    dirty, mask = _typo_vectors(spark, sf)
    vectors = masked_row_vectors(dirty, mask, "row_id", ["name", "brand", "kind"])
    return repair_candidates(vectors, mask, "row_id", 10)


@query("clean_representatives")
def clean_representatives_query(spark, sf):
    from cellsmith.operators.repair import row_vector

    dirty, mask = _typo_vectors(spark, sf)
    vectors = spread_rows(dirty).select("row_id", row_vector(["name", "brand", "kind"]).alias("vec"))
    return clean_representatives(vectors, mask, "row_id", 10)
