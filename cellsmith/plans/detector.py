"""End-to-end cell detector: cluster the distinct values of each column, label the representatives,

spread the labels, and learn rules or a forest that score every cell.
"""

from __future__ import annotations

from collections.abc import Mapping

from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.ml.classification import RandomForestClassificationModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellsmith.functions.scalars import FEATURES, cell_features, minmax_stats, name, scaled
from cellsmith.operators.cluster import MAX_K, elbow_k, eps_components, hierarchical_clusters, medoids, nearest_to_mean, propagate_labels
from cellsmith.operators.dependency import nmi_pairs, related_columns
from cellsmith.operators.detect import RULE_THRESHOLD, fit_column_forest, kept_rules, score_cells, synthetic_errors
from cellsmith.operators.impute import NotFittedError
from cellsmith.operators.lookup import lookup_join
from cellsmith.operators.profile import distribution_report
from cellsmith.operators.providers import LabelProvider
from cellsmith.session import checkpointed
from cellsmith.sources.tables import load_state, save_state


class CellDetector:
    """``synthetic_errors_per_column``: made-up errors that join the labelled values of a column when its forest is fitted."""

    def __init__(
        self,
        key: str,
        label_provider: LabelProvider,
        rules: Mapping[str, Mapping[str, str]] | None = None,
        cluster: str = "bisecting",
        use_model: bool = True,
        related_top: int = 1,
        with_distribution: bool = True,
        with_errors: bool = True,
        rule_threshold: float = RULE_THRESHOLD,
        eps: float = 0.5,
        max_k: int = MAX_K,
        synthetic_errors_per_column: int = 20,
        parallelism: int = 4,
        seed: int = 42,
    ):
        if cluster not in ("bisecting", "eps"):
            raise ValueError("cluster must be 'bisecting' or 'eps'")
        self.key, self.label_provider, self.rules = key, label_provider, dict(rules or {})
        self.cluster, self.use_model, self.related_top = cluster, use_model, related_top
        self.with_distribution, self.with_errors = with_distribution, with_errors
        self.rule_threshold, self.eps, self.max_k, self.seed = rule_threshold, eps, max_k, seed
        self.parallelism, self.synthetic_errors_per_column = parallelism, synthetic_errors_per_column
        self.models: dict[str, RandomForestClassificationModel] | None = None
        self.kept: dict[str, list[str]] = {}
        self.related: dict[str, list[str]] = {}
        self.distribution: dict[str, DataFrame] = {}

    def _points(self, df: DataFrame, column: str) -> DataFrame:
        """Distinct values with scaled features, multiplicity and the first row that holds them."""
        values = df.groupBy(name(column).cast("string").alias("value")).agg(
            F.count("*").alias("copies"), F.min(name(self.key)).alias("id")
        )
        rows = checkpointed(values.select("id", "value", "copies", *cell_features(F.col("value"))))
        stats = minmax_stats(rows, FEATURES)
        return checkpointed(rows.select("id", "value", "copies", F.array(*[scaled(F.col(f), stats[f]) for f in FEATURES]).alias("vec")))

    def labelled_values(self, df: DataFrame, column: str) -> DataFrame:
        """(id, value, weight, label) of every distinct value whose cluster got a label."""
        points = self._points(df, column)
        if self.cluster == "eps":
            placed = points.join(eps_components(points, "id", self.eps, "vec", "copies"), "id").filter("cluster <> -1")
            placed = checkpointed(placed)
            chosen = nearest_to_mean(placed, "id", "cluster", "vec", "copies")
        else:
            k = elbow_k(points, "vec", "copies", self.max_k, self.seed)
            placed = checkpointed(hierarchical_clusters(points, k, "vec", "copies", self.seed))
            chosen = medoids(placed, "id", "cluster", "vec", "copies")
        chosen = checkpointed(chosen.select("cluster", "representative"))
        rows = df.join(chosen.select(F.col("representative").alias(self.key)), self.key, "left_semi")
        facts = (self._context(column),) if getattr(self.label_provider, "with_context", False) else ()
        labels = self.label_provider(rows, self.key, column, *facts).withColumnRenamed(self.key, "id")
        members = propagate_labels(placed.select("id", "cluster"), chosen, labels, "id")
        return checkpointed(placed.select("id", "value", "copies").join(members, "id").select("id", "value", F.col("copies").alias("weight"), "label"))

    def _context(self, column: str) -> dict[str, object]:
        """What a label provider may know beside the rows: related columns and the column's distribution report."""
        report = self.distribution.get(column)
        rows = [r.asDict() for r in report.collect()] if report is not None else []
        return {"related": self.related.get(column, []), "distribution": rows}

    def fit(self, df: DataFrame) -> CellDetector:
        columns = [c for c in df.columns if c != self.key]
        self.models, self.kept, self.related = {}, {}, {}
        if self.related_top and len(columns) > 1:
            for r in related_columns(nmi_pairs(df, columns), self.related_top).orderBy("col", "rank").collect():
                self.related.setdefault(r["col"], []).append(r["related"])
        self.distribution = {c: distribution_report(df, c) for c in columns} if self.with_distribution else {}
        # Columns are independent; a few at a time keep the cluster busy, as in pyspark.ml.tuning.
        step = inheritable_thread_target(df.sparkSession)(lambda column: self._fit_column(df, column))
        with ThreadPool(max(1, min(self.parallelism, len(columns)))) as pool:
            fitted = dict(zip(columns, pool.map(step, columns)))
        for column, (kept, model) in fitted.items():
            if kept:
                self.kept[column] = kept
            if model is not None:
                self.models[column] = model
        return self

    def _fit_column(self, df: DataFrame, column: str) -> tuple[list[str], RandomForestClassificationModel | None]:
        values = self.labelled_values(df, column)
        kept: dict[str, str] = {}
        if column in self.rules:
            # NULL cells carry the text "nan" here so that they meet their label.
            found = values.groupBy(F.coalesce("value", F.lit("nan")).alias("_value")).agg(
                F.max("label").alias("label"), F.sum("weight").alias("weight")
            )
            keyed = df.withColumn("_value", F.coalesce(name(column).cast("string"), F.lit("nan")))
            labelled = lookup_join(keyed, found, ["_value"], "weight", "inner")
            kept = kept_rules(labelled, self.rules[column], self.rule_threshold)
        model = None
        if self.use_model:
            errors = None
            if self.with_errors:
                made = synthetic_errors(values.filter("label = 0"), "id", "value", self.seed)
                order = F.xxhash64(F.lit(self.seed), "id")
                errors = made.orderBy(order, "id").limit(self.synthetic_errors_per_column).select(F.col("error").alias("value"))
            model = fit_column_forest(values, errors, seed=self.seed)
        return list(kept.values()), model

    def transform(self, df: DataFrame) -> DataFrame:
        """Boolean mask of the same shape."""
        if self.models is None:
            raise NotFittedError("fit first")
        return score_cells(df, self.key, self.models, self.kept, self.use_model)

    def fit_transform(self, df: DataFrame) -> DataFrame:
        return self.fit(df).transform(df)

    def save(self, spark: SparkSession, path: str) -> None:
        if self.models is None:
            raise NotFittedError("fit first")
        order = list(self.models)
        for i, column in enumerate(order):
            self.models[column].write().overwrite().save(f"{path}/model{i}")
        state = {"key": self.key, "models": order, "kept": self.kept, "related": self.related, "use_model": self.use_model}
        save_state(spark, state, f"{path}/state")

    @classmethod
    def load(cls, spark: SparkSession, path: str, label_provider: LabelProvider) -> CellDetector:
        state = load_state(spark, f"{path}/state")
        out = cls(state["key"], label_provider, use_model=state["use_model"])
        out.models = {c: RandomForestClassificationModel.load(f"{path}/model{i}") for i, c in enumerate(state["models"])}
        out.kept, out.related = state["kept"], state["related"]
        return out

