"""Side-by-side runs: several methods on one table, one metric table out."""

from __future__ import annotations

from collections.abc import Mapping
from typing import Protocol

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellsmith.operators.cells import row_any
from cellsmith.operators.detect import contamination, cut_by_share, isolation_scores, lof_scores
from cellsmith.operators.evaluate import compare_methods, correction_prf, error_drop_rate, masked_rmse_mae, row_prf
from cellsmith.operators.fill import baseline_correct
from cellsmith.session import checkpointed, spread_rows
from cellsmith.sources.tables import detection_inputs


class Filler(Protocol):
    def fit_transform(self, df: DataFrame) -> DataFrame: ...


def compare_imputers(truth: DataFrame, gaps: DataFrame, mask: DataFrame, key: str, imputers: Mapping[str, Filler], beside: tuple[str, str] | None = None) -> DataFrame:
    """RMSE and MAE of each imputer on the missing cells, 4 decimals.

    ``beside``: struct columns of ``gaps`` that hold truth and mask of the same row; the scores then need no join.
    """
    scores = {}
    for method, imputer in imputers.items():
        known, flags = beside or (truth, mask)
        score = masked_rmse_mae(known, imputer.fit_transform(gaps), flags, key)
        scores[method] = score.select(F.round("rmse", 4).alias("rmse"), F.round("mae", 4).alias("mae"))
    return compare_methods(scores, ["rmse", "mae"])


def compare_detectors(dirty: DataFrame, mask: DataFrame, key: str, predicted: Mapping[str, DataFrame]) -> DataFrame:
    """Row-level precision, recall, F1 of isolation forest, local outlier factor and given cell masks."""
    _, coded, truth = detection_inputs(dirty, mask, key)
    columns = [c for c in coded.columns if c != key]
    share = contamination(truth)
    # A few files would leave all votes of the trees and all links to as few tasks; rows are coded once for both.
    coded = checkpointed(spread_rows(coded))
    vectors = coded.select(key, F.array(*[F.col(f"`{c}`").cast("double") for c in columns]).alias("vec"))
    scores = {
        "isolation_forest": row_prf(truth, cut_by_share(isolation_scores(coded, key, columns), key, share), key),
        "lof": row_prf(truth, cut_by_share(lof_scores(vectors, key, len(columns)), key, share), key),
    }
    scores.update({m: row_prf(truth, row_any(p, key), key) for m, p in predicted.items()})
    return compare_methods(scores, ["precision", "recall", "f1"])


def compare_correctors(clean: DataFrame, dirty: DataFrame, mask: DataFrame, key: str, corrected: Mapping[str, DataFrame], baselines: bool = True) -> DataFrame:
    """Precision, recall, F1 and error drop rate of the baselines and given corrections."""
    tables = dict(corrected)
    if baselines:
        tables = {"mode": baseline_correct(dirty, mask, key), "knn": baseline_correct(dirty, mask, key, "knn"), **tables}
    rated = {m: correction_prf(clean, dirty, t, mask, key) for m, t in tables.items()}
    dropped = {m: error_drop_rate(dirty, t, clean, key) for m, t in tables.items()}
    return compare_methods(rated, ["precision", "recall", "f1"]).unionByName(compare_methods(dropped, ["edr"]))
