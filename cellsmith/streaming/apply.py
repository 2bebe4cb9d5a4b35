"""Fitted, row-wise steps work on a stream unchanged: kept rules and fitted imputers need no state."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame

from cellsmith.operators.detect import rule_mask


def mask_stream(stream: DataFrame, key: str, rules: Mapping[str, Sequence[str]]) -> DataFrame:
    """Cell mask of every arriving row from the kept rules of a fitted detector."""
    return rule_mask(stream, key, rules)


def impute_stream(stream: DataFrame, imputer) -> DataFrame:
    """Fill arriving rows with a fitted imputer (chained ridge or adversarial)."""
    return imputer.transform(stream)
