"""Whole runs: training and scoring."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import fixed
from ..operators import features, learn, verdict
from ..operators.store import stored, unsent
from ..sources.tables import TABLE_KEY, labelled_pages, record_id


def labelled_features(records: DataFrame) -> DataFrame:
    """Features of the first table of each labelled record, with its label, stored."""
    judged = verdict.judge(labelled_pages(records)).where("table_idx = 0")
    return stored(features.features(judged).join(
        unsent(records.select(record_id(records).alias("page_id"), "key", "verification")), "page_id"),
        "labelled-features")


def train(records: DataFrame, name: str = "Random Forest", path: str | None = None,
          **settings) -> learn.GatedModel:
    """Fit a model by name on labelled records; save it if a path is given."""
    if name not in learn.MODELS:
        raise ValueError(f"Неизвестная модель: {name}")
    model = learn.fit(name, labelled_features(records), **settings)
    if path:
        model.save(path)
    return model


def score(pages: DataFrame, model: learn.GatedModel) -> DataFrame:
    """Verdict and prediction for every table of every page, in one pass."""
    judged = verdict.judge(pages)
    key = [c for c in judged.columns if c in TABLE_KEY + ["kind"]]
    flagged = features.type_fractions(judged).select(
        *key, "verdict", "message", "orientation", "status", *fixed.FEATURES,
        F.when(verdict.is_genuine(), 1).otherwise(-1).alias("consistency"))
    return model.predict_inline(flagged.na.fill(-1.0, fixed.FEATURES)).drop(*fixed.FEATURES)
