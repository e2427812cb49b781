"""End-to-end studies: reports -> weekly phases -> features -> models -> comparison.

The weekly table is the one place where the raw reports are read. It is frozen
once, because the features and the reports all start from it. Curves come as tables.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.evaluate import compare_models, melt_predictions, union_metrics, with_subset
from ..operators.features import distinct_sorted, feature_matrix
from ..operators.models import TRAINERS, PhaseModel
from ..operators.phases import label_phases, phase_from_curve
from ..operators.report import timeline
from ..operators.series import BUCKET, weekly_table
from ..operators.splits import split_by_fraction, split_flag
from ..session import cut_lineage, persisted
from ..spec import (
    MULTI_COUNTRY,
    MULTI_COUNTRY_FEATURES,
    SINGLE_COUNTRY,
    SINGLE_COUNTRY_FEATURES,
    SUBSET_SUFFIX,
    FeatureSpec,
    ModelSettings,
    SeriesSpec,
)

PRED_COLUMNS = {
    "SEIR": "curve_phase",
    "Random Forest": "rf_phase",
    "Gradient Boosting": "gb_phase",
    "Logistic Regression": "lr_phase",
    "MLP": "mlp_phase",
}


@dataclass(frozen=True)
class Study:
    """Everything one data set yields; all frames are lazy or frozen."""

    dataset: str
    spec: SeriesSpec
    features: FeatureSpec
    weekly: DataFrame
    matrix: DataFrame
    params: DataFrame
    models: dict[str, PhaseModel]
    timeline: DataFrame
    predictions: DataFrame


def phase_labels(matrix: DataFrame) -> list[str]:
    """The phases that occur; the rule yields at most four."""
    return [r["phase"] for r in distinct_sorted(matrix, "phase").collect()]


def train_all(train: DataFrame, cols: Sequence[str], labels: Sequence[str], settings: ModelSettings, models: Sequence[str], order: Sequence[str]) -> dict[str, PhaseModel]:
    """All models on the same rows; the perceptron holds out the tail in (key, time) order."""
    with persisted(train) as kept:
        return {name: TRAINERS[name](kept, cols, labels, settings, **({"order": order} if name == "MLP" else {})) for name in models}


def _study(
    dataset: str,
    weekly: DataFrame,
    matrix: DataFrame,
    params: DataFrame,
    curves: DataFrame,
    spec: SeriesSpec,
    features: FeatureSpec,
    settings: ModelSettings,
    models: Sequence[str],
    fitted: dict[str, PhaseModel] | None = None,
) -> Study:
    cols = features.columns()
    train = matrix.where(F.col("split") == "train")
    fitted = fitted or train_all(train, cols, phase_labels(matrix), settings, models, [*spec.keys, BUCKET])
    wide = phase_from_curve(matrix, curves, params, spec.keys, BUCKET)
    for name, model in fitted.items():
        wide = model.predict(wide).withColumnRenamed("pred", PRED_COLUMNS[name])
    used = {m: c for m, c in PRED_COLUMNS.items() if m == "SEIR" or m in fitted}
    # Every model is applied once; the timeline and the scores both read this table.
    wide = cut_lineage(wide.select(*spec.keys, BUCKET, "split", "phase", *used.values()))
    line = timeline(wide, weekly, spec, phases=["phase", *used.values()])
    test = wide.where(F.col("split") == "test")
    preds = melt_predictions(test, dataset, used, [*spec.keys, BUCKET, "split"])
    return Study(dataset, spec, features, weekly, matrix, params, fitted, line, preds)


def multi_country_study(
    reports: DataFrame,
    params: DataFrame,
    curves: DataFrame,
    cut,
    dataset: str = "A (Multi-country)",
    spec: SeriesSpec = MULTI_COUNTRY,
    features: FeatureSpec = MULTI_COUNTRY_FEATURES,
    settings: ModelSettings = ModelSettings(),
    models: Sequence[str] = tuple(TRAINERS),
    fitted: dict[str, PhaseModel] | None = None,
) -> Study:
    """Many series, split at a date. ``params`` (key, t0, population) and ``curves`` (key, day, infectious) cover some of them.

    ``fitted`` are models trained before on the same matrix.
    """
    weekly = cut_lineage(weekly_table(reports, spec))
    matrix = cut_lineage(feature_matrix(weekly, spec, features).withColumn("split", split_flag(BUCKET, cut)))
    study = _study(dataset, weekly, matrix, params, curves, spec, features, settings, models, fitted)
    known = params.select(*spec.keys, F.lit(True).alias("_fitted"))
    marked = study.predictions.join(known, list(spec.keys), "left")
    preds = with_subset(marked, F.coalesce(F.col("_fitted"), F.lit(False)), "SEIR", SUBSET_SUFFIX).drop("_fitted")
    return replace(study, predictions=preds)


def single_country_study(
    reports: DataFrame,
    params: DataFrame,
    curves: DataFrame,
    dataset: str = "B (Sierra Leone)",
    spec: SeriesSpec = SINGLE_COUNTRY,
    features: FeatureSpec = SINGLE_COUNTRY_FEATURES,
    settings: ModelSettings = ModelSettings(),
    models: Sequence[str] = tuple(TRAINERS),
    fraction: float = 0.70,
    fitted: dict[str, PhaseModel] | None = None,
) -> Study:
    """Detailed series, split by position."""
    weekly = cut_lineage(weekly_table(reports, spec))
    full = feature_matrix(weekly, spec, features)
    matrix = cut_lineage(split_by_fraction(full, [BUCKET], spec.keys, fraction))
    return _study(dataset, weekly, matrix, params, curves, spec, features, settings, models, fitted)


def compare_studies(*studies: Study) -> DataFrame:
    """The metric table of all data sets and models."""
    keep = ["dataset", "model", "subset", "truth", "pred"]
    return compare_models(union_metrics([s.predictions.select(*keep) for s in studies]))


def phase_distribution(weekly: DataFrame, spec: SeriesSpec) -> DataFrame:
    """Weeks per epidemic phase."""
    return label_phases(weekly, spec).groupBy("phase").agg(F.count(F.lit(1)).alias("n_weeks"))
