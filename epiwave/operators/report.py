"""Tables behind the figures: timelines, phase spans, metric bars, best against baseline."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import next_week
from ..spec import MODEL_ORDER, PHASE_ORDER, SeriesSpec
from .joins import join_dimension
from .series import BUCKET, over
from .splits import split_flag


def phase_dimension(spark, order: Sequence[str] = PHASE_ORDER) -> DataFrame:
    return spark.createDataFrame(list(zip(order, range(len(order)))), "phase string, code int")


def series_peak(spec: SeriesSpec, level: str = "new_cases") -> str:
    """Largest level of the series, on the ordered window of the other series columns."""
    return f"max({level}) {over(spec, BUCKET, ('UNBOUNDED PRECEDING', 'UNBOUNDED FOLLOWING'))}"


def scaled_code(df: DataFrame, spec: SeriesSpec, cols: Sequence[str], peak: str | None = None) -> DataFrame:
    """Per phase column, its code times a quarter of the peak of the series.

    ``peak`` is SQL text; by default the peak over the rows of ``df``.
    """
    out = df.selectExpr("*", f"{peak or series_peak(spec)} AS _top")
    codes = phase_dimension(df.sparkSession)
    for c in cols:
        dim = codes.selectExpr(f"phase AS {c}", "code AS _code")
        out = join_dimension(out, dim, c, rows=len(PHASE_ORDER))
        out = out.selectExpr("*", f"_code * _top / 4D AS {c}_scaled").drop("_code")
    return out.drop("_top")


def timeline(
    rows: DataFrame,
    weekly: DataFrame,
    spec: SeriesSpec,
    cut=None,
    phases: Sequence[str] = ("phase", "curve_phase", "rf_phase"),
) -> DataFrame:
    """Key, bucket, new cases, true and predicted phases, split and the scaled codes.

    Counts and peaks come from the whole weekly table, of which ``rows`` may cover
    a part. ``rows`` either has a ``split`` column or is split at ``cut``.
    """
    rows = rows.withColumn("split", split_flag(BUCKET, cut)) if cut is not None else rows
    counts = weekly.selectExpr(*spec.keys, BUCKET, "new_cases", f"{series_peak(spec)} AS _peak")
    dated = rows.select(*spec.keys, BUCKET, *phases, "split").join(counts, [*spec.keys, BUCKET])
    coded = scaled_code(dated, spec, phases, "_peak")
    return coded.select(*spec.keys, BUCKET, "new_cases", *phases, "split", *[f"{c}_scaled" for c in phases])


def phase_spans(weekly: DataFrame, spec: SeriesSpec) -> DataFrame:
    return weekly.selectExpr(*spec.keys, f"{BUCKET} AS span_start", f"{next_week(BUCKET)} AS span_end", "phase")


def metric_bars(metrics: DataFrame, order: Sequence[str] = MODEL_ORDER) -> DataFrame:
    """Accuracy and weighted F1 of the listed models with their display position."""
    dim = metrics.sparkSession.createDataFrame(list(zip(order, range(1, len(order) + 1))), "model string, position int")
    return metrics.join(F.broadcast(dim), "model").select("dataset", "position", "model", "accuracy", "weighted_f1")


def best_vs_baseline(
    metrics: DataFrame,
    baseline: Mapping[str, str],
    ml: Sequence[str] = ("Random Forest", "Gradient Boosting"),
    dl: Sequence[str] = ("MLP",),
    score: str = "weighted_f1",
) -> DataFrame:
    """Per dataset: score of its baseline row, best of ``ml`` and best of ``dl``."""
    is_base = F.lit(False)
    for dataset, model in baseline.items():
        is_base = is_base | ((F.col("dataset") == dataset) & (F.col("model") == model))

    def top(flag):
        return F.max(F.when(flag, F.col(score)))

    return metrics.groupBy("dataset").agg(
        top(is_base).alias("baseline"),
        top(F.col("model").isin(*ml)).alias("best_ml"),
        top(F.col("model").isin(*dl)).alias("best_dl"),
    )


def feature_labels(df: DataFrame, names: Mapping[str, str], on: str = "feature") -> DataFrame:
    """Attach the display label of each feature."""
    dim = df.sparkSession.createDataFrame(list(names.items()), [on, "feature_label"])
    return join_dimension(df, dim, on, rows=len(names))
