"""Feature matrix: key encoding, projection, scrubbing, scaling, class weights."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import columns, scrub_nonfinite
from ..spec import PHASES, FeatureSpec, PhaseRule, SeriesSpec
from .joins import BROADCAST_ROWS, join_dimension
from .phases import label_phases
from .series import BUCKET, window_features
from .splits import number_rows


def encode_key(df: DataFrame, key: str | Sequence[str], out: str = "country_enc", values: DataFrame | None = None) -> DataFrame:
    """Codes 0..k-1 of the distinct values of a key, in the order of its columns; rows without a key have none.

    A key of several columns gets one code per tuple that occurs. Up to ``BROADCAST_ROWS`` of them are numbered from one
    short list and broadcast; more by a range-partitioned sort and a shuffled join, with the same codes. ``df`` is read
    twice, so cut its lineage first when it is costly to compute.
    """
    keys = [key] if isinstance(key, str) else list(key)
    values = df.select(*keys).na.drop(subset=keys).distinct()
    found = [tuple(r) for r in values.limit(BROADCAST_ROWS + 1).collect()]
    if len(found) <= BROADCAST_ROWS:
        rows = [(*v, k) for k, v in enumerate(sorted(found))]
        codes = df.sparkSession.createDataFrame(rows, T.StructType([*(df.schema[k] for k in keys), T.StructField(out, T.IntegerType())]))
        return join_dimension(df, codes, keys, rows=len(rows))
    codes, total = number_rows(values, keys, "_code")
    return join_dimension(df, codes.select(*keys, (F.col("_code") - 1).cast("int").alias(out)), keys, rows=total)


def drop_incomplete(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.na.drop(subset=list(cols))


def scrub(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Non-finite and missing feature values -> 0.0."""
    return df.withColumns(columns({c: f"coalesce({scrub_nonfinite(f'CAST(`{c}` AS DOUBLE)')}, 0D)" for c in cols}))


def select_features(df: DataFrame, features: FeatureSpec, keep: Sequence[str]) -> DataFrame:
    return df.select(*features.columns(), *keep)


def feature_table(
    weekly: DataFrame, spec: SeriesSpec, features: FeatureSpec, rule: PhaseRule = PhaseRule(), values: DataFrame | None = None
) -> DataFrame:
    """Weekly rows -> phase and past-only features, before incomplete rows are dropped; ``values`` as in ``encode_key``."""
    out = window_features(label_phases(weekly, spec, rule), spec, features)
    return encode_key(out, spec.keys, values=values) if features.encode_key else out


def feature_matrix(
    weekly: DataFrame, spec: SeriesSpec, features: FeatureSpec, rule: PhaseRule = PhaseRule(), values: DataFrame | None = None
) -> DataFrame:
    """Complete, finite feature rows with phase, bucket and key."""
    cols = features.columns()
    table = select_features(feature_table(weekly, spec, features, rule, values), features, ["phase", BUCKET, *spec.keys])
    return scrub(drop_incomplete(table, [*cols, "phase"]), cols)


def distinct_sorted(df: DataFrame, col: str) -> DataFrame:
    return df.select(col).distinct().orderBy(col)


def value_counts(df: DataFrame, col: str) -> DataFrame:
    """Rows per value, most frequent first."""
    return df.groupBy(col).agg(F.count(F.lit(1)).alias("n_rows")).orderBy(F.desc("n_rows"), col)


@dataclass(frozen=True)
class Standardizer:
    """Means and population standard deviations of the training rows."""

    cols: tuple[str, ...]
    means: tuple[float, ...]
    scales: tuple[float, ...]

    def apply(self, df: DataFrame) -> DataFrame:
        fits = zip(self.cols, self.means, self.scales)
        return df.withColumns(columns({c: f"(`{c}` - ({m!r}D)) / {s!r}D" for c, m, s in fits}))


def column_moments(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """One row per column: mean and population standard deviation, in a single pass."""
    stats = df.agg(*[F.struct(F.lit(c).alias("feature"), F.avg(F.col(f"`{c}`")).alias("mean"), F.stddev_pop(F.col(f"`{c}`")).alias("std")).alias(c) for c in cols])
    return stats.select(F.inline(F.array(*[F.col(f"`{c}`") for c in cols])))


def fit_standardizer(train: DataFrame, cols: Sequence[str]) -> Standardizer:
    """Fit on training rows only; a constant column keeps scale 1."""
    # One row per feature column reaches the driver.
    stats = {r["feature"]: (r["mean"], r["std"]) for r in column_moments(train, cols).collect()}
    means = tuple(float(stats[c][0] or 0.0) for c in cols)
    scales = tuple(float(stats[c][1] or 0.0) or 1.0 for c in cols)
    return Standardizer(tuple(cols), means, scales)


def class_weights(train: DataFrame, label: str = "phase") -> DataFrame:
    """n / (k * n_class) for each of the k classes present."""
    counts = train.groupBy(label).agg(F.count(F.lit(1)).alias("n_class"))
    # The window sees one row per class, never the training rows.
    classes = Window.partitionBy()
    n, k = F.sum("n_class").over(classes), F.count(F.lit(1)).over(classes)
    return counts.withColumn("weight", n / (k * F.col("n_class")))


def balanced_weights(train: DataFrame, label: str = "phase", out: str = "weight") -> DataFrame:
    """Attach the class weight to every training row without shuffling by class; the classes are the phases."""
    weights = class_weights(train, label).select(label, F.col("weight").alias(out))
    return join_dimension(train, weights, label, rows=len(PHASES))
