"""Tables around epidemic curves: observed curves, their fit to reports, reproduction numbers.

A curve is a table of (key, day, value), day 0 being the start of its series. Curves fitted elsewhere are read in as
such tables; ``observed_curve`` makes one of daily counts.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import days_between, ratio
from ..spec import SeriesSpec
from .series import BUCKET


def observed_curve(counts: DataFrame, spans: DataFrame, keys: Sequence[str], time: str, value: str, out: str = "infectious") -> DataFrame:
    """(key, day, ``out``): the daily counts from t0 to t_end of each span (key, t0, t_end), 0 on silent days.

    ``counts`` has one row per key and day. A curve is as long as its calendar.
    """
    days = F.explode(F.sequence("t0", "t_end", F.expr("interval 1 day")))
    dated = spans.where("t0 <= t_end").select(*keys, "t0", days.alias(time))
    seen = counts.select(*keys, F.col(time).cast("date").alias(time), F.col(value).cast("double").alias(out))
    full = dated.join(seen, [*keys, time], "left")
    return full.select(*keys, F.expr(days_between(f"`{time}`", "t0")).alias("day"), F.coalesce(out, F.lit(0.0)).alias(out))


def cumulative_curve(curve: DataFrame, keys: Sequence[str], value: str = "infectious", out: str = "modelled") -> DataFrame:
    """(key, day, ``out``): the running total of a curve."""
    w = Window.partitionBy(*keys).orderBy("day").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return curve.select(*keys, "day", F.sum(value).over(w).alias(out))


def fit_vs_observed(weekly: DataFrame, starts: DataFrame, curve: DataFrame, spec: SeriesSpec, level: str = "cum_cases", value: str = "modelled") -> DataFrame:
    """Observed level and the curve's value on every observation day that the curve has."""
    dated = weekly.join(starts.select(*spec.keys, "t0"), list(spec.keys)).withColumn("day", F.expr(days_between(BUCKET, "t0")))
    return dated.join(curve, [*spec.keys, "day"]).select(
        *spec.keys, "day", F.col(level).cast("double").alias("observed"), F.col(value).alias("modelled")
    )


def sum_squared_error(pairs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Sum of (modelled - observed)^2 per series or per (series, candidate)."""
    gap = F.col("modelled") - F.col("observed")
    return pairs.groupBy(*keys).agg(F.sum(gap * gap).alias("sse"))


def candidate_errors(
    observed: DataFrame, candidates: DataFrame, keys: Sequence[str], candidate: str = "candidate", day: str = "day", level: str = "observed", value: str = "modelled"
) -> DataFrame:
    """(key, candidate, n_days, sse): each candidate curve of a series against its observations.

    ``observed`` has (key, day, level), ``candidates`` (key, candidate, day, value), each row once. They meet on (key, day), so
    a series with many observations or candidates is spread by its days, and errors are summed before they are
    shuffled by candidate. Days that one side lacks, or on which a value is missing, say nothing.
    """
    lines = candidates.select(*keys, F.col(candidate).alias("candidate"), F.col(day).alias("_day"), F.col(value).cast("double").alias("modelled"))
    seen = observed.select(*keys, F.col(day).alias("_day"), F.col(level).cast("double").alias("observed"))
    pairs = lines.join(seen, [*keys, "_day"]).where("modelled IS NOT NULL AND observed IS NOT NULL")
    gap = F.col("modelled") - F.col("observed")
    return pairs.groupBy(*keys, "candidate").agg(F.count(F.lit(1)).alias("n_days"), F.sum(gap * gap).alias("sse"))


def best_candidate(errors: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(key, candidate, n_days, sse, n_candidates): the curve with the least error of each series.

    Candidates that met fewer observations than another one of their series are not comparable and lose. Equal errors
    go to the first name.
    """
    rank = F.struct((-F.col("n_days")).alias("missed"), F.col("sse").alias("error"), F.col("candidate").alias("name"))
    best = errors.groupBy(*keys).agg(F.min_by(F.struct("candidate", "n_days", "sse"), rank).alias("_b"), F.count(F.lit(1)).alias("n_candidates"))
    return best.select(*keys, "_b.*", "n_candidates")


def reproduction_number(fits: DataFrame, keys: Sequence[str]) -> DataFrame:
    """R0 as beta over the other rate of a fit."""
    return fits.selectExpr(*keys, "beta", "rate AS gamma", f"{ratio('beta', 'rate')} AS r0")
