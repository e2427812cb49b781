"""Epidemic phases: the labelling rule, and phases read off a fitted curve."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import columns, days_between
from ..spec import CONTAINED, DECLINING, GROWING, STABLE, PhaseRule, SeriesSpec
from .joins import join_at_offset
from .series import BUCKET, future_mean, past_mean

LOOK_AHEAD_DAYS = 7
PEOPLE_PER_CASE = 100_000


def phase_expression(past: str, future: str, rule: PhaseRule = PhaseRule()) -> str:
    """The ordered rules; a later rule is reached only when the earlier ones fail."""
    return f"""CASE
        WHEN {future} IS NULL OR ({past} < {rule.floor}D AND {future} < {rule.floor}D) THEN '{CONTAINED}'
        WHEN {past} = 0 THEN '{GROWING}'
        WHEN {future} > {past} * {rule.up}D THEN '{GROWING}'
        WHEN {future} < {past} * {rule.down}D THEN '{DECLINING}'
        ELSE '{STABLE}' END"""


def label_phases(
    df: DataFrame, spec: SeriesSpec, rule: PhaseRule = PhaseRule(), col: str = "new_cases", time: str = BUCKET
) -> DataFrame:
    """Add ``phase``. It looks ahead, so it is a target and never a feature."""
    past = past_mean(col, rule.past_rows, spec, time)
    future = future_mean(col, rule.future_rows, spec, time)
    return df.withColumns(columns({"phase": phase_expression(past, future, rule)}))


def phase_guard(has_fit: str, day: str, phase: str) -> str:
    """Contained without a fitted curve or before the series starts, else ``phase``."""
    return f"CASE WHEN NOT ({has_fit}) OR {day} < 0 THEN '{CONTAINED}' ELSE {phase} END"


def curve_phase_expression(now: str, soon: str, population: str, rule: PhaseRule = PhaseRule()) -> str:
    growth = f"{soon} / greatest({now}, 1e-6D)"
    return f"""CASE
        WHEN {now} IS NULL OR {soon} IS NULL THEN NULL
        WHEN {now} < {population} / {PEOPLE_PER_CASE} THEN '{CONTAINED}'
        WHEN {growth} > {rule.up}D THEN '{GROWING}'
        WHEN {growth} < {rule.down}D THEN '{DECLINING}'
        ELSE '{STABLE}' END"""


def phase_from_curve(
    rows: DataFrame,
    curve: DataFrame,
    params: DataFrame,
    keys: Sequence[str],
    time: str,
    value: str = "infectious",
    out: str = "curve_phase",
    rule: PhaseRule = PhaseRule(),
    member: str | None = None,
) -> DataFrame:
    """Add the curve-derived phase to every row, for train and test rows alike, and under ``member`` whether its series is in
    ``params``.

    ``params`` holds (key, t0, population) of the series with a curve; ``curve`` holds
    (key, day, value). Both have at most one row per key, or per key and day. Past
    its last day a curve keeps its last value; a day inside without a value gives
    no phase, a day before ``t0`` is Contained.
    """
    known = params.select(*keys, F.col("t0").alias("_t0"), F.col("population").cast("double").alias("_pop"))
    ends = curve.groupBy(*keys).agg(F.max("day").alias("_end"), F.max_by(value, "day").alias("_last"))
    dated = rows.join(known.join(ends, list(keys), "left"), list(keys), "left").selectExpr(
        "*", f"{days_between(f'`{time}`', '_t0')} AS _seen"
    ).selectExpr("*", "least(_seen, _end) AS _day")
    lines = curve.select(*keys, F.col("day").alias("_day"), F.col(value).alias("_i"))
    both = join_at_offset(dated, lines, keys, "_day", "_i", LOOK_AHEAD_DAYS)
    both = both.withColumn("_i_soon", F.when(F.col("_seen") + LOOK_AHEAD_DAYS > F.col("_end"), F.col("_last")).otherwise(F.col("_i_soon")))
    phase = phase_guard("_pop IS NOT NULL AND _end IS NOT NULL", "_seen", curve_phase_expression("_i_now", "_i_soon", "_pop", rule))
    flag = [F.col("_t0").isNotNull().alias(member)] if member else []
    return both.select(*rows.columns, F.expr(phase).alias(out), *flag)
