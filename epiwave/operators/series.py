"""Keyed-series operators: de-duplication, increments, rollup, lags, means.

Scale note. Raw reports are first grouped by (key, time), with partial
aggregation on the map side and a shuffle on both columns, so a key that holds a
large share of all rows is spread over many tasks. What is left is at most one
row per key and calendar step, and only that is ever ordered inside a key. After
the first window the frame is hash-partitioned by key; the rollup by
(key, bucket) and all later windows reuse this partitioning without a shuffle.
``dealt`` bounds the rows of a task where the series are many.

Window expressions are SQL text; ``over`` states the order inside a key.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import bucket_start, case_fatality, clip_lower, clip_range, columns, days_between, fill_zero, ratio
from ..session import cut_lineage
from ..spec import FeatureSpec, SeriesSpec, new_name

BUCKET = "week"
#: Rows that a task gets of a table of many series: what it sorts and groups then takes some 100 MB, however long the table is.
TASK_ROWS = 100_000


def over(spec: SeriesSpec, time: str | None = None, rows: tuple[str, str] | None = None) -> str:
    """OVER clause of a series in time order, with an optional ROWS frame."""
    frame = f" ROWS BETWEEN {rows[0]} AND {rows[1]}" if rows else ""
    keys = ", ".join(f"`{k}`" for k in spec.keys)
    return f"OVER (PARTITION BY {keys} ORDER BY `{time or spec.time}`{frame})"


# ---------------------------------------------------------------- daily level


def dedupe_sum(df: DataFrame, spec: SeriesSpec, cols: Iterable[str] | None = None) -> DataFrame:
    """One row per (key, time): numeric columns of duplicates are summed."""
    cols = cols if cols is not None else (*spec.cumulative, *spec.gauges)
    return df.groupBy(*spec.keys, spec.time).agg(*[F.sum(c).alias(c) for c in cols])


def dealt(df: DataFrame, keys: Sequence[str], rows: int = TASK_ROWS) -> DataFrame:
    """``df`` stored and dealt out by series: no series is split, and a task gets about ``rows`` rows, or one longer series.

    For tables of many series. Otherwise adaptive execution packs series into a task up to its advisory size, and each of the
    sorts and groups that follow holds all of them. Windows and groups by the keys keep this dealing, without a shuffle.
    """
    table = cut_lineage(df)
    return table.repartition(max(1, math.ceil(table.count() / rows)), *keys)


def sort_series(df: DataFrame, spec: SeriesSpec, time: str | None = None) -> DataFrame:
    """Total order by key and time, for final output only."""
    return df.orderBy(*spec.keys, time or spec.time)


def fill_missing(df: DataFrame, spec: SeriesSpec) -> DataFrame:
    """Missing counters and gauges become 0, or the last known value with fill='carry'."""
    if spec.fill == "carry":
        known = over(spec, rows=("UNBOUNDED PRECEDING", "CURRENT ROW"))
        df = df.withColumns(columns({c: f"last(`{c}`, true) {known}" for c in (*spec.cumulative, *spec.gauges)}))
    return df.withColumns(columns({c: fill_zero(f"`{c}`") for c in (*spec.cumulative, *spec.gauges)}))


def partition_start(spec: SeriesSpec, time: str | None = None) -> str:
    """True on the first row of a key."""
    return f"row_number() {over(spec, time)} = 1"


def increments(df: DataFrame, spec: SeriesSpec) -> DataFrame:
    """Level minus previous level inside a key; 0 on the first row."""
    steps = {}
    for c in spec.cumulative:
        step = f"CAST(coalesce(`{c}` - lag(`{c}`) {over(spec)}, 0) AS BIGINT)"
        steps[new_name(c)] = clip_lower(step) if c in spec.clip_negative else step
    return df.withColumns(columns(steps))


def daily_table(df: DataFrame, spec: SeriesSpec) -> DataFrame:
    """Typed reports -> de-duplicated daily rows with increments and, given two counters, the fatality rate.

    Report times are cut to ``spec.grain`` first, so that a series is no longer than its calendar. A counter that no
    long can hold is missing.
    """
    counters = (*spec.cumulative, *spec.gauges)
    # Rows without a key or a readable date belong to no series.
    placed = df.na.drop(subset=[*spec.keys, spec.time])
    if spec.grain:
        placed = placed.withColumn(spec.time, F.date_trunc(spec.grain, spec.time).cast(placed.schema[spec.time].dataType))
    counts = placed.select(*spec.keys, spec.time, *[F.expr(f"try_cast(`{c}` AS BIGINT)").alias(c) for c in counters])
    daily = increments(fill_missing(dedupe_sum(counts, spec), spec), spec)
    two = [f"`{c}`" for c in spec.cumulative[:2]]
    return daily.withColumns(columns({"cfr": case_fatality(*two) if len(two) == 2 else "CAST(NULL AS DOUBLE)"}))


# --------------------------------------------------------------- bucket level


def last_in_bucket(col: str, time: str) -> str:
    """Last non-missing value by time within the group (missing values are skipped)."""
    return f"max_by(`{col}`, `{time}`) FILTER (WHERE `{col}` IS NOT NULL)"


def rollup(df: DataFrame, spec: SeriesSpec, last: Sequence[str] = ("cfr",)) -> DataFrame:
    """Per key and bucket: maximum level, summed increments, last gauge values."""
    aggs = [f"max(`{c}`) AS `{c}`" for c in spec.cumulative]
    aggs += [f"sum(`{c}`) AS `{c}`" for c in spec.increments]
    aggs += [f"{last_in_bucket(c, spec.time)} AS `{c}`" for c in (*last, *spec.gauges)]
    bucket = F.expr(f"{bucket_start(f'`{spec.time}`', spec.bucket)} AS {BUCKET}")
    return df.groupBy(*spec.keys, bucket).agg(*map(F.expr, aggs))


def fill_gaps(df: DataFrame, spec: SeriesSpec) -> DataFrame:
    """Insert the buckets without a report: levels repeat, increments are 0.

    Every row is repeated up to the bucket before its successor, so neither a
    calendar table nor a join is needed.
    """
    days = spec.bucket_days
    ahead = df.selectExpr("*", f"lead({BUCKET}) {over(spec, BUCKET)} AS _next")
    stop = f"coalesce(date_sub(_next, {days}), {BUCKET})"
    grown = ahead.selectExpr("*", f"explode(sequence({BUCKET}, {stop}, interval {days} days)) AS _bucket")
    steps = {c: f"CASE WHEN _bucket = {BUCKET} THEN {c} ELSE 0L END" for c in spec.increments}
    return grown.withColumns(columns({**steps, BUCKET: "_bucket"})).drop("_bucket", "_next")


def weekly_table(df: DataFrame, spec: SeriesSpec) -> DataFrame:
    """Typed reports -> one row per key and bucket."""
    table = rollup(daily_table(df, spec), spec)
    return fill_gaps(table, spec) if spec.gaps == "fill" else table


def series_extent(df: DataFrame, spec: SeriesSpec, time: str = BUCKET, level: str = "cum_cases") -> DataFrame:
    """First and last time, largest level and length of every series."""
    return df.groupBy(*spec.keys).agg(
        F.min(time).alias("first_time"),
        F.max(time).alias("last_time"),
        F.max(level).alias("max_level"),
        F.count("*").alias("n_rows"),
    )


def initial_value(df: DataFrame, spec: SeriesSpec, time: str = BUCKET, level: str = "cum_cases") -> DataFrame:
    """First level of every series and the compartment seeds derived from it."""
    first = df.groupBy(*spec.keys).agg(
        F.min(time).alias("t0"),
        F.expr(f"CAST(min_by({level}, {time}) AS DOUBLE) AS y0"),
        F.expr(f"{days_between(f'max({time})', f'min({time})')} AS t_max"),
    )
    return first.selectExpr("*", "greatest(y0 * 2D, 1D) AS e0", "greatest(y0, 1D) AS i0")


# ------------------------------------------------------------ ordered columns


def lags(cols: Iterable[str], steps: Iterable[int], spec: SeriesSpec, time: str = BUCKET) -> dict[str, str]:
    steps = list(steps)
    return {f"{c}_lag{k}": f"lag({c}, {k}) {over(spec, time)}" for c in cols for k in steps}


def level_lags(cols: Iterable[str], spec: SeriesSpec, time: str = BUCKET) -> dict[str, str]:
    return lags(cols, (1,), spec, time)


def trailing_mean(col: str, rows: int, spec: SeriesSpec, time: str = BUCKET) -> str:
    """Mean of the ``rows`` rows before the current one; partial windows count."""
    return f"avg({col}) {over(spec, time, (f'{rows} PRECEDING', '1 PRECEDING'))}"


def past_mean(col: str, rows: int, spec: SeriesSpec, time: str = BUCKET) -> str:
    """Mean of the current row and the ``rows - 1`` before it."""
    return f"avg({col}) {over(spec, time, (f'{rows - 1} PRECEDING', 'CURRENT ROW'))}"


def future_mean(col: str, rows: int, spec: SeriesSpec, time: str = BUCKET) -> str:
    """Mean of the next ``rows`` rows; NULL on the last row of a key."""
    return f"avg({col}) {over(spec, time, ('1 FOLLOWING', f'{rows} FOLLOWING'))}"


def growth_rate(new: str, level: str, limit: float, spec: SeriesSpec, time: str = BUCKET) -> str:
    """Previous increment over the level two rows back, clamped; NULL when that level is 0."""
    w = over(spec, time)
    return clip_range(ratio(f"lag({new}, 1) {w}", f"lag({level}, 2) {w}"), f"-{limit}D", f"{limit}D")


def elapsed_days(spec: SeriesSpec, time: str = BUCKET) -> str:
    """Days since the first row of the key, on the same ordered window as the lags."""
    first = f"first({time}) {over(spec, time, ('UNBOUNDED PRECEDING', 'CURRENT ROW'))}"
    return days_between(time, first)


def window_features(df: DataFrame, spec: SeriesSpec, features: FeatureSpec, time: str = BUCKET) -> DataFrame:
    """All past-only features in one projection, hence one sort and one window operator."""
    cases, deaths = spec.increments[:2]
    cum_cases, cum_deaths = spec.cumulative[:2]
    rows, limit = features.mean_rows, features.growth_limit
    return df.withColumns(columns({
        "days_into_epidemic": elapsed_days(spec, time),
        **lags((cases, deaths), features.lags, spec, time),
        f"cases_{rows}w_avg": trailing_mean(cases, rows, spec, time),
        f"deaths_{rows}w_avg": trailing_mean(deaths, rows, spec, time),
        "case_growth_rate": growth_rate(cases, cum_cases, limit, spec, time),
        "death_growth_rate": growth_rate(deaths, cum_deaths, limit, spec, time),
        **level_lags(features.level_lags, spec, time),
    }))
