"""Joins of series with lookup tables and sampled curves."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..spec import SeriesSpec

# A lookup table is broadcast only up to this many rows; beyond it the join shuffles.
BROADCAST_ROWS = 100_000


def join_increments(levels: DataFrame, steps: DataFrame, spec: SeriesSpec) -> DataFrame:
    """Inner join of two tables on (key, time); increments() needs no such join."""
    return levels.join(steps, [*spec.keys, spec.time], "inner")


def join_dimension(
    df: DataFrame,
    dim: DataFrame,
    on: Sequence[str] | str,
    defaults: Mapping[str, object] | None = None,
    rows: int | None = None,
) -> DataFrame:
    """Left lookup; columns of ``dim`` named in ``defaults`` replace a miss.

    ``rows`` is an upper bound of the lookup table known to the caller. Without
    it no hint is given and the join strategy is chosen from measured sizes.
    """
    if rows is not None and rows <= BROADCAST_ROWS:
        dim = F.broadcast(dim)
    out = df.join(dim, [on] if isinstance(on, str) else list(on), "left")
    return out.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in (defaults or {}).items()})


def value_at_offset(col: str, keys: Sequence[str], day: str, offset: int) -> Column:
    """Value of the same series exactly ``offset`` days later; NULL when not sampled."""
    w = Window.partitionBy(*keys).orderBy(day).rangeBetween(offset, offset)
    return F.max(col).over(w)


def join_at_offset(
    queries: DataFrame, curve: DataFrame, keys: Sequence[str], day: str, value: str, offset: int
) -> DataFrame:
    """Attach ``value`` at the query day and ``offset`` days later in one equi-join."""
    both = curve.select(
        *keys,
        day,
        F.col(value).alias(f"{value}_now"),
        value_at_offset(value, keys, day, offset).alias(f"{value}_soon"),
    )
    return queries.join(both, [*keys, day], "left")


def interp_join(queries: DataFrame, samples: DataFrame, keys: Sequence[str], t: str, y: str, out: str = "y") -> DataFrame:
    """Linear interpolation of a sampled curve at the query points, clamped at both ends.

    ``samples`` hold one row per (key, t). Each pair of neighbouring samples is a
    segment, laid over the time cells it touches; a query meets only the segments
    of its own cell. A cell is as wide as the mean spacing of the key's samples, so
    all segments together touch at most two cells per sample, whatever the unit of
    time and however long a gap. The join is an equi-join on (key, cell), which the
    adaptive planner can split when one key receives most queries, and no window
    runs over the queries, which are read once. For a key with more samples than a
    task holds there is ``blocked.interp_long``.
    """
    w = Window.partitionBy(*keys).orderBy(t)
    whole = Window.partitionBy(*keys).orderBy(t).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    seg = samples.select(
        *keys,
        F.col(t).cast("double").alias("_t0"),
        F.col(y).cast("double").alias("_y0"),
        F.lead(F.col(t).cast("double")).over(w).alias("_t1"),
        F.lead(F.col(y).cast("double")).over(w).alias("_y1"),
        F.first(F.col(t).cast("double")).over(whole).alias("_ta"),
        F.first(F.col(y).cast("double")).over(whole).alias("_ya"),
        F.last(F.col(t).cast("double")).over(whole).alias("_tb"),
        F.last(F.col(y).cast("double")).over(whole).alias("_yb"),
        F.count("*").over(whole).alias("_n"),
    ).withColumn("_width", (F.col("_tb") - F.col("_ta")) / (F.col("_n") - 1))

    def cell_of(c: Column) -> Column:
        return F.floor((c - F.col("_ta")) / F.col("_width"))

    inner = seg.where(F.col("_t1").isNotNull()).select(
        *keys, "_t0", "_y0", "_t1", "_y1",
        F.explode(F.sequence(cell_of(F.col("_t0")), cell_of(F.col("_t1")))).alias("_cell"),
    )
    ends = seg.where(F.col("_t1").isNull()).select(*keys, "_ta", "_ya", "_tb", "_yb", F.when(F.col("_n") > 1, F.col("_width")).alias("_width"))
    q = queries.join(ends, list(keys), "left").withColumn("_q", F.col(t).cast("double"))
    between = F.coalesce((F.col("_q") > F.col("_ta")) & (F.col("_q") < F.col("_tb")), F.lit(False))
    beyond = F.when(F.col("_q") <= F.col("_ta"), F.col("_ya")).when(F.col("_q") >= F.col("_tb"), F.col("_yb"))
    # Points beyond an end have cells of their own below 0, many of them, so that they meet no segment and spread.
    aside = -1 - F.pmod(F.xxhash64("_q"), F.lit(4096))
    left = q.withColumns({"_cell": F.when(between, cell_of(F.col("_q"))).otherwise(aside), "_beyond": F.when(~between, beyond)})
    left, right = left.alias("l"), inner.alias("r")
    match = F.col("l._cell") == F.col("r._cell")
    for k in keys:
        match = match & (F.col(f"l.{k}") == F.col(f"r.{k}"))
    match = match & (F.col("l._q") >= F.col("r._t0")) & (F.col("l._q") < F.col("r._t1"))
    slope = (F.col("r._y1") - F.col("r._y0")) / (F.col("r._t1") - F.col("r._t0"))
    value = slope * (F.col("l._q") - F.col("r._t0")) + F.col("r._y0")
    met = left.join(right, match, "left")
    return met.select(*[F.col(f"l.{c}") for c in queries.columns], F.coalesce(F.col("l._beyond"), value).alias(out))


def attach_predictions(rows: DataFrame, predictions: DataFrame, on: Sequence[str]) -> DataFrame:
    """Join separately computed predictions to keyed rows; transform() output needs no join."""
    return rows.join(predictions, list(on), "left")


def zip_importance(df: DataFrame, vector: str, names: Sequence[str], value: str = "importance") -> DataFrame:
    """One row per entry of an array column, paired with the feature name of its position."""
    others = [c for c in df.columns if c != vector]
    long = df.select(*others, F.posexplode(vector).alias("position", value))
    label = F.element_at(F.array(*map(F.lit, names)), F.col("position") + 1)
    return long.withColumn("feature", label)
