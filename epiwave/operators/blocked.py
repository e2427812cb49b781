"""Windows over series of any length: blocks of neighbouring rows, halos and carried values.

A window ordered inside a key puts a whole series into one task. Here all rows are numbered in (key, time) order by a
range-partitioned sort and cut into blocks of equal size, whatever the keys are. A frame of fixed reach then needs only
the last and first rows of the neighbouring blocks, which are sent along as a halo; running values need one summary per
key and block, which are scanned in order and carried into the next block. A task holds one block at a time.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import columns, days_between
from ..session import cut_lineage
from ..spec import FeatureSpec, PhaseRule, SeriesSpec
from .phases import label_phases
from .series import BUCKET, increments, window_features
from .splits import number_rows

#: Rows of a block: large enough that halos and summaries are small beside it, small enough to sort in memory.
BLOCK_ROWS = 200_000
POSITION, BLOCK, OWN = "_position", "_block", "_own"


def in_blocks(df: DataFrame, order: Sequence[str], rows: int = BLOCK_ROWS) -> DataFrame:
    """``df`` as a stored table with its row number in ``order`` and its block; ``order`` starts with the keys."""
    numbered, _ = number_rows(df, order, POSITION)
    return numbered.withColumn(BLOCK, F.floor((F.col(POSITION) - 1) / rows).cast("int"))


def with_halo(blocks: DataFrame, before: int, after: int, rows: int = BLOCK_ROWS) -> DataFrame:
    """Every block with the last ``before`` rows of the one in front and the first ``after`` rows of the next.

    Rows of the block itself have ``_own``. Each block goes to a task of its own.
    """
    if max(before, after) > rows:
        raise ValueError("a halo reaches over more than the neighbouring block")
    place = (F.col(POSITION) - 1) % rows
    here = F.col(BLOCK)
    homes = F.array_compact(F.array(here, F.when(place >= rows - before, here + 1), F.when((place < after) & (here > 0), here - 1)))
    sent = blocks.withColumn("_home", F.explode(homes))
    kept = sent.withColumn(OWN, F.col("_home") == F.col(BLOCK)).withColumn(BLOCK, F.col("_home")).drop("_home")
    last = blocks.agg(F.max(BLOCK)).first()[0] or 0
    return kept.where(F.col(BLOCK) <= last).repartitionById(last + 1, F.col(BLOCK))


def blocked(df: DataFrame, spec: SeriesSpec, apply: Callable[[DataFrame, SeriesSpec], DataFrame], before: int, after: int, time: str = BUCKET, rows: int = BLOCK_ROWS) -> DataFrame:
    """``apply(df, spec)`` for window columns that look at most ``before`` rows back and ``after`` ahead in a series.

    ``apply`` gets the blocks with their halos, and a spec whose keys include the block, so every window expression of
    the library works in it unchanged. ``df`` is a table of ``in_blocks`` with the same ``rows``.
    """
    inner = spec.with_(keys=(BLOCK, *spec.keys), time=time)
    out = apply(with_halo(df, before, after, rows), inner)
    return out.where(OWN).drop(OWN)


def _scan(blocks: DataFrame, keys: Sequence[str], summaries: Mapping[str, Column], carry: Mapping[str, str], backward: bool) -> DataFrame:
    """``blocks`` with what the blocks before (behind, for ``backward``) say: ``carry`` over the rows of ``summaries``.

    There is one summary per key and block, so the scan sees a row for thousands of rows of the table.
    """
    per_block = blocks.groupBy(*keys, BLOCK).agg(*[v.alias(k) for k, v in summaries.items()])
    names = ", ".join(f"`{k}`" for k in keys)
    over = f"OVER (PARTITION BY {names} ORDER BY {BLOCK} {'DESC' if backward else 'ASC'} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    carried = per_block.select(*keys, BLOCK, *[F.expr(f"{text} {over}").alias(k) for k, text in carry.items()])
    return blocks.join(carried, [*keys, BLOCK], "left")


def _inside(keys: Sequence[str], backward: bool = False) -> str:
    names = ", ".join(f"`{k}`" for k in (BLOCK, *keys))
    return f"OVER (PARTITION BY {names} ORDER BY {POSITION} {'DESC' if backward else 'ASC'} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"


def running_sums(blocks: DataFrame, keys: Sequence[str], sums: Mapping[str, str]) -> DataFrame:
    """Adds ``{out: column}``: the sum of a whole-number column over the rows of the key up to this one; missing values add nothing."""
    carried = _scan(
        blocks, keys, {f"_in_{o}": F.sum(c) for o, c in sums.items()}, {f"_in_{o}": f"sum(`_in_{o}`)" for o in sums}, backward=False
    )
    totals = {o: f"CAST(coalesce(`_in_{o}`, 0L) + coalesce(sum(`{c}`) {_inside(keys)}, 0L) AS BIGINT)" for o, c in sums.items()}
    return carried.withColumns(columns(totals)).drop(*[f"_in_{o}" for o in sums])


def last_known(blocks: DataFrame, keys: Sequence[str], values: Mapping[str, str], backward: bool = False) -> DataFrame:
    """Adds ``{out: column}``: the last value that is not missing, up to this row (from it on, for ``backward``)."""
    pick = F.min_by if backward else F.max_by
    summaries = {f"_in_{o}": pick(F.col(c), F.when(F.col(c).isNotNull(), F.col(POSITION))) for o, c in values.items()}
    carried = _scan(blocks, keys, summaries, {f"_in_{o}": f"last(`_in_{o}`, true)" for o in values}, backward)
    found = {o: f"coalesce(last(`{c}`, true) {_inside(keys, backward)}, `_in_{o}`)" for o, c in values.items()}
    return carried.withColumns(columns(found)).drop(*[f"_in_{o}" for o in values])


def giant_series_features(
    daily: DataFrame, spec: SeriesSpec, features: FeatureSpec, rule: PhaseRule = PhaseRule(), time: str = BUCKET, rows: int = BLOCK_ROWS
) -> DataFrame:
    """Levels, increments, phase and past-only features of series that no task could hold.

    ``daily`` has one row per (key, time) with a step (``new_cases``, ...) for each counter of ``spec``. Levels are the running
    totals of the steps; increments are taken from the levels again, so clipping and first rows follow ``increments``.
    The columns are those of ``window_features`` and ``label_phases``.
    """
    keys = list(spec.keys)
    steps = dict(zip(spec.cumulative, spec.increments, strict=True))
    order = [*keys, time]
    placed = in_blocks(daily, order, rows)
    levels = cut_lineage(running_sums(placed, keys, steps).drop(*steps.values()))
    inner = levels.select(*order, POSITION, BLOCK, *spec.cumulative)
    # Two passes: features look at increments of rows that themselves look one row back.
    first = cut_lineage(blocked(inner, spec, lambda df, s: increments(df, s), 1, 0, time, rows))
    back = max(*features.lags, features.mean_rows, 2, rule.past_rows - 1)

    def apply(df: DataFrame, s: SeriesSpec) -> DataFrame:
        return window_features(label_phases(df, s, rule, time=time), s, features, time)

    told = blocked(first, spec, apply, back, rule.future_rows, time, rows)
    # The first row of a series may lie blocks before: its time comes from one row per key.
    start = levels.groupBy(*keys).agg(F.min(time).alias("_start"))
    return told.drop(POSITION, BLOCK).join(start, keys).withColumn("days_into_epidemic", F.expr(days_between(f"`{time}`", "_start"))).drop("_start")


def _with_neighbours(queries: DataFrame, samples: DataFrame, keys: Sequence[str], t: str, cols: Sequence[str], rows: int, both_sides: bool) -> DataFrame:
    """``queries`` with ``_before``, the last sample at or before each, and with ``both_sides`` ``_after``, the next later one.

    Queries and samples are sorted together once, so each side is read once and a key with most rows of either side is
    spread over blocks like any other.
    """
    sample = F.struct(F.col(t).alias("t"), *[F.col(c).alias(c) for c in cols])
    known = samples.na.drop(subset=[*keys, t]).select(*keys, t, sample.alias("_sample"), F.lit(0).alias("_kind"))
    asked = queries.withColumns({"_sample": F.lit(None).cast(known.schema["_sample"].dataType), "_kind": F.lit(1)})
    placed = in_blocks(asked.unionByName(known, allowMissingColumns=True), [*keys, t, "_kind"], rows)
    found = last_known(placed, keys, {"_before": "_sample"})
    if both_sides:
        found = last_known(found, keys, {"_after": "_sample"}, backward=True)
    return found.where("_kind = 1").drop("_sample", "_kind", POSITION, BLOCK)


def asof_join(
    queries: DataFrame, samples: DataFrame, keys: Sequence[str], t: str, cols: Sequence[str], rows: int = BLOCK_ROWS
) -> DataFrame:
    """``queries`` with ``cols`` of the last sample of the same key at or before ``t``, missing where there is none.

    ``samples`` has one row per (key, t) and the columns of keys and ``t`` in the types of ``queries``; a missing value of the
    last sample stays missing. Rows of ``queries`` without key or time find nothing.
    """
    met = _with_neighbours(queries, samples, keys, t, cols, rows, both_sides=False)
    usable = F.col(t).isNotNull()
    return met.withColumns({c: F.when(usable, F.col("_before")[c]) for c in cols}).drop("_before")


def interp_long(
    queries: DataFrame, samples: DataFrame, keys: Sequence[str], t: str, y: str, out: str = "y", rows: int = BLOCK_ROWS
) -> DataFrame:
    """What ``interp_join`` gives, for keys with any number of samples or queries: no window runs over a whole key.

    ``t`` is a number and of one type on both sides; samples without a value are left out.
    """
    met = _with_neighbours(queries, samples.where(F.col(y).isNotNull()), keys, t, [y], rows, both_sides=True)
    (t0, y0), (t1, y1) = ((F.col(s)["t"].cast("double"), F.col(s)[y].cast("double")) for s in ("_before", "_after"))
    at = F.col(t).cast("double")
    value = F.when(at.isNull(), None).when(t0.isNull(), y1).when(t1.isNull(), y0).otherwise((y1 - y0) / (t1 - t0) * (at - t0) + y0)
    return met.withColumn(out, value).drop("_before", "_after")
