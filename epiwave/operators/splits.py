"""Temporal splits and distributed row numbering."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage


# Up to so many values of an order column are counted on the driver to find a split's boundary row.
COUNTED_VALUES = 100_000
# Ranges that more values are first cut into.
RANGES = 200


def split_flag(time: str, cut) -> Column:
    return F.expr(f"CASE WHEN {time} < DATE '{cut}' THEN 'train' ELSE 'test' END")


def split_by_date(df: DataFrame, time: str, cut, embargo_days: int = 0) -> tuple[DataFrame, DataFrame]:
    """(train, test): before the cut, at or after it.

    ``embargo_days`` drops the last training days, whose forward-looking labels
    reach over the cut; 0 keeps them.
    """
    edge = F.lit(cut).cast("date")
    return df.where(F.col(time) < F.date_sub(edge, embargo_days)), df.where(F.col(time) >= edge)


def number_rows(df: DataFrame, order: Sequence[str], position: str = "position") -> tuple[DataFrame, int]:
    """Number all rows 1..n in a global order without a single-task window; also return n.

    The frame is range-partitioned and sorted, and stored with its partition
    number and offset. The driver sees one count per partition; each row adds the
    rows of the partitions before it to its own offset.
    """
    ordered = df.repartitionByRange(*order).sortWithinPartitions(*order)
    tagged = cut_lineage(ordered.withColumn("_id", F.monotonically_increasing_id()))
    part = "CAST(shiftright(_id, 33) AS INT)"
    sizes = {r["part"]: r["count"] for r in tagged.groupBy(F.expr(f"{part} AS part")).count().collect()}
    before = [0, *accumulate(sizes.get(p, 0) for p in range(max(sizes, default=0) + 1))]
    starts = ", ".join(f"{n}L" for n in before)
    numbered = tagged.selectExpr("*", f"element_at(array({starts}), {part} + 1) + (_id & {2**33 - 1}L) + 1 AS {position}")
    return numbered.drop("_id"), before[-1]


def value_at_rank(df: DataFrame, col: str, rank: int) -> tuple[object, int]:
    """The value of ``col`` on the row of this rank (from 1, nulls first), and the rank among the rows with that value.

    The rows are counted per value, with partial counts before the shuffle, so a value with all rows is one count. While
    there are too many values for the driver, Spark's range partitioning cuts them into ranges, whose exact counts tell
    the one that holds the rank; only its values go on.
    """
    counts = cut_lineage(df.groupBy(F.col(col).alias("_value")).agg(F.count(F.lit(1)).alias("_rows")))
    missing = counts.where(F.col("_value").isNull()).first()
    if missing is not None:
        if rank <= missing["_rows"]:
            return None, rank
        rank -= missing["_rows"]
    counts = counts.where(F.col("_value").isNotNull())
    while True:
        if counts.limit(COUNTED_VALUES + 1).count() <= COUNTED_VALUES:
            found = [(r["_value"], r["_rows"]) for r in counts.collect()]
            for value, n in sorted(found, key=lambda r: (r[0] != r[0], r[0])):  # not-a-number comes last, as in Spark
                if rank <= n:
                    return value, rank
                rank -= n
            raise ValueError(f"there is no row of this rank by {col!r}")
        ranges = counts.repartitionByRange(RANGES, "_value").groupBy(F.spark_partition_id().alias("_part")).agg(
            F.min("_value").alias("_low"), F.max("_value").alias("_high"), F.sum("_rows").alias("_rows")
        )
        for r in sorted(ranges.collect(), key=lambda r: r["_part"]):
            if rank <= r["_rows"]:
                counts = counts.where(F.col("_value").between(F.lit(r["_low"]), F.lit(r["_high"])))
                break
            rank -= r["_rows"]


def row_at_rank(df: DataFrame, order: Sequence[str], rank: int) -> dict[str, object] | None:
    """The order columns of the row of this rank (from 1), found column by column; None for rank 0.

    Each column is counted among the rows that agree with the boundary row in the columns before it. Nothing is sorted,
    and no task holds more than the counts of its share of the values.
    """
    if rank < 1:
        return None
    found: dict[str, object] = {}
    inside = df.select(*order)
    for c in order:
        found[c], rank = value_at_rank(inside, c, rank)
        inside = inside.where(F.col(c).eqNullSafe(F.lit(found[c])))
    return found


def _cut_in_order(df: DataFrame, order: Sequence[str], share: float) -> Column:
    """Whether a row is among the first int(share * n) of the table in the given order, as a comparison with one row.

    Rows that tie in all order columns fall on one side together.
    """
    # The order columns are stored, as they are counted once for each of them.
    rows = cut_lineage(df.select(*order))
    edge = row_at_rank(rows, order, int(rows.count() * share))
    if edge is None:
        return F.lit(False)
    before, same = F.lit(False), F.lit(True)
    for c in order:
        v = F.lit(edge[c])
        less = F.col(c).isNull() & v.isNotNull() | F.coalesce(F.col(c) < v, F.lit(False))
        before, same = before | same & less, same & F.col(c).eqNullSafe(v)
    return before | same


def _first_share(df: DataFrame, order: Sequence[str], keys: Sequence[str], share: float) -> tuple[DataFrame, Column]:
    """``df``, perhaps with helper columns, and whether a row is in the first share of its series or of the table."""
    if not keys:
        return df, _cut_in_order(df, order, share)
    w = Window.partitionBy(*keys)
    ranked = df.withColumns({"_pos": F.row_number().over(w.orderBy(*order)), "_n": F.count("*").over(w)})
    return ranked, F.col("_pos") <= F.floor(F.col("_n") * share)


def split_by_fraction(df: DataFrame, order: Sequence[str], keys: Sequence[str] = (), fraction: float = 0.70) -> DataFrame:
    """Add ``split``: the first int(fraction * n) rows train, the rest test.

    With ``keys`` the rule holds inside every series, without them over the whole
    table in the given order.
    """
    rows, first = _first_share(df, order, keys, fraction)
    return rows.select(*df.columns, F.when(first, "train").otherwise("test").alias("split"))


def split_boundary(df: DataFrame, time: str, keys: Sequence[str] = ()) -> DataFrame:
    """First test time, per series or overall."""
    return df.where(F.col("split") == "test").groupBy(*keys).agg(F.min(time).alias("boundary"))


def tail_holdout(train: DataFrame, order: Sequence[str], keys: Sequence[str] = (), holdout: float = 0.15) -> DataFrame:
    """Add ``part``: the last share of the ordered training rows is validation."""
    rows, first = _first_share(train, order, keys, 1 - holdout)
    return rows.select(*train.columns, F.when(first, "fit").otherwise("validation").alias("part"))


def split_sizes(df: DataFrame, flag: Column | None = None) -> DataFrame:
    """Rows per split and, of those, rows that satisfy ``flag``."""
    aggs = [F.count(F.lit(1)).alias("n_rows")]
    if flag is not None:
        aggs.append(F.count_if(flag).alias("n_flagged"))
    return df.groupBy("split").agg(*aggs)
