"""Connected components of a table of links, by alternating stars; no table of links or nodes leaves the executors."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from epiwave.llm.common import stored


#: Links that a task joins on its own at first.
TASK_LINKS = 250_000


def local_forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The links of one partition as stars around the smallest node of each local component."""
    top: dict[int, int] = {}

    def root(x: int) -> int:
        path = []
        while (up := top.setdefault(x, x)) != x:
            path.append(x)
            x = up
        for y in path:
            top[y] = x
        return x

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a, b = root(a), root(b)
            if a != b:
                top[max(a, b)] = min(a, b)
    pairs = [(x, root(x)) for x in list(top)]
    pairs = [p for p in pairs if p[0] != p[1]]
    for k in range(0, len(pairs), 50_000):
        a, b = zip(*pairs[k : k + 50_000], strict=True)
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["u", "v"])


def star(links: DataFrame) -> DataFrame:
    """One round: neighbours that are larger (then smaller) go to the smallest neighbour of their node."""
    both = links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
    down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    smallest = down.groupBy("u").agg(F.min("v").alias("m"))
    small = down.join(smallest, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return small.union(smallest.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, component (smallest node reachable) of all nodes that have a link to another node.

    Nodes are whole numbers. Links with a null end and of a node to itself say nothing; repeated links count once.
    """
    pairs = links.select(F.col(a).cast("long").alias("u"), F.col(b).cast("long").alias("v")).filter("u IS NOT NULL AND v IS NOT NULL AND u <> v")
    # Each task joins what it holds on its own; links that fit into one task need no more than that.
    kept = stored(pairs)
    tasks = -(-kept.count() // TASK_LINKS)
    forest = (kept.coalesce(1) if tasks <= 1 else kept.repartition(tasks)).mapInArrow(local_forest, "u long, v long")
    now, said = stored(forest if tasks <= 1 else forest.distinct()), None
    if tasks <= 1:
        return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(now.select("v", "v").distinct())
    while True:
        n, mark = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if not n or (n, mark) == said:
            return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(now.select("v", "v").distinct())
        said = n, mark
        now = stored(star(now))
