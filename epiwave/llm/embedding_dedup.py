"""Near-duplicate embeddings by an epsilon grid order join.

Unit vectors are sorted by label and by the grid cells of their leading principal dimensions, cells as wide as the
largest distance of a link. The sequence is cut into blocks; two blocks meet only if the boxes around them, in the
leading dimensions, come within that distance. In a task the two intervals are joined recursively by halves, skipping
halves whose boxes are too far apart; small ones are compared by one product of matrices in double precision.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from epiwave import session
from epiwave.llm.common import arrow_rows
from epiwave.llm.components import components


@dataclass(frozen=True)
class GridJoin:
    """cosine: least similarity of a link. dims: leading principal dimensions. block: vectors of a block. leaf: of an
    interval that isn't halved any more. tile: blocks of either side that one group of pairs loads once."""

    cosine: float = 0.93
    dims: int = 8
    block: int = 1024
    leaf: int = 256
    tile: int = 8

    @property
    def reach(self) -> float:
        """The largest distance of linked unit vectors; a little more, so that rounding loses none."""
        return math.sqrt(max(0.0, 2 - 2 * self.cosine)) + 1e-9


def usable(vector: Column) -> Column:
    """Whether a vector has a direction: not null, no null or non-finite component, not all zero."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & ~F.coalesce(bad, F.lit(True)) & F.exists(vector, lambda x: x != 0)


def unit(rows: np.ndarray) -> np.ndarray:
    """Rows of length 1; scaled first, so that squares neither overflow nor vanish."""
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.sqrt((rows * rows).sum(axis=1, keepdims=True))


def by_size(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places and unit vectors, for each number of components."""
    sizes = np.array([len(x) for x in column])
    for d in np.unique(sizes):
        at = np.flatnonzero(sizes == d)
        yield at, unit(column.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(at), d))


def principal_axes(classes: DataFrame, dims: int) -> dict[int, np.ndarray]:
    """Leading eigenvectors of the second moments of all unit vectors, by number of components."""

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for _, v in by_size(batch.column(0)):
                total[v.shape[1]] = total.get(v.shape[1], 0) + v.T @ v
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(total), pa.int32()), pa.array([m.ravel() for m in total.values()], pa.list_(pa.float64()))], names=["d", "m"]
        )

    parts = classes.select("vector").mapInArrow(moments, "d int, m array<double>")
    sums = parts.select("d", F.posexplode("m").alias("k", "x")).groupBy("d", "k").agg(F.sum("x").alias("x"))
    found = sums.groupBy("d").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "x"))), lambda s: s["x"]).alias("m"))
    axes = {}
    for row in found.collect():  # one row of d * d numbers for each number of components
        _, vectors = np.linalg.eigh(np.array(row["m"]).reshape(row["d"], row["d"]))
        axes[row["d"]] = np.ascontiguousarray(vectors[:, ::-1][:, :dims])
    return axes


def blocks(classes: DataFrame, how: GridJoin, axes: dict[int, np.ndarray]) -> DataFrame:
    """block, label, d, lo, hi (box in leading dimensions), ids, copies, vectors (bytes), in grid order."""

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells = [None] * batch.num_rows
            for at, v in by_size(batch.column(3)):
                for k, c in zip(at, np.floor(v @ axes[v.shape[1]] / how.reach).astype(np.int32), strict=True):
                    cells[k] = c
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([len(x) for x in batch.column(3)], pa.int32()), pa.array(cells, pa.list_(pa.int32()))], names=["id", "label", "copies", "vector", "d", "cells"])

    placed = classes.select("id", "label", "copies", "vector").mapInArrow(project, "id long, label long, copies long, vector array<double>, d int, cells array<int>")
    order = ["label", "d", "cells", "id"]
    ordered = placed.repartitionByRange(*order).sortWithinPartitions(*order)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 24
        held, key = [], None

        def block():
            nonlocal number
            ids, copies, vectors = zip(*held, strict=True)
            v = unit(np.array(vectors))
            p = v @ axes[v.shape[1]]
            number += 1
            row = (number, *key, p.min(axis=0).tolist(), p.max(axis=0).tolist(), np.array(ids, np.int64).tobytes(), np.array(copies, np.int64).tobytes(), v.tobytes())
            types = (pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.float64()), pa.list_(pa.float64()), pa.binary(), pa.binary(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, types, strict=True)], names=["block", "label", "d", "lo", "hi", "ids", "copies", "vectors"])

        for batch in batches:
            for i, label, n, v, d in zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True):
                if held and (key != (label, d) or len(held) == how.block):
                    yield block()
                    held = []
                key = (label, d)
                held.append((i, n, v))
        if held:
            yield block()

    return ordered.mapInArrow(cut, "block long, label long, d int, lo array<double>, hi array<double>, ids binary, copies binary, vectors binary")


def near_boxes(reach: float) -> Column:
    """Whether the boxes of blocks x and y come within reach of each other."""
    gap = F.zip_with(
        F.zip_with("x.lo", "y.hi", lambda a, b: F.greatest(a - b, F.lit(0.0))),
        F.zip_with("y.lo", "x.hi", lambda a, b: F.greatest(a - b, F.lit(0.0))), lambda a, b: F.greatest(a, b),
    )
    return F.aggregate(gap, F.lit(0.0), lambda s, g: s + g * g) <= reach * reach


def pairs_within(a: np.ndarray, b: np.ndarray, pa_: np.ndarray, pb: np.ndarray, how: GridJoin, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Places (i, j) of linked rows of the two intervals; i < j where both are the same one."""
    out_i, out_j = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]

    def join(i0, i1, j0, j1):
        if same and i0 >= j1:
            return  # below the diagonal
        p, q = pa_[i0:i1], pb[j0:j1]
        gap = np.maximum(np.maximum(p.min(axis=0) - q.max(axis=0), q.min(axis=0) - p.max(axis=0)), 0)
        if (gap * gap).sum() > how.reach * how.reach:
            return
        if i1 - i0 <= how.leaf and j1 - j0 <= how.leaf:
            i, j = np.nonzero(a[i0:i1] @ b[j0:j1].T >= how.cosine)
            i, j = i + i0, j + j0
            keep = i < j if same else slice(None)
            out_i.append(i[keep])
            out_j.append(j[keep])
            return
        mi, mj = ((i0 + i1) // 2 if i1 - i0 > how.leaf else i1), ((j0 + j1) // 2 if j1 - j0 > how.leaf else j1)
        for r in [(i0, mi), (mi, i1)]:
            for s in [(j0, mj), (mj, j1)]:
                if r[0] < r[1] and s[0] < s[1]:
                    join(*r, *s)

    join(0, len(a), 0, len(b))
    return np.concatenate(out_i), np.concatenate(out_j)


def meeting_blocks(cut: DataFrame, how: GridJoin) -> DataFrame:
    """a, b (a <= b): blocks of one label whose boxes are near.

    They meet by grid cells of the two leading dimensions: one block with the cells its box lies in, the other with those
    and their neighbours. So a label with most blocks is spread over its cells, and only boxes near by are compared.
    """

    def cells(k: int, more: int) -> Column:
        low, high = (F.floor(F.coalesce(F.get(c, F.lit(k)), F.lit(0.0)) / how.reach) for c in ("lo", "hi"))
        return F.sequence(low - more, high + more)

    box = cut.select("block", "label", "d", "lo", "hi")
    x, y = (
        box.withColumn("c0", F.explode(cells(0, more))).withColumn("c1", F.explode(cells(1, more))).alias(name) for name, more in (("x", 0), ("y", 1))
    )
    same = [F.col(f"x.{c}") == F.col(f"y.{c}") for c in ("label", "d", "c0", "c1")]
    near = reduce(lambda p, q: p & q, same) & (F.col("x.block") <= F.col("y.block")) & near_boxes(how.reach)
    return x.join(y, near).select(F.col("x.block").alias("a"), F.col("y.block").alias("b")).distinct()


def tiled(pairs: DataFrame, cut: DataFrame, how: GridJoin) -> DataFrame:
    """ta, tb, block, d, todo, ids, copies, vectors: pairs of neighbouring blocks in tiles, each with its blocks once.

    A tile's first row (block -1) has its pairs, at most tile * tile, the others its blocks, at most twice ``tile``.
    """
    placed = pairs.selectExpr("*", f"a DIV {how.tile} AS ta", f"b DIV {how.tile} AS tb")
    need = placed.select("ta", "tb", F.col("a").alias("block")).union(placed.select("ta", "tb", "b")).distinct()
    heads = placed.groupBy("ta", "tb").agg(F.collect_list(F.struct("a", "b")).alias("todo")).withColumn("block", F.lit(-1).cast("long"))
    rows = need.join(cut.select("block", "d", "ids", "copies", "vectors"), "block").unionByName(heads, allowMissingColumns=True)
    rows = rows.select("ta", "tb", "block", "d", "todo", "ids", "copies", "vectors")
    return rows.repartition("ta", "tb").sortWithinPartitions("ta", "tb", "block")


def links_between(x: tuple, y: tuple, axes: np.ndarray, how: GridJoin, same: bool) -> pa.RecordBatch | None:
    """id, links (to copies in the other block), root (smallest id of its local component) of blocks (ids, copies, vectors)."""
    (ids_a, n_a, v_a), (ids_b, n_b, v_b) = x, y
    i, j = pairs_within(v_a, v_b, v_a @ axes, v_b @ axes, how, same)
    if not len(i):
        return None
    ids = ids_a if same else np.concatenate([ids_a, ids_b])
    if not same:
        j = j + len(ids_a)
    copies = n_a if same else np.concatenate([n_a, n_b])
    links = np.bincount(i, copies[j], len(ids)) + np.bincount(j, copies[i], len(ids))
    root = ids.copy()
    while True:
        before = root.copy()
        least = np.minimum(root[i], root[j])
        np.minimum.at(root, i, least)
        np.minimum.at(root, j, least)
        if (root == before).all():
            break
    at = np.flatnonzero(links)
    return pa.RecordBatch.from_arrays([pa.array(ids[at]), pa.array(links[at].astype(np.int64)), pa.array(root[at])], names=["id", "links", "root"])


def local_links(how: GridJoin, axes: dict[int, np.ndarray]):
    """The links of each tile's pairs; blocks come in rising order, so a pair is joined when its later block is there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        todo: dict[int, list[int]] = {}
        held: dict[int, tuple] = {}
        for batch in batches:
            for row in range(batch.num_rows):
                block, d, pairs, *raw = (batch.column(k)[row] for k in range(2, 8))
                number = block.as_py()
                if number < 0:
                    todo, held = {}, {}
                    for p in pairs.as_py():
                        todo.setdefault(p["b"], []).append(p["a"])
                    continue
                ids, copies, vectors = (np.frombuffer(r.as_buffer(), t) for r, t in zip(raw, [np.int64, np.int64, float], strict=True))
                held[number] = ids, copies, vectors.reshape(-1, d.as_py())
                for a in todo.get(number, ()):
                    found = links_between(held[a], held[number], axes[d.as_py()], how, a == number)
                    if found is not None:
                        yield found

    return run


def embedding_links(vectors: DataFrame, how: GridJoin = GridJoin(), id_col="vec_id", vector_col="embedding", label_col="label") -> DataFrame:
    """id, n_links, component_id, kept for each row.

    Vectors of one label and number of components link at a cosine of at least ``how.cosine`` in double precision.
    n_links counts the other vectors linked directly, component_id is the smallest id reachable by links, kept says that
    it is the vector's own. Equal vectors are compared once and counted as often as they stand there. A vector that is
    null, zero or has null or non-finite components, or a null label, links with nothing; a row without an id has no
    component and is kept. Other columns aren't read.
    """
    mine = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), F.col(vector_col).cast("array<double>").alias("vector"))
    mine = mine.withColumns({"h1": F.xxhash64("vector"), "h2": F.xxhash64(F.lit("second"), "vector")})
    mine = mine.withColumn("fit", F.col("id").isNotNull() & F.col("label").isNotNull() & usable(F.col("vector")))
    key = ["label", "h1", "h2"]
    classes = session.cut_lineage(mine.filter("fit").groupBy(*key).agg(F.min("id").alias("id"), F.count("*").alias("copies"), F.first("vector").alias("vector")))
    axes = principal_axes(classes, how.dims)
    cut = session.cut_lineage(blocks(classes, how, axes))
    pairs = session.cut_lineage(meeting_blocks(cut, how))
    with arrow_rows(vectors.sparkSession, 8):
        found = session.cut_lineage(tiled(pairs, cut, how).mapInArrow(local_links(how, axes), "id long, links long, root long"))
    counts = found.groupBy("id").agg(F.sum("links").alias("links"))
    groups = components(found, "id", "root").withColumnRenamed("node", "id")
    named = classes.select(*key, "id", "copies").join(counts, "id", "left").join(groups, "id", "left")
    named = session.cut_lineage(named.select(
        *key, (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "id").alias("component_id")
    ))
    joined = mine.select("id", "fit", *key).join(named, key, "left")
    component = F.coalesce(F.when(F.col("fit"), F.col("component_id")), F.col("id"))
    return joined.select(
        F.col("id").alias(id_col), F.when(F.col("fit"), F.col("n_links")).otherwise(0).cast("long").alias("n_links"),
        component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"),
    )
