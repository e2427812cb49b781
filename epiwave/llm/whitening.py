"""Embedding whitening by incremental eigendecomposition.

Entries become whole numbers, so counts, sums and deviations are exact. Each partition takes its vectors one by one: the
scatter around the running mean grows by a rank-one term, and its eigenpairs follow from the secular equation, after
deflation of what the term doesn't touch. Spectra of partitions combine pair by pair through the same rank-one updates,
few at a time in a tree. A last Rayleigh-Ritz step projects the covariance of all vectors, counted by all tasks, on the
eigenvectors found and turns them to double precision.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from epiwave.llm.common import arrow_rows, stored

SCALE, SHIFT = 1024, 100_000
#: Partial results that one task combines.
FAN_IN = 16
EPS = float(np.finfo(float).eps)
LONGEST = (1 << 63) - 1


def secular_roots(d: np.ndarray, z2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Roots of 1 + sum z2 / (d - x) = 0 for rising d and positive z2, one right of each d.

    As (nearest pole's place, distance from it): differences to the poles then keep all their digits. Each step fits a
    fraction with two poles to the sums left and right of the root; a step that leaves the bracket becomes a bisection.
    """
    k = len(d)
    top = np.append(d[1:], d[-1] + z2.sum())
    gap = top - d
    middle = d[:, None] - d[None, :] - (gap / 2)[None, :]
    right = 1 + (z2[:, None] / middle).sum(axis=0) < 0
    right[-1] = False
    at = np.arange(k) + right
    delta = d[:, None] - d[at][None, :]
    low, high = np.where(right, -gap / 2, 0.0), np.where(right, 0.0, np.append(gap[:-1] / 2, gap[-1]))
    low[~right] = np.where(1 + (z2[:, None] / middle).sum(axis=0)[~right] < 0, gap[~right] / 2, 0.0)
    high[~right & (low > 0)] = gap[~right & (low > 0)]
    x = (low + high) / 2
    left = np.triu(np.ones((k, k)))  # left[j, i]: pole j lies left of root i
    p = delta[np.arange(k), np.arange(k)]
    q = np.append(delta[np.arange(1, k), np.arange(k - 1)], 0.0)
    for _ in range(60):
        away = delta - x[None, :]
        share = z2[:, None] / away
        slope = share / away
        f = 1 + share.sum(axis=0)
        steep, psi = slope.sum(axis=0), np.einsum("ji,ji->i", slope, left)
        done = np.abs(f) <= 4 * EPS * (1 + np.abs(share).sum(axis=0)) + np.abs(x) * EPS * steep
        if done.all():
            break
        low, high = np.where(f < 0, x, low), np.where(f < 0, high, x)
        phi = steep - psi
        a, b = p - x, q - x
        c = f - a * psi - b * phi
        c[-1] = f[-1] - a[-1] * psi[-1]
        quad = (a + b) * f - a * b * (psi + phi)
        prod = a * b * f
        with np.errstate(all="ignore"):
            root = np.sqrt(np.maximum(quad * quad - 4 * prod * c, 0.0))
            step = np.where(quad > 0, 2 * prod / (quad + root), (quad - root) / (2 * c))
            step[-1] = a[-1] * f[-1] / c[-1] if c[-1] else 0.0
        new = x + step
        new = np.where(np.isfinite(new) & (new > low) & (new < high), new, (low + high) / 2)
        x = np.where(done | (new == low) | (new == high), x, new)
    return at, x


def rank_one(values: np.ndarray, vectors: np.ndarray, v: np.ndarray, weight: float = 1.0) -> tuple[np.ndarray, np.ndarray]:
    """Eigenpairs of vectors @ diag(values) @ vectors.T + weight * outer(v, v), values rising; weight isn't negative."""
    z = vectors.T @ v
    size = weight * float(z @ z)
    if size <= 0:
        return values, vectors
    z = np.sqrt(weight) * z
    tolerance = 8 * EPS * max(float(np.abs(values).max()), size)
    vectors, starts = vectors.copy(), np.flatnonzero(np.append(True, np.diff(values) > tolerance))
    for s, e in zip(starts, np.append(starts[1:], len(values)), strict=True):
        # Equal values: a reflection turns their vectors until one alone meets the new term.
        if e - s > 1 and np.abs(z[s : e - 1]).max() > 0:
            norm = np.linalg.norm(z[s:e])
            mirror = z[s:e].copy()
            mirror[-1] += norm if mirror[-1] >= 0 else -norm
            mirror /= np.linalg.norm(mirror)
            vectors[:, s:e] -= np.outer(vectors[:, s:e] @ (2 * mirror), mirror)
            end = -norm if z[e - 1] >= 0 else norm
            z[s:e] = 0.0
            z[e - 1] = end
    touched = np.flatnonzero(z * z > tolerance * EPS)
    touched = touched[np.abs(z[touched]) * np.sqrt(size) > tolerance]
    if not len(touched):
        return values, vectors
    d, zt = values[touched], z[touched]
    at, x = secular_roots(d, zt * zt)
    # away[j, i] = d_j - root_i. Vectors come from weights for which the computed roots are exact, so they are orthogonal.
    away = (d[:, None] - d[at][None, :]) - x[None, :]
    with np.errstate(divide="ignore", invalid="ignore"):
        between = d[None, :] - d[:, None]
        np.fill_diagonal(between, 1.0)
        ratio = -away / between.T
        np.fill_diagonal(ratio, -np.diag(away))
        exact = np.sqrt(np.abs(np.prod(ratio, axis=1))) * np.where(zt < 0, -1.0, 1.0)
        turn = exact[:, None] / away
    turn = np.where(np.isfinite(turn), turn, 0.0)
    norms = np.linalg.norm(turn, axis=0)
    turn /= np.where(norms > 0, norms, 1.0)
    values = values.copy()
    values[touched] = d[at] + x
    vectors[:, touched] = vectors[:, touched] @ turn
    order = np.argsort(values, kind="stable")
    return values[order], vectors[:, order]


@dataclass
class Spectrum:
    """n vectors with their exact sums, and the eigenpairs of their scatter around the mean."""

    dimension: int
    n: int = 0
    sums: list[int] = field(default_factory=list)
    values: np.ndarray | None = None
    vectors: np.ndarray | None = None

    def __post_init__(self):
        if self.values is None:
            self.sums, self.values, self.vectors = [0] * self.dimension, np.zeros(self.dimension), np.eye(self.dimension)

    def mean(self) -> np.ndarray:
        return np.array([s / self.n for s in self.sums])

    def add(self, x: np.ndarray) -> None:
        if self.n:
            self.values, self.vectors = rank_one(self.values, self.vectors, x - self.mean(), self.n / (self.n + 1))
        self.n, self.sums = self.n + 1, [s + int(c) for s, c in zip(self.sums, x, strict=True)]

    def merge(self, other: Spectrum) -> None:
        if not other.n:
            return
        if not self.n:
            self.n, self.sums, self.values, self.vectors = other.n, other.sums, other.values, other.vectors
            return
        apart, weight = self.mean() - other.mean(), self.n * other.n / (self.n + other.n)
        for value, vector in zip(other.values, other.vectors.T, strict=True):
            if value > 0:
                self.values, self.vectors = rank_one(self.values, self.vectors, vector, float(value))
        self.values, self.vectors = rank_one(self.values, self.vectors, apart, weight)
        self.n, self.sums = self.n + other.n, [a + b for a, b in zip(self.sums, other.sums, strict=True)]


@dataclass
class Moments:
    """n vectors, their mean and their scatter around it."""

    n: int
    mean: np.ndarray
    scatter: np.ndarray

    @staticmethod
    def of(x: np.ndarray) -> Moments:
        mean = x.mean(axis=0)
        centred = x - mean
        return Moments(len(x), mean, centred.T @ centred)

    def merge(self, other: Moments) -> None:
        n, apart = self.n + other.n, other.mean - self.mean
        self.scatter = self.scatter + other.scatter + np.outer(apart, apart) * (self.n * other.n / n)
        self.mean = self.mean + apart * (other.n / n)
        self.n = n


SPECTRUM = "part long, n long, sums array<decimal(38,0)>, values array<double>, vectors array<double>"
MOMENTS = "part long, n long, mean array<double>, scatter array<double>"


def spectrum_row(part: int, s: Spectrum) -> pa.RecordBatch:
    types = {"part": pa.int64(), "n": pa.int64(), "sums": pa.list_(pa.decimal128(38, 0)), "values": pa.list_(pa.float64()), "vectors": pa.list_(pa.float64())}
    row = {"part": part, "n": s.n, "sums": s.sums, "values": s.values.tolist(), "vectors": s.vectors.ravel().tolist()}
    return pa.RecordBatch.from_arrays([pa.array([row[k]], t) for k, t in types.items()], names=list(types))


def read_spectrum(r) -> Spectrum:
    d = len(r["values"])
    return Spectrum(d, r["n"], [int(x) for x in r["sums"]], np.array(r["values"]), np.array(r["vectors"]).reshape(d, d))


def moments_row(part: int, m: Moments) -> pa.RecordBatch:
    types = {"part": pa.int64(), "n": pa.int64(), "mean": pa.list_(pa.float64()), "scatter": pa.list_(pa.float64())}
    row = {"part": part, "n": m.n, "mean": m.mean.tolist(), "scatter": m.scatter.ravel().tolist()}
    return pa.RecordBatch.from_arrays([pa.array([row[k]], t) for k, t in types.items()], names=list(types))


def read_moments(r) -> Moments:
    d = len(r["mean"])
    return Moments(r["n"], np.array(r["mean"]), np.array(r["scatter"]).reshape(d, d))


def combined(partial: DataFrame, schema: str, read: Callable, row: Callable):
    """One result of all rows of ``partial`` (None if there are none), combined ``FAN_IN`` at a time by a tree of tasks."""

    def merged(key, table):
        total = None
        for r in sorted(table.to_pylist(), key=lambda r: r["part"]):
            if total is None:
                total = read(r)
            else:
                total.merge(read(r))
        return pa.Table.from_batches([row(key[0].as_py(), total)])

    now = stored(partial)
    while (rows := now.count()) > 1:
        top = now.agg(F.max("part")).first()[0]
        if top >= 4 * rows * FAN_IN:  # few of the partitions had rows: number them anew, so that groups fill
            places = {r[0]: k for k, r in enumerate(now.select("part").orderBy("part").toLocalIterator())}
            now = now.replace(places, subset=["part"])
        now = stored(now.withColumn("part", F.floor(F.col("part") / FAN_IN)).groupBy("part").applyInArrow(merged, schema))
    last = now.first()
    return None if last is None else read(last)


def whole(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """id and ``x``: floor(1024 * entry) + 100000 of the vectors that are there and hold finite numbers only."""
    entries = F.col(vector_col).cast("array<double>")
    fine = F.col(vector_col).isNotNull() & F.forall(entries, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    x = F.transform(entries, lambda c: F.floor(c * SCALE).cast("long") + SHIFT)
    return vectors.select(F.col(id_col), F.when(fine, x).alias("x")).filter("x IS NOT NULL")


def matrix(column: pa.Array, dimension: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dimension)


def partition_spectra(rows: DataFrame, dimension: int) -> DataFrame:
    """The spectrum of each partition's vectors ``x``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Spectrum(dimension)
        for batch in batches:
            for x in matrix(batch.column(0), dimension):
                own.add(x)
        if own.n:
            yield spectrum_row(TaskContext.get().partitionId(), own)

    return rows.select("x").mapInArrow(run, SPECTRUM)


def partition_moments(rows: DataFrame, dimension: int, project: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """Mean and scatter of each partition's projected vectors; batches are centred before they are multiplied."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = None
        for batch in batches:
            if not batch.num_rows:
                continue
            here = Moments.of(project(matrix(batch.column(0), dimension)))
            if own is None:
                own = here
            else:
                own.merge(here)
        if own is not None:
            yield moments_row(TaskContext.get().partitionId(), own)

    return rows.select("x").mapInArrow(run, MOMENTS)


@dataclass(frozen=True)
class Whitening:
    """A fit: count, exact sums, eigenvalues of the covariance by falling size, unit eigenvectors as columns, trace."""

    n: int
    sums: tuple[int, ...]
    values: np.ndarray
    vectors: np.ndarray
    trace: float

    def centred(self, x: np.ndarray) -> np.ndarray:
        """x - sums / n; the whole parts are taken off as whole numbers first."""
        base = np.array([s // self.n for s in self.sums], np.int64)
        return (x - base) - np.array([s % self.n / self.n for s in self.sums])

    def whitened(self, x: np.ndarray, k: int) -> np.ndarray:
        return self.centred(x) @ self.vectors[:, :k] / np.sqrt(self.values[:k])

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Sum over dimensions of (n * x - sums)^2, exact; null where no long holds it."""
        apart = [[self.n * int(c) - s for c, s in zip(row, self.sums, strict=True)] for row in x.tolist()]
        exact = [sum(a * a for a in row) for row in apart]
        return [e if e <= LONGEST else None for e in exact]


def fit_whitening(rows: DataFrame, dimension: int) -> Whitening | None:
    """Fitted to all rows (x); None without rows. One spectrum of a partition, or of a few, is in a task at a time."""
    spectrum = combined(partition_spectra(rows, dimension), SPECTRUM, read_spectrum, spectrum_row)
    if spectrum is None:
        return None
    rough = Whitening(spectrum.n, tuple(spectrum.sums), np.ones(dimension), np.linalg.qr(spectrum.vectors)[0], 1.0)
    ritz = combined(partition_moments(rows, dimension, lambda x: rough.centred(x) @ rough.vectors), MOMENTS, read_moments, moments_row)
    values, turn = np.linalg.eigh(ritz.scatter / ritz.n)
    order = np.argsort(-values, kind="stable")
    return Whitening(rough.n, rough.sums, np.maximum(values[order], 0.0), rough.vectors @ turn[:, order], float(np.trace(ritz.scatter) / ritz.n))


def whiten(vectors: DataFrame, components: int = 8, id_col="vec_id", vector_col="embedding") -> DataFrame:
    """id, component, n, deviation, whitened, explained, identity_error for each vector and leading component.

    Vectors that are null or hold null or non-finite entries are left out of fit and result, and so are those whose
    length isn't the commonest one (of equally common ones the longest). Components are numbered from 1; those without
    variance (up to rounding) have no whitened value (null) and count for nothing in ``identity_error``. Repeated rows count
    as often as they stand. An empty table, or one without usable vectors, gives an empty result. Only id and vector
    columns are read.
    """
    usable = whole(vectors, id_col, vector_col)
    sizes = usable.groupBy(F.size("x").alias("size")).count().orderBy(F.desc("count"), F.desc("size")).first()
    dimension = sizes["size"] if sizes else 0
    rows = usable.filter(F.size("x") == dimension)
    with arrow_rows(vectors.sparkSession, 5000):
        model = fit_whitening(rows, dimension) if dimension else None
        k = min(components, dimension)
        error, live = 0.0, 0
        if model:
            live = int((model.values[:k] > 1e-12 * max(model.trace, 1e-300)).sum())
        if live:
            seen = combined(partition_moments(rows, dimension, lambda x: model.whitened(x, live)), MOMENTS, read_moments, moments_row)
            error = float(np.abs(seen.scatter / seen.n - np.eye(live)).max())
    schema = T.StructType([usable.schema[id_col], *(T.StructField(c, t) for c, t in (
        ("component", T.IntegerType()), ("n", T.LongType()), ("deviation", T.LongType()), ("whitened", T.DoubleType()), ("explained", T.DoubleType()), ("identity_error", T.DoubleType()),
    ))])

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                x, m = matrix(part.column(1), dimension), part.num_rows
                white = np.full((m, k), np.nan)
                white[:, :live] = model.whitened(x, live) if live else white[:, :0]
                explained = model.values[:k] / model.trace if model.trace > 0 else np.zeros(k)
                repeat = np.repeat(np.arange(m), k)
                yield pa.RecordBatch.from_arrays([
                    part.column(0).take(pa.array(repeat)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                    pa.array(np.full(m * k, model.n)), pa.array(model.deviations(x), pa.int64()).take(pa.array(repeat)),
                    pa.array(white.ravel(), mask=np.isnan(white.ravel())), pa.array(np.tile(explained, m)), pa.array(np.full(m * k, error)),
                ], names=schema.names)

    return (rows if model else rows.limit(0)).mapInArrow(emit, schema)
