"""Quality classifier: regularised quadratic discriminant over transformed document statistics.

Each text gives a short vector of statistics, transformed so that ordinary prose is roughly normal in each. Both classes
get a mean and a covariance that is shrunk towards the covariance of all training rows and towards a multiple of the
identity. A score is the difference of two Gaussian log densities, whose Mahalanobis distances come from Cholesky factors
inverted once per model.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from epiwave.llm.common import stored

SYMBOLS = b"#*$%&|<>@^_~=+\\{}[]"
UPPER = bytes(range(65, 91))
LETTERS = UPPER + bytes(range(97, 123))
DIGITS = b"0123456789"
STOPS = b".!?"
COMMAS = b",;:"
#: What the entries of a vector are.
STATISTICS = (
    "words", "word_length", "word_length_spread", "distinct_words", "top_word", "symbols", "capitals", "digits", "shouts",
    "sentence_length", "commas", "repeated_lines", "lines", "controls",
)


@dataclass(frozen=True)
class Shrinkage:
    """pool: weight of the covariance of all training rows in that of a class. ridge: weight of the mean variance times
    the identity in the result. Both lie from 0 to 1; statistics are scaled to unit variance first."""

    pool: float = 0.05
    ridge: float = 0.01


def rate(count: int, size: int) -> float:
    """A share on a scale that tells rare from absent as well as half from all."""
    return math.log1p(100 * count / size) if size else 0.0


def document_statistics(text: str | None) -> list[float]:
    """The vector of one text, from all of it; a null text is empty, and an empty one has zeros."""
    raw = (text or "").encode()
    words = raw.split()
    if not words:
        return [0.0] * len(STATISTICS)
    n, size = len(words), len(raw)

    def count(chars: bytes) -> int:
        return size - len(raw.translate(None, chars))

    lengths = np.fromiter(map(len, words), np.int64, n)
    seen = Counter(words)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    letters, stops = count(LETTERS), count(STOPS)
    return [
        math.log1p(n), math.log(lengths.mean()), math.log1p(lengths.std()), math.log1p(len(seen)) - math.log1p(n),
        rate(max(seen.values()), n), rate(count(SYMBOLS), n), rate(count(UPPER), letters), rate(count(DIGITS), size),
        rate(count(b"!?"), n), math.log((n + 1) / (stops + 1)), rate(count(COMMAS), n), rate(len(lines) - len(set(lines)), len(lines)),
        rate(len(lines), n), rate(count(bytes(range(32))) - count(b"\t\n\r"), size),
    ]


def statistics(text: Column) -> Column:
    """``document_statistics`` as an array of doubles."""

    @F.arrow_udf("array<double>")
    def vector(texts: pa.Array) -> pa.Array:
        return pa.array([document_statistics(t.as_py()) for t in texts], pa.list_(pa.float64()))

    return vector(text)


def held_out(id_col: str) -> Column:
    """Whether a row's label is for tests only; a row without an id is not held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def class_sums(rows: DataFrame) -> dict[int, tuple[float, np.ndarray, np.ndarray]]:
    """class -> rows, sums and sums of products of ``x``; partitions add up on their own before anything is shuffled."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            x = np.array(batch.column(1).to_pylist(), float).reshape(batch.num_rows, -1)
            x = np.hstack([np.ones((len(x), 1)), x])
            y = batch.column(0).to_numpy(zero_copy_only=False)
            for c in set(y.tolist()):
                total[c] = total.get(c, 0.0) + x[y == c].T @ x[y == c]
        for c, m in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([c] * m.size, pa.int32()), pa.array(range(m.size), pa.int32()), pa.array(m.ravel())], names=["class", "k", "value"])

    sums = rows.select(F.col("y").cast("int"), "x").mapInArrow(partial, "class int, k int, value double").groupBy("class", "k").agg(F.sum("value").alias("value"))
    found: dict[int, dict[int, float]] = {}
    for r in sums.collect():  # at most two classes times the squared number of statistics
        found.setdefault(r["class"], {})[r["k"]] = r["value"]
    out = {}
    for c, entries in found.items():
        d = math.isqrt(len(entries))
        m = np.array([entries[k] for k in range(d * d)]).reshape(d, d)
        out[c] = float(m[0, 0]), m[0, 1:], m[1:, 1:]
    return out


@dataclass(frozen=True)
class QuadraticDiscriminant:
    """A fitted model: scaling of the statistics, and for each class its mean, inverted Cholesky factor and constant."""

    scale: np.ndarray
    classes: dict[int, tuple[np.ndarray, np.ndarray, float]]

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        """Log density plus log prior of class 1 over those of class 0; without one of the classes, infinite or 0."""
        if len(self.classes) < 2:
            return np.full(len(x), 0.0 if not self.classes else math.inf if 1 in self.classes else -math.inf)
        one, none = ((np.square((x / self.scale - mean) @ factor.T).sum(axis=1), constant) for mean, factor, constant in (self.classes[1], self.classes[0]))
        return (none[0] - one[0]) / 2 + one[1] - none[1]

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Log odds on the scale 0 to 1 by x / (1 + |x|), which, unlike the logistic curve, keeps far odds apart."""
        odds = self.log_odds(x)
        with np.errstate(invalid="ignore"):
            return np.where(np.isinf(odds), (1 + np.sign(odds)) / 2, (1 + odds / (1 + np.abs(odds))) / 2)


def fit(rows: DataFrame, how: Shrinkage = Shrinkage()) -> QuadraticDiscriminant:
    """From rows (y, x): a class 0 or 1 and a vector of statistics. Only sums reach the driver."""
    sums = class_sums(rows)
    if not sums:
        return QuadraticDiscriminant(np.ones(len(STATISTICS)), {})
    total = sum(n for n, _, _ in sums.values())
    mean = sum(s for _, s, _ in sums.values()) / total
    spread = np.maximum(np.diag(sum(p for _, _, p in sums.values())) / total - mean * mean, 0)
    scale = np.where(spread > 1e-12, np.sqrt(spread), 1.0)
    centred = {c: (p / n - np.outer(s / n, s / n)) / np.outer(scale, scale) for c, (n, s, p) in sums.items()}
    pooled = sum(sums[c][0] / total * m for c, m in centred.items())
    classes = {}
    for c, (n, s, _) in sums.items():
        cov = (1 - how.pool) * centred[c] + how.pool * pooled
        cov = (1 - how.ridge) * cov + how.ridge * max(float(np.trace(cov)) / len(cov), 1e-6) * np.eye(len(cov))
        factor = np.linalg.cholesky(cov)
        constant = math.log(n / total) - float(np.log(np.diag(factor)).sum())
        classes[c] = s / n / scale, np.linalg.inv(factor), constant
    return QuadraticDiscriminant(scale, classes)


def score(model: QuadraticDiscriminant, x: Column) -> Column:
    @F.arrow_udf("double")
    def scored(vectors: pa.Array) -> pa.Array:
        return pa.array(model.scores(np.array(vectors.to_pylist(), float).reshape(len(vectors), -1))) if len(vectors) else pa.array([], pa.float64())

    return scored(x)


def quality_scores(docs: DataFrame, labels: DataFrame, how: Shrinkage = Shrinkage(), id_col="doc_id", text_col="text", label_col="quality") -> DataFrame:
    """id, held_out, score (0 to 1, higher: label 1 likelier) and predicted (1 if score >= 0.5) of every row of ``docs``.

    The model learns from the labelled documents that are not held out; a label is 0 or 1, other labels and labels of
    unknown documents say nothing, a label given twice counts twice. Null and empty texts have a vector of zeros and are
    scored like any other. Repeated rows are scored alike. With labels of one class only every score is that class, with
    none 0.5. Only ids, texts and labels are read. The texts are read once: their vectors are stored for both uses.
    """
    vectors = stored(docs.select(id_col, statistics(F.col(text_col)).alias("x")))
    known = labels.select(F.col(id_col).alias("__id"), F.col(label_col).alias("y")).filter(F.col("y").isin(0, 1) & ~held_out("__id"))
    model = fit(vectors.join(known, F.col(id_col) == F.col("__id")).select("y", "x"), how)
    scored = vectors.select(id_col, held_out(id_col).alias("held_out"), score(model, F.col("x")).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
