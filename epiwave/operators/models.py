"""The four phase classifiers on Spark ML, and tables read off the fitted models."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml import Model, PipelineModel
from pyspark.ml.classification import (
    GBTClassifier,
    LogisticRegression,
    MultilayerPerceptronClassifier,
    OneVsRest,
    RandomForestClassifier,
)
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.feature import IndexToString, StringIndexerModel, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_dir
from ..spec import ModelSettings
from .features import Standardizer, balanced_weights, fit_standardizer
from .splits import tail_holdout

ROWS_PER_TASK = 20_000
LABEL, FEATURES, WEIGHT, PRED = "label", "features", "weight", "pred"


def label_indexer(labels: Sequence[str], col: str = "phase") -> StringIndexerModel:
    """Class -> 0..k-1 in lexicographic order of the full label set, also for classes absent in training."""
    return StringIndexerModel.from_labels(sorted(labels), inputCol=col, outputCol=LABEL, handleInvalid="error")


def decode_labels(df: DataFrame, labels: Sequence[str], col: str = "prediction", out: str = PRED) -> DataFrame:
    return IndexToString(inputCol=col, outputCol=out, labels=sorted(labels)).transform(df)


def assemble(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return VectorAssembler(inputCols=list(cols), outputCol=FEATURES).transform(df)


@dataclass(frozen=True)
class PhaseModel:
    """A fitted classifier with everything needed to apply it to raw feature rows."""

    name: str
    model: Model
    cols: tuple[str, ...]
    labels: tuple[str, ...]
    scaler: Standardizer | None = None

    def prepare(self, df: DataFrame) -> DataFrame:
        """Raw feature rows -> rows with the (scaled) feature vector; other columns stay as they are."""
        if self.scaler is None:
            return assemble(df, self.cols)
        raw = [F.col(c).alias(f"_raw_{c}") for c in self.cols]
        scaled = assemble(self.scaler.apply(df.select("*", *raw)), self.cols)
        back = [F.col(f"_raw_{c}").alias(c) if c in self.cols else F.col(c) for c in df.columns]
        return scaled.select(*back, FEATURES)

    def predict(self, df: DataFrame) -> DataFrame:
        """Rows plus ``pred``; works on test rows or on the whole timeline."""
        scored = decode_labels(self.model.transform(self.prepare(df)), self.labels)
        return scored.select(*df.columns, PRED)


def training_rows(
    train: DataFrame, cols: Sequence[str], labels: Sequence[str], scaler: Standardizer | None = None, weighted: bool = False
) -> DataFrame:
    """Features, label index and, if asked for, the balanced weight of the training rows."""
    rows = scaler.apply(train) if scaler else train
    rows = balanced_weights(rows, "phase", WEIGHT) if weighted else rows
    # Tree and gradient passes run many short jobs: as few tasks as the rows fill.
    rows = rows.coalesce(max(1, -(-train.count() // ROWS_PER_TASK)))
    return label_indexer(labels).transform(assemble(rows, cols)).select(FEATURES, LABEL, *[WEIGHT] * weighted)


def train_rf(train: DataFrame, cols: Sequence[str], labels: Sequence[str], s: ModelSettings = ModelSettings()) -> PhaseModel:
    rf = RandomForestClassifier(
        featuresCol=FEATURES, labelCol=LABEL, weightCol=WEIGHT, numTrees=s.rf_trees, maxDepth=s.rf_depth,
        featureSubsetStrategy="sqrt", seed=s.seed, maxMemoryInMB=1024,
    )
    return PhaseModel("Random Forest", rf.fit(training_rows(train, cols, labels, weighted=True)), tuple(cols), tuple(labels))


def train_gbt(train: DataFrame, cols: Sequence[str], labels: Sequence[str], s: ModelSettings = ModelSettings()) -> PhaseModel:
    """One boosted model per class; the class models train in parallel."""
    # With a folder set, boosting cuts its growing lineage there every few rounds.
    shared_dir(train.sparkSession)
    gbt = GBTClassifier(
        featuresCol=FEATURES, labelCol=LABEL, maxIter=s.gbt_rounds, maxDepth=s.gbt_depth, stepSize=s.gbt_rate, seed=s.seed, maxMemoryInMB=512
    )
    ovr = OneVsRest(classifier=gbt, featuresCol=FEATURES, labelCol=LABEL, parallelism=len(labels))
    return PhaseModel("Gradient Boosting", ovr.fit(training_rows(train, cols, labels)), tuple(cols), tuple(labels))


def train_lr(train: DataFrame, cols: Sequence[str], labels: Sequence[str], s: ModelSettings = ModelSettings()) -> PhaseModel:
    """Multinomial regression; balanced weights sum to the row count, hence the penalty 1 / (C n)."""
    scaler = fit_standardizer(train, cols)
    rows = training_rows(train, cols, labels, scaler, weighted=True)
    lr = LogisticRegression(
        featuresCol=FEATURES, labelCol=LABEL, weightCol=WEIGHT, family="multinomial", elasticNetParam=0.0,
        regParam=1.0 / (s.lr_c * max(train.count(), 1)), standardization=False, maxIter=s.lr_iterations,
    )
    return PhaseModel("Logistic Regression", lr.fit(rows), tuple(cols), tuple(labels), scaler)


def _perceptron(n_features: int, n_classes: int, iterations: int, s: ModelSettings) -> MultilayerPerceptronClassifier:
    return MultilayerPerceptronClassifier(
        featuresCol=FEATURES, labelCol=LABEL, layers=[n_features, *s.mlp_hidden, n_classes], maxIter=iterations, seed=s.seed
    )


def _perceptron_steps(train: DataFrame, cols: Sequence[str], labels: Sequence[str], order: Sequence[str], s: ModelSettings):
    """(iterations so far, model, losses of its iterations, validation loss) at every documented step.

    Validation rows are the tail of the training rows in the stated order. Each step goes on from the weights of the one
    before; the optimiser's memory starts anew there, so the steps are part of the settings.
    """
    parts = tail_holdout(train, order, holdout=s.validation)
    scaler = fit_standardizer(train, cols)
    index = PipelineModel([VectorAssembler(inputCols=list(cols), outputCol=FEATURES), label_indexer(labels)])
    scaled = index.transform(scaler.apply(parts)).select(FEATURES, LABEL, "part")
    scaled = scaled.coalesce(max(1, -(-train.count() // ROWS_PER_TASK))).persist()
    fit, held = scaled.where("part = 'fit'"), scaled.where("part = 'validation'")
    judge = MulticlassClassificationEvaluator(labelCol=LABEL, metricName="logLoss")
    done, weights = 0, None
    try:
        for n in sorted({n for n in s.loss_steps if n < s.mlp_iterations} | {s.mlp_iterations}):
            learner = _perceptron(len(cols), len(labels), n - done, s)
            if weights is not None:
                learner = learner.setInitialWeights(weights)
            model = learner.fit(fit)
            weights, done = model.weights, n
            yield n, model, [float(x) for x in model.summary().objectiveHistory], float(judge.evaluate(model.transform(held))), scaler
    finally:
        scaled.unpersist()


def train_mlp(
    train: DataFrame, cols: Sequence[str], labels: Sequence[str], s: ModelSettings = ModelSettings(), order: Sequence[str] | None = None
) -> PhaseModel:
    """Perceptron on standardised features. With ``order`` the last share of the rows is held out and the step with the
    lowest validation loss is kept, else all rows train."""
    if order:
        steps = [(loss, n, model, scaler) for n, model, _, loss, scaler in _perceptron_steps(train, cols, labels, order, s)]
        _, _, model, scaler = min(steps, key=lambda x: x[:2])
    else:
        scaler = fit_standardizer(train, cols)
        model = _perceptron(len(cols), len(labels), s.mlp_iterations, s).fit(training_rows(train, cols, labels, scaler))
    return PhaseModel("MLP", model, tuple(cols), tuple(labels), scaler)


TRAINERS = {
    "Random Forest": train_rf,
    "Gradient Boosting": train_gbt,
    "Logistic Regression": train_lr,
    "MLP": train_mlp,
}


def _importance_vector(model: PhaseModel) -> list[float]:
    fitted = model.model
    parts = fitted.models if hasattr(fitted, "models") else [fitted]
    vectors = [p.featureImportances.toArray() for p in parts]
    return [float(x) for x in sum(vectors) / len(vectors)]


def feature_importances(spark: SparkSession, models: Sequence[PhaseModel], names: dict[str, str]) -> DataFrame:
    """model, feature, display label, importance and the uniform baseline 1/d (one row per model and feature)."""
    rows = [
        (m.name, c, names.get(c, c), v, 1.0 / len(m.cols)) for m in models for c, v in zip(m.cols, _importance_vector(m))
    ]
    return spark.createDataFrame(rows, "model string, feature string, feature_label string, importance double, baseline double")


def coefficients(spark: SparkSession, model: PhaseModel, names: dict[str, str]) -> DataFrame:
    """class, feature, display label, coefficient."""
    matrix = model.model.coefficientMatrix.toArray()
    labels = sorted(model.labels)
    rows = [
        (labels[k], c, names.get(c, c), float(matrix[k][j])) for k in range(len(labels)) for j, c in enumerate(model.cols)
    ]
    return spark.createDataFrame(rows, "phase string, feature string, feature_label string, coefficient double")


def loss_curve(
    train: DataFrame, cols: Sequence[str], labels: Sequence[str], order: Sequence[str], s: ModelSettings = ModelSettings()
) -> DataFrame:
    """Training and validation loss of the perceptron at the documented steps; validation rows are the tail in ``order``."""
    rows = []
    for n, _, losses, held, _ in _perceptron_steps(train, cols, labels, order, s):
        rows.append((n, losses[-1], held))
    return train.sparkSession.createDataFrame(rows, "iteration int, train_loss double, validation_loss double")


def mean_probabilities(model: PhaseModel, train: DataFrame) -> DataFrame:
    """phase, mean_probability: of each class over the training rows with balanced weights."""
    rows = _with_probabilities(model, train)
    sums = rows.agg(*[(F.sum(F.col("_w") * F.col("_p")[k]) / F.sum("_w")).alias(p) for k, p in enumerate(sorted(model.labels))])
    return sums.select(F.inline(F.array(*[F.struct(F.lit(p).alias("phase"), F.col(f"`{p}`").alias("mean_probability")) for p in sorted(model.labels)])))


def _with_probabilities(model: PhaseModel, train: DataFrame) -> DataFrame:
    rows = model.model.transform(model.prepare(balanced_weights(train, "phase", "_w")))
    return rows.withColumns({"_p": vector_to_array("probability"), "_x": vector_to_array(FEATURES)})


def penalised_gradient(model: PhaseModel, train: DataFrame, s: ModelSettings = ModelSettings()) -> list[list[float]]:
    """Derivative of the regression's penalised loss by every coefficient, near 0 at its optimum; one pass over the rows."""
    rows, labels = _with_probabilities(model, train), sorted(model.labels)
    miss = [F.col("_w") * (F.col("_p")[k] - (F.col("phase") == p).cast("double")) for k, p in enumerate(labels)]
    sums = rows.agg(F.sum("_w"), F.count("*"), *[F.sum(m * F.col("_x")[j]) for m in miss for j in range(len(model.cols))]).first()
    total, n, parts = sums[0], sums[1], sums[2:]
    coef = model.model.coefficientMatrix.toArray()
    d = len(model.cols)
    return [[parts[k * d + j] / total + coef[k][j] / (s.lr_c * n) for j in range(d)] for k in range(len(labels))]
