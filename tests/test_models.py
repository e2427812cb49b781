import numpy as np
import pytest

from epiwave.operators import models
from epiwave.spec import ModelSettings

QUICK = ModelSettings(rf_trees=10, rf_depth=4, gbt_rounds=5, gbt_depth=2, lr_iterations=100, mlp_hidden=(8,), mlp_iterations=40, loss_steps=(1, 5, 20))
LABELS = ["Contained", "Declining", "Growing"]
COLS = ["x", "y"]


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(5)
    centre = {"Contained": (0, 0), "Declining": (4, 0), "Growing": (0, 4)}
    count = {"Contained": 60, "Declining": 20, "Growing": 40}
    data = [
        (p, f"k{i % 4}", i, float(x), float(y))
        for p in LABELS
        for i, (x, y) in enumerate(rng.normal(centre[p], 0.7, size=(count[p], 2)))
    ]
    frame = spark.createDataFrame(data, "phase string, country string, at int, x double, y double")
    return frame.persist()


@pytest.mark.parametrize("name", list(models.TRAINERS))
def test_classifiers_separate_clear_classes_and_repeat(rows, name):
    train = models.TRAINERS[name]
    first, second = (train(rows, COLS, LABELS, QUICK).predict(rows) for _ in range(2))
    assert first.columns == [*rows.columns, "pred"]
    hits = first.where("phase = pred").count()
    assert hits / 120 > 0.9
    key = ["phase", "country", "at"]
    assert first.select(*key, "pred").exceptAll(second.select(*key, "pred")).count() == 0


@pytest.mark.parametrize("name", list(models.TRAINERS))
def test_a_class_absent_in_training_keeps_its_code(rows, name):
    model = models.TRAINERS[name](rows.where("phase <> 'Declining'"), COLS, LABELS, QUICK)
    out = model.predict(rows)
    assert out.where("phase <> 'Declining' AND phase = pred").count() > 90
    assert out.select("x").exceptAll(rows.select("x")).count() == 0


def test_encode_decode_round_trip(rows):
    coded = models.label_indexer(LABELS).transform(rows)
    assert {r["phase"]: r["label"] for r in coded.select("phase", "label").distinct().collect()} == {
        "Contained": 0.0, "Declining": 1.0, "Growing": 2.0,
    }
    assert models.decode_labels(coded, LABELS, "label", "back").where("back <> phase").count() == 0


def test_importances_and_coefficients(spark, rows):
    names = {"x": "Width", "y": "Height"}
    fitted = [models.train_rf(rows, COLS, LABELS, QUICK), models.train_gbt(rows, COLS, LABELS, QUICK)]
    out = models.feature_importances(spark, fitted, names).collect()
    assert len(out) == 4 and {r["feature_label"] for r in out} == {"Width", "Height"} and {r["baseline"] for r in out} == {0.5}
    for m in ("Random Forest", "Gradient Boosting"):
        assert sum(r["importance"] for r in out if r["model"] == m) == pytest.approx(1.0)
    coef = models.coefficients(spark, models.train_lr(rows, COLS, LABELS, QUICK), names)
    best = {r["phase"]: r["feature"] for r in coef.orderBy("coefficient").collect()}
    assert coef.count() == 6 and best["Declining"] == "x" and best["Growing"] == "y"


def test_regression_is_the_penalised_optimum(rows):
    """At the optimum the gradient of C * weighted loss + |W|^2 / 2 vanishes."""
    model = models.train_lr(rows, COLS, LABELS, ModelSettings(lr_iterations=1000))
    data = rows.toPandas()
    x = (data[COLS] - data[COLS].mean()) / data[COLS].std(ddof=0)
    y = np.stack([(data.phase == p).to_numpy(float) for p in LABELS], axis=1)
    weight = (len(data) / (3 * y.sum(axis=0)))[y.argmax(axis=1)]
    w, b = model.model.coefficientMatrix.toArray(), model.model.interceptVector.toArray()
    z = x.to_numpy() @ w.T + b
    p = np.exp(z - z.max(axis=1, keepdims=True))
    p /= p.sum(axis=1, keepdims=True)
    gradient = ((p - y) * weight[:, None]).T @ x.to_numpy() + w
    assert np.abs(gradient).max() < 0.05


def test_loss_curve(rows):
    out = models.loss_curve(rows, COLS, LABELS, ["at", "phase"], QUICK).orderBy("iteration").collect()
    train = [r["train_loss"] for r in out]
    assert train[-1] < train[0] and all(b <= a + 1e-9 for a, b in zip(train, train[1:]))
    held = [r["validation_loss"] for r in out if r["validation_loss"] is not None]
    assert len(held) >= 3 and held[-1] < held[0]
