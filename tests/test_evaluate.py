import pytest
from helpers import label_scores
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from epiwave.operators import evaluate, report

QUIET = settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
PAIRS = st.lists(st.tuples(st.sampled_from("abcd"), st.sampled_from([*"abcd", None])), min_size=1, max_size=40)


def long(spark, truth, pred, model="m"):
    return spark.createDataFrame(
        [("A", model, "all", t, p) for t, p in zip(truth, pred)],
        "dataset string, model string, subset string, truth string, pred string",
    )


@QUIET
@given(PAIRS)
def test_metrics_match_the_plain_definition(spark, pairs):
    truth, pred = [p[0] for p in pairs], [p[1] for p in pairs]
    scores = label_scores(truth, pred)
    n = len(pairs)
    row = evaluate.summary_metrics(long(spark, truth, pred)).first()
    assert row["accuracy"] == pytest.approx(sum(t == p for t, p in pairs) / n)
    assert row["macro_f1"] == pytest.approx(sum(s[2] for s in scores.values()) / len(scores))
    assert row["weighted_f1"] == pytest.approx(sum(s[2] * s[3] for s in scores.values()) / n)
    assert evaluate.confusion(long(spark, truth, pred)).groupBy().sum("n").first()[0] == n


def report_of(spark, truth, pred, labels):
    rows = evaluate.class_report(long(spark, truth, pred), labels).collect()
    return {r["label"]: (r["precision"], r["recall"], r["f1"], r["support"]) for r in rows}


def test_report_with_a_class_that_is_never_predicted(spark):
    out = report_of(spark, "abc", "aaa", "abc")
    assert out["c"] == (0.0, 0.0, 0.0, 1)
    assert out["a"] == pytest.approx((1 / 3, 1.0, 0.5, 1))
    assert out["accuracy"] == pytest.approx((1 / 3, 1 / 3, 1 / 3, 3))
    assert out["macro avg"][2] == pytest.approx(0.5 / 3)


def test_report_lists_absent_labels_and_counts_them_in_the_macro_average(spark):
    out = report_of(spark, "aab", "aab", "abz")
    assert out["z"] == (0.0, 0.0, 0.0, 0)
    assert out["macro avg"] == pytest.approx((2 / 3, 2 / 3, 2 / 3, 3))
    assert out["weighted avg"] == pytest.approx((1, 1, 1, 3)) and "micro avg" not in out


def test_report_over_a_strict_subset_has_a_micro_average(spark):
    out = report_of(spark, "aabbcc", "aabccc", "ab")
    assert out["micro avg"] == pytest.approx((1.0, 0.75, 6 / 7, 4)) and "accuracy" not in out


def test_subsets_kinds_and_winner(spark):
    seir = long(spark, "aabb", "aaab", "SEIR")
    both = evaluate.with_subset(seir, seir["truth"] == "a", "SEIR", "TOP-3")
    rows = evaluate.union_metrics([both, long(spark, "aabb", "abab", "MLP"), long(spark, "aabb", "bbaa", "Random Forest")])
    table = evaluate.compare_models(rows)
    out = {r["model"]: r for r in table.collect()}
    assert out["SEIR (TOP-3)"]["accuracy"] == 1.0 and out["SEIR"]["accuracy"] == 0.75
    assert {m: r["type"] for m, r in out.items()} == {
        "SEIR": "Mechanistic", "SEIR (TOP-3)": "Mechanistic", "MLP": "Deep Learning", "Random Forest": "Machine Learning",
    }
    assert evaluate.best_per_group(table).first()["model"] == "SEIR (TOP-3)"
    bars = [r["model"] for r in report.metric_bars(table).orderBy("position").collect()]
    assert bars == ["SEIR", "SEIR (TOP-3)", "Random Forest", "MLP"]
    best = report.best_vs_baseline(table, {"A": "SEIR"}).first()
    assert (best["best_ml"], best["best_dl"]) == (0.0, 0.5) and best["baseline"] == out["SEIR"]["weighted_f1"]


def test_equal_scores_go_to_the_first_name(spark):
    table = spark.createDataFrame([("A", "y", 0.5), ("A", "x", 0.5), ("A", "z", 0.1)], "dataset string, model string, weighted_f1 double")
    assert evaluate.best_per_group(table).first()["model"] == "x"
