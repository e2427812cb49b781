import numpy as np
from helpers import weeks

from epiwave.operators import features, joins, splits
from epiwave.operators.evaluate import top_k_features
from epiwave.spec import MULTI_COUNTRY_FEATURES


def test_interpolation_matches_numpy_and_clamps(spark):
    samples = {"a": ([0, 2, 5], [10, 30, 0]), "b": ([1, 1.5, 9.25], [4, -2, 8]), "c": ([3], [7])}
    points = {k: [-1, 0, 0.25, 1, 1.5, 2, 3.999, 4, 5, 9, 9.25, 40.5] for k in samples}
    s = spark.createDataFrame([(k, float(t), float(y)) for k, (ts, ys) in samples.items() for t, y in zip(ts, ys)], "k string, t double, y double")
    q = spark.createDataFrame([(k, float(t)) for k, ts in points.items() for t in ts] + [("none", 1.0)], "k string, t double")
    rows = joins.interp_join(q, s, ["k"], "t", "y", "v").collect()
    assert len(rows) == q.count()
    for r in rows:
        expected = None if r["k"] == "none" else float(np.interp(r["t"], *samples[r["k"]]))
        assert r["v"] == expected or abs(r["v"] - expected) < 1e-12


def test_interpolation_over_long_gaps_makes_few_rows(spark):
    """Seconds with a gap of years: the segments touch at most two cells per sample."""
    ts = [0.0, 60.0, 120.0, 9e7, 9e7 + 60]
    samples = spark.createDataFrame([("a", t, t / 60) for t in ts], "k string, t double, y double")
    queries = spark.range(2000).selectExpr("'a' AS k", "id * 45000D AS t")
    out = joins.interp_join(queries, samples, ["k"], "t", "y", "v")
    assert all(abs(r["v"] - r["t"] / 60) < 1e-6 for r in out.collect())
    made = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate explode" in made


def test_value_at_offset_needs_the_exact_day(spark):
    curve = spark.createDataFrame([("a", d, float(d)) for d in (0, 1, 7, 9)], "k string, day int, v double")
    q = spark.createDataFrame([("a", 0), ("a", 1), ("a", 2), ("b", 0)], "k string, day int")
    out = {(r["k"], r["day"]): (r["v_now"], r["v_soon"]) for r in joins.join_at_offset(q, curve, ["k"], "day", "v", 7).collect()}
    assert out == {("a", 0): (0.0, 7.0), ("a", 1): (1.0, None), ("a", 2): (None, None), ("b", 0): (None, None)}


def test_lookup_defaults_and_row_bound(spark):
    facts = spark.createDataFrame([("x",), ("y",)], "k string")
    dim = spark.createDataFrame([("x", 3)], "k string, n int")
    out = joins.join_dimension(facts, dim, "k", {"n": 0}, rows=1).orderBy("k").collect()
    assert [r["n"] for r in out] == [3, 0]
    hinted = [joins.join_dimension(facts, dim, "k", rows=n)._jdf.queryExecution().logical().toString() for n in (1, 10**9, None)]
    assert ["strategy=broadcast" in text or "Hint broadcast" in text for text in hinted] == [True, False, False]


def test_row_numbers_are_global_for_any_partitioning(spark):
    frame = spark.range(0, 1000).selectExpr("(id * 7919) % 1000 AS x").repartition(7)
    numbered, total = splits.number_rows(frame, ["x"])
    assert total == 1000
    assert numbered.where("position <> x + 1").count() == 0
    empty, total = splits.number_rows(frame.where("x < 0"), ["x"])
    assert total == 0 and empty.count() == 0


def test_fraction_and_tail_splits(spark):
    frame = spark.createDataFrame([(k, w) for k, n in (("a", 10), ("b", 3), ("c", 1)) for w in weeks(n)], "k string, week date")
    per_key = {(r["k"], r["split"]): r["count"] for r in splits.split_by_fraction(frame, ["week"], ["k"]).groupBy("k", "split").count().collect()}
    assert per_key == {("a", "train"): 7, ("a", "test"): 3, ("b", "train"): 2, ("b", "test"): 1, ("c", "test"): 1}
    tail = splits.tail_holdout(frame, ["k", "week"])
    assert tail.where("part = 'fit'").count() == int(14 * 0.85)
    assert {r["k"] for r in tail.where("part = 'validation'").collect()} == {"b", "c"}
    assert "Window" not in tail._jdf.queryExecution().executedPlan().toString()


def test_a_large_table_of_leading_values_is_split_alike(spark, monkeypatch):
    frame = spark.range(60).selectExpr("CAST(id % 13 AS INT) AS k", "id AS week").repartition(5)
    few = sorted(map(tuple, splits.split_by_fraction(frame, ["k", "week"]).collect()))
    monkeypatch.setattr(splits, "COUNTED_VALUES", 3)
    assert sorted(map(tuple, splits.split_by_fraction(frame, ["k", "week"]).collect())) == few
    assert sum(r[2] == "train" for r in few) == 42
    assert splits.split_by_fraction(frame.where("k < 0"), ["k", "week"]).count() == 0


def test_date_split_with_embargo(spark):
    frame = spark.createDataFrame([(w,) for w in weeks(10)], "week date")
    train, test = splits.split_by_date(frame, "week", weeks(10)[6])
    assert (train.count(), test.count()) == (6, 4)
    train, test = splits.split_by_date(frame, "week", weeks(10)[6], embargo_days=21)
    assert (train.count(), test.count()) == (3, 4)


def test_key_codes_are_lexicographic(spark):
    frame = spark.createDataFrame([("b",), ("a",), ("c",), ("a",)], "k string")
    out = sorted((r["k"], r["country_enc"]) for r in features.encode_key(frame, "k").collect())
    assert out == [("a", 0), ("a", 0), ("b", 1), ("c", 2)]


def test_many_keys_get_the_same_codes(spark, monkeypatch):
    frame = spark.range(40).selectExpr("concat('k', id % 9) AS k")
    few = sorted(map(tuple, features.encode_key(frame, "k").collect()))
    monkeypatch.setattr(features, "BROADCAST_ROWS", 3)
    assert sorted(map(tuple, features.encode_key(frame, "k").collect())) == few


def test_standardizer_uses_population_spread_and_keeps_constants(spark):
    frame = spark.createDataFrame([(1.0, 5.0), (3.0, 5.0), (5.0, 5.0)], "x double, y double")
    scaler = features.fit_standardizer(frame, ["x", "y"])
    out = np.array([tuple(r) for r in scaler.apply(frame).orderBy("x").collect()])
    assert np.allclose(out[:, 0], np.array([-1, 0, 1]) * np.sqrt(1.5)) and (out[:, 1] == 0).all()
    shifted = scaler.apply(spark.createDataFrame([(3.0, 7.0)], "x double, y double")).first()
    assert tuple(shifted) == (0.0, 2.0)


def test_balanced_weights_sum_to_the_row_count(spark):
    frame = spark.createDataFrame([(p,) for p in "aaaaaabbc"], "phase string")
    out = features.balanced_weights(frame).collect()
    assert abs(sum(r["weight"] for r in out) - 9) < 1e-12
    assert {r["phase"]: round(r["weight"], 6) for r in out} == {"a": 0.5, "b": 1.5, "c": 3.0}


def test_scrub_and_drop(spark):
    frame = spark.createDataFrame([(1.0, 1), (float("nan"), 2), (float("-inf"), 3), (None, 4)], "x double, id int")
    assert [r["x"] for r in features.scrub(frame, ["x"]).orderBy("id").collect()] == [1.0, 0.0, 0.0, 0.0]
    assert [r["id"] for r in features.drop_incomplete(frame, ["x"]).orderBy("id").collect()] == [1, 3]


def test_top_k_and_labels(spark):
    rows = [("m", f"f{i}", float(v)) for i, v in enumerate([3, 1, 3, 2, 5, 0])]
    top = top_k_features(spark.createDataFrame(rows, "model string, feature string, importance double"), 3)
    assert [r["feature"] for r in top.orderBy("rank").collect()] == ["f4", "f0", "f2"]
    labels = MULTI_COUNTRY_FEATURES.labels()
    assert labels["cum_deaths_lag1"] == "Cumulative deaths (lag 1 wk)" and labels["cases_3w_avg"] == "3-week avg cases"
    assert len(labels) == 14
    assert MULTI_COUNTRY_FEATURES.labels("d")["new_cases_lag2"] == "New cases (lag 2 d)"


def test_interpolation_with_one_hot_key(spark):
    """Most queries fall on one key and one cell; each still meets one segment."""
    samples = spark.createDataFrame([(k, float(t), float(t * t)) for k in ("hot", "cold") for t in range(5)], "k string, t double, y double")
    queries = spark.range(20_000).selectExpr("IF(id % 10 = 0, 'cold', 'hot') AS k", "2D + (id % 4) / 4D AS t", "id")
    out = joins.interp_join(queries, samples, ["k"], "t", "y", "v")
    assert out.count() == 20_000 and out.select("id").distinct().count() == 20_000
    assert out.where("v <> 5D * (t - 2D) + 4D").count() == 0
