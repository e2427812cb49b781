"""Blocked windows, rank selection, candidate curves, composite keys, rejects and replaced parts against plain versions."""

import random

import pytest
from pyspark.sql import functions as F

from epiwave import sources as src
from epiwave.operators import blocked, curves, features, phases, series, splits
from epiwave.spec import FeatureSpec, SeriesSpec

SPEC = SeriesSpec()
FEATURES = FeatureSpec(encode_key=False)


def steps(spark, rng):
    """One long series and a few short ones, by day."""
    rows = [("long", d, rng.randint(0, 9), rng.randint(0, 2)) for d in range(400)]
    rows += [(f"k{k}", d * 3, rng.randint(0, 4), 0) for k in range(5) for d in range(k + 1)]
    rng.shuffle(rows)
    frame = spark.createDataFrame(rows, "country string, d int, new_cases long, new_deaths long")
    return frame.selectExpr("country", "date_add(DATE '2020-01-01', d) AS week", "new_cases", "new_deaths")


@pytest.mark.parametrize("rows", [7, 50, 1000])
def test_blocked_features_equal_the_window_form(spark, rows):
    daily = steps(spark, random.Random(rows))
    got = blocked.giant_series_features(daily, SPEC, FEATURES, rows=rows)
    w = series.over(SPEC, "week", ("UNBOUNDED PRECEDING", "CURRENT ROW"))
    levels = daily.selectExpr("country", "week", f"sum(new_cases) {w} AS cum_cases", f"sum(new_deaths) {w} AS cum_deaths")
    plain = series.window_features(phases.label_phases(series.increments(levels, SPEC.with_(time="week")), SPEC), SPEC, FEATURES)
    cols = plain.columns
    want = {(r["country"], r["week"]): tuple(r) for r in plain.collect()}
    mine = {(r["country"], r["week"]): tuple(r) for r in got.select(*cols).collect()}
    assert mine == want


def test_a_task_holds_one_block(spark):
    rows = blocked.in_blocks(steps(spark, random.Random(1)), ["country", "week"], 60)
    spec = SPEC.with_(time="week")
    out = blocked.blocked(rows, spec, lambda df, s: df.withColumns({"before": F.expr(f"lag(new_cases, 2) {series.over(s)}"), "part": F.spark_partition_id()}), 2, 0, rows=60)
    per_task = [r["n"] for r in out.groupBy("part").agg(F.count_distinct("_block").alias("n")).collect()]
    assert max(per_task) == 1 and len(per_task) == -(-415 // 60)
    with pytest.raises(ValueError):
        blocked.with_halo(rows, 61, 0, 60)


def test_blocked_features_of_an_empty_table(spark):
    assert blocked.giant_series_features(steps(spark, random.Random(1)).limit(0), SPEC, FEATURES).collect() == []


def test_running_and_known_values(spark):
    rng = random.Random(4)
    rows = [(rng.choice("ab"), t, rng.choice([None, None, 1, 2, 3])) for t in range(200)]
    frame = spark.createDataFrame(rows, "k string, t int, v long")
    placed = blocked.in_blocks(frame, ["k", "t"], 9)
    out = blocked.last_known(blocked.running_sums(placed, ["k"], {"total": "v"}), ["k"], {"back": "v"})
    out = blocked.last_known(out, ["k"], {"ahead": "v"}, backward=True)
    got = {(r.k, r.t): (r.total, r.back, r.ahead) for r in out.collect()}
    for k in "ab":
        mine = sorted((t, v) for key, t, v in rows if key == k)
        for i, (t, _) in enumerate(mine):
            known = [v for _, v in mine[: i + 1] if v is not None]
            later = [v for _, v in mine[i:] if v is not None]
            assert got[k, t] == (sum(known), known[-1] if known else None, later[0] if later else None)


def test_asof_and_interpolation_with_a_hot_key(spark):
    rng = random.Random(6)
    queries = [(n, rng.choice(["hot"] * 8 + ["b", "none", None]), rng.choice([None, *range(-5, 300)])) for n in range(500)]
    samples = [("hot", t, rng.choice([None, 1.5, 4.0])) for t in rng.sample(range(0, 290), 120)] + [("b", 7, 2.0), (None, 3, 9.0), ("b", None, 8.0)]
    q = spark.createDataFrame(queries, "n int, k string, t int")
    s = spark.createDataFrame(samples, "k string, t int, y double")
    asof = {r.n: r.y for r in blocked.asof_join(q, s, ["k"], "t", ["y"], rows=40).collect()}
    line = {r.n: r.v for r in blocked.interp_long(q, s, ["k"], "t", "y", "v", rows=40).collect()}
    assert asof.keys() == line.keys() == {n for n, _, _ in queries}
    for n, k, t in queries:
        mine = sorted((u, y) for key, u, y in samples if key == k and k is not None and u is not None)
        before = [y for u, y in mine if t is not None and u <= t]
        assert asof[n] == (before[-1] if before else None)
        known = [(u, y) for u, y in mine if y is not None]
        if t is None or not known:
            assert line[n] is None
            continue
        low, high = [p for p in known if p[0] <= t], [p for p in known if p[0] > t]
        if not low or not high:
            assert line[n] == (high[0][1] if high else low[-1][1])
        else:
            (a, b), (c, d) = low[-1], high[0]
            assert line[n] == pytest.approx(b + (d - b) * (t - a) / (c - a))


@pytest.mark.parametrize("counted, ranges", [(100_000, 200), (3, 4), (1, 2)])
def test_rank_selection_in_one_leading_value(spark, monkeypatch, counted, ranges):
    monkeypatch.setattr(splits, "COUNTED_VALUES", counted)
    monkeypatch.setattr(splits, "RANGES", ranges)
    rng = random.Random(2)
    rows = [("all", rng.choice([None, *range(40)]), rng.choice("xyz") + str(rng.randint(0, 30)), n) for n in range(300)]
    frame = spark.createDataFrame(rows, "lead string, day int, name string, n int")
    ordered = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3]))
    for rank in (1, 77, 300):
        found = splits.row_at_rank(frame, ["lead", "day", "name", "n"], rank)
        assert tuple(found.values()) == ordered[rank - 1]
    assert splits.row_at_rank(frame, ["lead"], 0) is None
    train = splits.split_by_fraction(frame, ["lead", "day", "name", "n"]).where("split = 'train'")
    assert sorted(r.n for r in train.collect()) == sorted(r[3] for r in ordered[:210])


def test_best_candidate_breaks_ties_by_name_and_wants_all_days(spark):
    observed = spark.createDataFrame([("a", d, float(d)) for d in range(4)] + [("b", 0, 1.0), ("b", 1, None)], "k string, day int, observed double")
    lines = [("a", "late", d, float(d)) for d in range(2)] + [("a", n, d, d + 1.0) for n in ("two", "one") for d in range(4)]
    lines += [("a", "worse", d, d + 2.0) for d in range(4)] + [("b", "x", 0, 3.0), ("b", "x", 1, 3.0), ("c", "x", 0, 3.0), ("a", "gone", 9, 1.0)]
    candidates = spark.createDataFrame(lines, "k string, candidate string, day int, modelled double")
    errors = curves.candidate_errors(observed, candidates, ["k"])
    assert {(r.k, r.candidate): (r.n_days, r.sse) for r in errors.collect()} == {
        ("a", "late"): (2, 0.0), ("a", "one"): (4, 4.0), ("a", "two"): (4, 4.0), ("a", "worse"): (4, 16.0), ("b", "x"): (1, 4.0),
    }
    best = {r.k: (r.candidate, r.n_days, r.sse, r.n_candidates) for r in curves.best_candidate(errors, ["k"]).collect()}
    assert best == {"a": ("one", 4, 4.0, 4), "b": ("x", 1, 4.0, 1)}


@pytest.mark.parametrize("limit", [100_000, 2])
def test_composite_keys_have_dense_codes(spark, monkeypatch, limit):
    monkeypatch.setattr(features, "BROADCAST_ROWS", limit)
    rows = [("r1", "b"), ("r1", "a"), ("r2", "a"), ("r1", "a"), (None, "a"), ("r2", None)]
    out = features.encode_key(spark.createDataFrame(rows, "region string, nation string"), ["region", "nation"], "code")
    want = {("r1", "a"): 0, ("r1", "b"): 1, ("r2", "a"): 2}
    got = out.collect()
    assert len(got) == len(rows) and all(r.code == want.get((r.region, r.nation)) for r in got)


def test_rejects_keep_their_text_and_reason(spark, tmp_path):
    lines = ["Date,place,n", "1/2/2020,a,1", '1/3/2020,"b, c",2', "1/4/2020,d", "1/5/2020,e,3,4", '"1/6/2020,f,5', "soon,g,6"]
    (tmp_path / "r.csv").write_text("\n".join(lines) + "\n")
    good, bad = src.read_with_rejects(spark, str(tmp_path / "r.csv"), ["Date", "place", "n"])
    assert sorted((str(r.Date), r.place, r.n) for r in good.collect()) == [("2020-01-02", "a", "1"), ("2020-01-03", "b, c", "2"), ("None", "g", "6")]
    assert sorted((r.record, r.reason, r.n_read, r.file) for r in bad.collect()) == [
        ('"1/6/2020,f,5', "quotes", 1, "r.csv"), ("1/4/2020,d", "short", 2, "r.csv"), ("1/5/2020,e,3,4", "long", 3, "r.csv"),
    ]


def test_parts_are_replaced_alone_and_repeatably(spark, tmp_path):
    path = str(tmp_path / "parts")
    frame = lambda *rows: spark.createDataFrame(list(rows), "dataset string, n int")
    read = lambda: sorted((r.dataset, r.n) for r in spark.read.parquet(path).collect())
    src.overwrite_parts(frame(("A", 1), ("A", 2), ("B", 3)), path, ["dataset"])
    for _ in range(2):
        src.overwrite_parts(frame(("A", 9)), path, ["dataset"])
        assert read() == [("A", 9), ("B", 3)]
    src.overwrite_parts(frame(("C", 4)).limit(0), path, ["dataset"])
    assert read() == [("A", 9), ("B", 3)]
