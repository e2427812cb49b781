from helpers import weeks

from epiwave.operators import curves
from epiwave.operators.phases import phase_from_curve
from epiwave.spec import SeriesSpec


def test_observed_curve_fills_silent_days_and_keeps_its_span(spark):
    start = weeks(1)[0]
    counts = spark.createDataFrame([("a", start, 3), ("a", weeks(2)[1], 5), ("b", start, 9)], "country string, date date, cases int")
    spans = spark.createDataFrame([("a", start, weeks(2)[1]), ("c", start, start), ("d", weeks(2)[1], start)], "country string, t0 date, t_end date")
    out = curves.observed_curve(counts, spans, ["country"], "date", "cases")
    got = {(r.country, r.day): r.infectious for r in out.collect()}
    assert got == {("a", k): {0: 3.0, 7: 5.0}.get(k, 0.0) for k in range(8)} | {("c", 0): 0.0}
    total = {(r.country, r.day): r.modelled for r in curves.cumulative_curve(out, ["country"]).collect()}
    assert total["a", 6] == 3.0 and total["a", 7] == 8.0


def test_fit_against_reports(spark):
    days = weeks(3)
    weekly = spark.createDataFrame([("a", w, c) for w, c in zip(days, (4, 6, 9))], "country string, week date, cum_cases long")
    starts = spark.createDataFrame([("a", days[0])], "country string, t0 date")
    curve = spark.createDataFrame([("a", 0, 5.0), ("a", 7, 6.0), ("a", 21, 1.0)], "country string, day int, modelled double")
    pairs = curves.fit_vs_observed(weekly, starts, curve, SeriesSpec())
    assert sorted((r.day, r.observed, r.modelled) for r in pairs.collect()) == [(0, 4.0, 5.0), (7, 6.0, 6.0)]
    assert curves.sum_squared_error(pairs, ["country"]).first()["sse"] == 1.0


def test_a_curve_keeps_its_last_value_and_gaps_give_no_phase(spark):
    days = weeks(8)
    rows = spark.createDataFrame([("a", d) for d in days], "country string, week date")
    levels = {0: 50.0, 7: 50.0, 14: 80.0, 16: 20.0}
    curve = spark.createDataFrame([("a", k, v) for k, v in levels.items()], "country string, day int, infectious double")
    params = spark.createDataFrame([("a", days[0], 1_000_000.0)], "country string, t0 date, population double")
    out = [r["curve_phase"] for r in phase_from_curve(rows, curve, params, ["country"], "week").orderBy("week").collect()]
    assert out == ["Stable/Peak", "Growing", "Declining"] + ["Stable/Peak"] * 5
    gap = curve.where("day <> 7")
    assert phase_from_curve(rows, gap, params, ["country"], "week").orderBy("week").first()["curve_phase"] is None


def test_curve_phases_and_guards(spark):
    days = weeks(5)
    rows = spark.createDataFrame([("a", d) for d in days] + [("b", days[0])], "country string, week date")
    levels = {0: 5.0, 7: 50.0, 14: 80.0, 21: 85.0, 28: 40.0, 35: 10.0}
    curve = spark.createDataFrame([("a", k, v) for k, v in levels.items()], "country string, day int, infectious double")
    params = spark.createDataFrame([("a", days[0], 1_000_000.0)], "country string, t0 date, population double")
    out = {(r["country"], r["week"]): r["curve_phase"] for r in phase_from_curve(rows, curve, params, ["country"], "week").collect()}
    assert [out["a", d] for d in days] == ["Contained", "Growing", "Stable/Peak", "Declining", "Declining"]
    assert out["b", days[0]] == "Contained"
    early = spark.createDataFrame([("a", days[2], 1.0)], "country string, t0 date, population double")
    before = phase_from_curve(rows, curve, early, ["country"], "week").where("country = 'a'").orderBy("week").first()
    assert before["curve_phase"] == "Contained"
