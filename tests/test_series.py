import datetime

import duckdb
import pandas as pd
import pytest
from helpers import MONDAY, daily_cases, weekly_rows, weeks
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from epiwave.functions import columns
from epiwave.operators import series
from epiwave.operators.phases import label_phases
from epiwave.plans.plain_sql import CTES
from epiwave.spec import MULTI_COUNTRY_FEATURES, SeriesSpec

SPEC = SeriesSpec()
QUIET = settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


def daily(spark, rows):
    return spark.createDataFrame(rows, "country string, date date, cum_cases long, cum_deaths long")


def day(n):
    return MONDAY + datetime.timedelta(days=n)


def weekly(spark, rows):
    return spark.createDataFrame(rows, "country string, week date, new_cases long")


def ordered(df, *cols, by="week"):
    return [tuple(r) if len(cols) > 1 else r[0] for r in df.orderBy("country", by).select(*cols).collect()]


def test_increments_start_at_zero_and_clip_only_the_listed_counters(spark):
    rows = [("a", day(i), c, d) for i, (c, d) in enumerate([(5, 4), (8, 6), (6, 3), (9, 5)])] + [("b", day(0), 70, 7)]
    out = series.increments(daily(spark, rows), SPEC)
    assert ordered(out, "new_cases", "new_deaths", by="date") == [(0, 0), (3, 2), (0, -3), (3, 2), (0, 0)]


@pytest.mark.parametrize("fill, expected", [("zero", [0, 0, 9]), ("carry", [0, 0, 4])])
def test_missing_counts_are_zero_or_carried(spark, fill, expected):
    rows = daily(spark, [("a", day(0), 5, 0), ("a", day(1), None, None), ("a", day(2), 9, 0)])
    assert ordered(series.daily_table(rows, SPEC.with_(fill=fill)), "new_cases", by="date") == expected


def test_duplicate_reports_are_summed_after_truncation(spark):
    rows = spark.createDataFrame(
        [("a", day(0), 1.9, 1.0), ("a", day(0), 2.9, None), ("a", day(1), 7.0, 1.0)],
        "country string, date date, cum_cases double, cum_deaths double",
    )
    assert ordered(series.daily_table(rows, SPEC), "cum_cases", "cum_deaths", by="date") == [(3, 1), (7, 1)]


def test_fatality_rounds_the_scaled_double_half_even(spark):
    rows = [("a", day(i), 4000, d) for i, d in enumerate([23, 49, 87])] + [("a", day(3), 0, 0)]
    out = ordered(series.daily_table(daily(spark, rows), SPEC), "cfr", by="date")
    assert out == [0.57, 1.23, 2.17, 0.0]


def test_rollup_uses_monday_weeks_and_last_known_gauges(spark):
    spec = SPEC.with_(gauges=("beds",))
    sunday, monday = datetime.date(2014, 9, 7), datetime.date(2014, 9, 8)
    rows = [("a", sunday, 3, 0, 2, 2), ("a", monday, 5, 0, 2, 4), ("a", monday + datetime.timedelta(days=1), 9, 1, 4, None)]
    frame = spark.createDataFrame(rows, "country string, date date, cum_cases long, cum_deaths long, new_cases long, beds long")
    frame = frame.selectExpr("*", "0L AS new_deaths", "1D AS cfr")
    out = series.rollup(frame, spec)
    assert ordered(out, "week", "cum_cases", "new_cases", "beds") == [
        (datetime.date(2014, 9, 1), 3, 2, 2),
        (monday, 9, 6, 4),
    ]


def test_gaps_are_skipped_or_filled(spark):
    rows = daily(spark, [("a", day(0), 2, 0), ("a", day(7), 5, 0), ("a", day(28), 9, 0), ("b", day(0), 1, 0)])
    assert ordered(series.weekly_table(rows, SPEC), "new_cases") == [0, 3, 4, 0]
    filled = series.weekly_table(rows, SPEC.with_(gaps="fill"))
    assert ordered(filled, "cum_cases", "new_cases") == [(2, 0), (5, 3), (5, 0), (5, 0), (9, 4), (1, 0)]


def test_trailing_mean_excludes_the_current_row(spark):
    frame = weekly(spark, weekly_rows("a", [2, 4, 6, 8, 10]))
    out = frame.withColumns(columns({"m": series.trailing_mean("new_cases", 3, SPEC)}))
    assert ordered(out, "m") == [None, 2, 3, 4, 6]


def test_growth_rate_is_null_on_zero_level_and_clamped(spark):
    rows = [("a", w, n, c) for w, n, c in zip(weeks(5), [0, 90, 8, 2, 1], [0, 10, 10, 20, 20])]
    frame = spark.createDataFrame(rows, "country string, week date, new_cases long, cum_cases long")
    out = frame.withColumns(columns({"g": series.growth_rate("new_cases", "cum_cases", 5.0, SPEC)}))
    assert ordered(out, "g") == [None, None, None, 0.8, 0.2]
    small = frame.withColumns(columns({"g": series.growth_rate("new_cases", "cum_cases", 0.5, SPEC)}))
    assert ordered(small, "g")[3:] == [0.5, 0.2]


def test_features_look_back_only(spark):
    rows = [("a", w, n, n // 2, 10 * i + 5, 5 * i + 5) for i, (w, n) in enumerate(zip(weeks(6), [4, 6, 8, 2, 7, 9]))]
    schema = "country string, week date, new_cases long, new_deaths long, cum_cases long, cum_deaths long"
    names = [c for c in MULTI_COUNTRY_FEATURES.columns() if c != "country_enc"]

    def matrix(r):
        return ordered(series.window_features(spark.createDataFrame(r, schema), SPEC, MULTI_COUNTRY_FEATURES), *names)

    changed = [*rows[:-1], ("a", rows[-1][1], 999, 999, 9999, 9999)]
    assert matrix(rows) == matrix(changed)
    assert [r[0] for r in matrix(rows)] == [0, 7, 14, 21, 28, 35]


def test_initial_value_seeds(spark):
    rows = [("a", w, c) for w, c in zip(weeks(3), [0, 4, 6])] + [("b", w, c) for w, c in zip(weeks(2), [3, 4])]
    frame = spark.createDataFrame(rows, "country string, week date, cum_cases long")
    out = ordered(series.initial_value(frame, SPEC), "y0", "t_max", "e0", "i0", by="t0")
    assert out == [(0.0, 14, 1.0, 1.0), (3.0, 7, 6.0, 3.0)]


@pytest.mark.parametrize("values, expected", [
    ([0, 0, 5, 10, 4, 1, 0, 0, 0], ["Growing"] * 3 + ["Declining"] * 3 + ["Contained"] * 3),
    ([4, 4, 4, 4, 4], ["Stable/Peak"] * 4 + ["Contained"]),
    ([7], ["Contained"]),
    ([], []),
])
def test_phase_rule_by_hand(spark, values, expected):
    assert ordered(label_phases(weekly(spark, weekly_rows("a", values)), SPEC), "phase") == expected


@QUIET
@given(st.lists(st.lists(st.integers(0, 30), min_size=1, max_size=12), min_size=1, max_size=4))
def test_phases_match_the_plain_rule_whatever_the_partitioning(spark, many):
    rows = [r for i, values in enumerate(many) for r in weekly_rows(f"k{i}", values)]
    con = duckdb.connect()
    con.register("given", pd.DataFrame(rows, columns=["country", "week", "new_cases"]))
    statement = f"WITH wk_a AS (SELECT * FROM given) SELECT phase FROM ({CTES['ph_a']}) ORDER BY country, week"
    expected = [r[0] for r in con.execute(statement).fetchall()]
    shuffled = weekly(spark, rows[::-1]).repartition(3)
    assert ordered(label_phases(shuffled, SPEC), "phase") == expected


@QUIET
@given(st.lists(st.integers(0, 50), min_size=1, max_size=15))
def test_increments_of_a_growing_series_add_up(spark, steps):
    levels = [sum(steps[: i + 1]) for i in range(len(steps))]
    out = series.increments(daily(spark, [("a", day(i), x, x) for i, x in enumerate(levels)]), SPEC)
    assert out.groupBy().sum("new_cases").first()[0] == levels[-1] - levels[0]


# Worked from the daily counts above: new cases and phases of the 13 weeks.
ZERO = [0, 354, 290, 642, 62, 923, 567, 673, 102, 129, 173, 199, 91]
CARRY = [0, 44, 79, 69, 62, 74, 67, 133, 102, 129, 173, 199, 91]
G, S, D, C = "Growing", "Stable/Peak", "Declining", "Contained"


@pytest.mark.parametrize("fill, new_cases, labels", [
    ("zero", ZERO, [G, G, G, S, G, S, D, D, D, D, S, D, C]),
    ("carry", CARRY, [G, G, G, S, G, G, G, G, G, G, S, D, C]),
])
def test_single_country_weeks(spark, fill, new_cases, labels):
    rows = daily(spark, [("a", d, c, 0) for d, c in daily_cases()])
    out = label_phases(series.weekly_table(rows, SPEC.with_(fill=fill)), SPEC)
    assert ordered(out, "new_cases") == new_cases
    assert ordered(out, "phase") == labels


def test_carried_gauges_huge_numbers_grain_and_one_counter(spark):
    spec = SeriesSpec(time="at", bucket="day", cumulative=("cum seen",), gauges=("in care",), clip_negative=("cum seen",), fill="carry", grain="hour")
    stamps = [datetime.datetime(2020, 1, 6, h, m) for h, m in ((1, 0), (1, 30), (2, 0))] + [datetime.datetime(2020, 1, 7, 5, 0)]
    rows = [("a", stamps[0], 1.0, 4.0), ("a", stamps[1], 1.0, 3.0), ("a", stamps[2], 1e300, None), ("a", stamps[3], 9.0, None)]
    frame = spark.createDataFrame(rows, "country string, at timestamp, `cum seen` double, `in care` double")
    out = series.weekly_table(frame, spec).orderBy("week").collect()
    assert [(r["cum seen"], r["in care"], r["cfr"]) for r in out] == [(2, 7, None), (9, 7, None)]
