"""Physical plans: shuffle counts, pruned scans, no Python."""

import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from epiwave.operators.features import feature_table
from epiwave.operators.phases import label_phases
from epiwave.operators.series import daily_table, weekly_table, window_features
from epiwave.plans import catalog
from epiwave.plans import testbed as tb
from epiwave.spec import MULTI_COUNTRY_FEATURES, SeriesSpec

SPEC = SeriesSpec()
SMALL = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def reports(spark, tmp_path):
    path = str(tmp_path / "reports")
    rows = spark.range(1000).selectExpr(
        "concat('k', id % 7) AS country", "date_add(DATE '2020-01-01', CAST(id / 7 AS INT)) AS date",
        "id AS cum_cases", "id AS cum_deaths", "'unused' AS note",
    )
    rows.write.parquet(path)
    return spark.read.parquet(path)


def test_reports_to_features_take_two_shuffles_and_no_python(reports):
    weekly = weekly_table(reports, SPEC)
    text = plan(window_features(label_phases(weekly, SPEC), SPEC, MULTI_COUNTRY_FEATURES))
    assert text.count("Exchange hashpartitioning") == 2
    assert "partial_sum" in text and "Python" not in text and "SortMergeJoin" not in text
    assert "note" not in re.search(r"FileScan.*", text).group(0)


def test_key_filter_reaches_the_scan(reports):
    text = plan(label_phases(weekly_table(reports, SPEC), SPEC).where("country = 'k1'"))
    assert "EqualTo(country,k1)" in text


def test_small_code_table_is_broadcast(reports):
    text = plan(feature_table(weekly_table(reports, SPEC), SPEC, MULTI_COUNTRY_FEATURES))
    assert "BroadcastHashJoin" in text and "SortMergeJoin" not in text


def test_top_k_limits_before_the_shuffle(spark):
    from epiwave.operators.evaluate import top_k_features

    frame = spark.range(100).selectExpr("concat('m', id % 2) AS model", "concat('f', id) AS feature", "id * 1D AS importance")
    assert plan(top_k_features(frame)).count("WindowGroupLimit") == 2


def test_feature_rows_do_not_depend_on_order_or_partitioning(reports):
    def rows(df):
        return sorted(map(tuple, window_features(weekly_table(df, SPEC), SPEC, MULTI_COUNTRY_FEATURES).collect()), key=str)

    assert rows(reports) == rows(reports.orderBy("cum_cases", ascending=False).repartition(11))


def test_one_hot_key_gives_the_same_result(spark):
    """A third of the rows on one key and day: they meet already summed."""
    frame = spark.range(30_000).selectExpr(
        "IF(id % 3 = 0, 'hot', concat('k', id % 50)) AS country",
        "IF(id % 3 = 0, DATE '2020-01-06', date_add(DATE '2020-01-01', CAST(id % 90 AS INT))) AS date",
        "1L AS cum_cases", "0L AS cum_deaths",
    )
    out = weekly_table(frame, SPEC).where("country = 'hot'").collect()
    assert [(str(r["week"]), r["cum_cases"]) for r in out] == [("2020-01-06", 10_000)]


def test_tasks_of_many_series_hold_few_rows_and_whole_series(spark, tmp_path):
    spark.range(4000).selectExpr(
        "IF(id % 201 = 200, NULL, id % 201) AS l_suppkey", "CAST(date_add(DATE '2020-01-01', CAST(id / 201 AS INT)) AS TIMESTAMP_NTZ) AS l_shipdate",
        "IF(id % 3 = 0, 'R', 'N') AS l_returnflag",
    ).write.parquet(str(tmp_path / "lineitem.parquet"))
    dealt, whole = (tb.supplier_reports(spark, str(tmp_path), rows=n) for n in (400, 10**9))
    tasks = daily_table(dealt, tb.SUPPLIERS).groupBy(F.spark_partition_id()).agg(F.count("*"), F.collect_set("country")).collect()
    assert max(n for _, n, _ in tasks) <= 1000 and sum(n for _, n, _ in tasks) > 3900
    assert sum(len(keys) for _, _, keys in tasks) == 200
    text = plan(label_phases(weekly_table(dealt, tb.SUPPLIERS), tb.SUPPLIERS))
    assert text.count("Exchange hashpartitioning") == 1
    rows = [sorted(map(tuple, label_phases(weekly_table(x, tb.SUPPLIERS), tb.SUPPLIERS).collect()), key=str) for x in (dealt, whole)]
    assert rows[0] == rows[1] and len(rows[0]) > 200


def test_entry_and_registry(spark):
    frame = entry.entry(spark)
    assert frame.columns == ["phase", "n_weeks"] and frame.count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


CHECKED = (
    "ingest_reports read_reports fill_zero_int case_fatality select_features scaled_code join_at_offset interp_join "
    "weekly_rollup weekly_rollup_gauges weekly_rollup_carry weekly_rollup_filled last_in_bucket increments_single growth_rate "
    "tail_holdout split_by_fraction label_phases phase_curve_full standardize balanced_weights class_report "
    "class_report_partial compare_models timeline timeline_gauges select_features_gauges standardize_gauges clip_lower phase_from_curve phase_guard "
    "observed_curve sum_squared_error best_vs_baseline encode_labels predict train_lr coefficients"
).split()


@pytest.fixture(scope="module")
def duck():
    from oracle_check import connect

    return connect(SMALL)


@pytest.mark.parametrize("name", CHECKED)
def test_query_equals_its_statement(spark, duck, name):
    from oracle_check import compare

    assert compare(spark, duck, name, catalog.QUERIES[name], catalog.ORACLES[name], SMALL).startswith("ok")
