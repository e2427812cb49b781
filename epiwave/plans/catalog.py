"""The registered queries: every operator on whole tables, with its plain-SQL statement where one exists."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import functions as fn
from .. import sources as src
from ..operators import curves, evaluate, features, joins, models, phases, report, series, splits
from ..session import cut_lineage, scratch_path
from ..spec import MULTI_COUNTRY_FEATURES, PHASE_ORDER, PHASES
from . import pipelines
from . import testbed as tb
from .plain_sql import DAY, WEEK, sql

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

FEATURES = MULTI_COUNTRY_FEATURES.columns()
NAIVE_KINDS = {"SEIR": "Mechanistic", "Persistence": "Naive", "Majority": "Naive"}
EVENT_FEATURES = tb.EVENT_FEATURES.columns()


def query(name: str, body: str | None = None):
    def register(f):
        QUERIES[name] = f
        if body is not None:
            ORACLES[name] = sql(body)
        return f

    return register


HOUR = "date_format(date, 'yyyy-MM-dd HH:mm:ss')"


def rounded(cols, digits: int = 6):
    return [F.expr(f"round(CAST({c} AS DOUBLE), {digits}) AS {c}") for c in cols]


def rounded_sql(cols, digits: int = 6) -> str:
    return ", ".join(f"round(CAST({c} AS DOUBLE), {digits}) AS {c}" for c in cols)


# ------------------------------------------------------- sources and schema


@query("ingest_reports", """
    SELECT country, CAST(date AS DATE) AS day, count(*) AS n_reports,
           count(*) FILTER (WHERE cum_cases = 0) AS n_silent,
           CAST(sum(cum_cases) AS BIGINT) AS cum_cases, CAST(sum(cum_deaths) AS BIGINT) AS cum_deaths,
           CAST(sum(survivors) AS BIGINT) AS survivors, CAST(sum(probable) AS BIGINT) AS probable,
           CAST(sum(suspected) AS BIGINT) AS suspected, CAST(sum(in_treatment) AS BIGINT) AS in_treatment
    FROM rep_b GROUP BY country, CAST(date AS DATE)""")
def ingest_reports(spark, d):
    padded = tb.event_text_reports(spark, d).withColumnsRenamed({c: f" {c} " for c in tb.COUNTERS})
    named = src.rename_map(src.trim_headers(padded), {"country": "place"})
    typed = src.fill_zero_int(src.coerce_numeric(named, tb.COUNTERS), tb.COUNTERS)
    return typed.groupBy(F.col("place").alias("country"), F.col("date").cast("date").alias("day")).agg(
        F.count(F.lit(1)).alias("n_reports"), F.count_if(F.col("cum_cases") == 0).alias("n_silent"),
        *[F.sum(c).alias(c) for c in tb.COUNTERS],
    )


def _order_csv(spark, d) -> str:
    """Reports written as CSV: American dates, quoted notes with commas, padded header names."""
    note = F.format_string('cases: %d, deaths: "%d"', "cum_cases", "cum_deaths")
    text = tb.order_reports(spark, d).select(
        "country", F.date_format("date", "M/d/yyyy").alias("Date"), "cum_cases", "cum_deaths", note.alias(" notes "),
    )
    path = scratch_path(spark, "reports")
    src.write_result(text, path, fmt="csv")
    return path


REPORTS_SQL = """
    SELECT country, date, cum_cases, cum_deaths,
           'cases: ' || CAST(cum_cases AS VARCHAR) || ', deaths: "' || CAST(cum_deaths AS VARCHAR) || '"' AS notes
    FROM rep_a"""


@query("read_reports", REPORTS_SQL)
def read_reports(spark, d):
    raw = src.read_reports(spark, _order_csv(spark, d), ["country", "Date", "cum_cases", "cum_deaths", " notes "])
    typed = src.fill_zero_int(src.coerce_numeric(src.trim_headers(raw), ["cum_cases", "cum_deaths"]), ["cum_cases", "cum_deaths"])
    return typed.withColumnRenamed("Date", "date")


@query("rename_positional", "SELECT country AS place, date AS day, cum_cases AS total, cum_deaths AS dead FROM rep_a")
def rename_positional(spark, d):
    return src.rename_positional(tb.order_reports(spark, d), ["place", "day", "total", "dead"])


@query("trim_headers", "SELECT country, date, cum_cases, cum_deaths FROM rep_a")
def trim_headers(spark, d):
    return src.trim_headers(tb.order_reports(spark, d).toDF(" country", "date ", " cum_cases ", "cum_deaths"))


@query("rename_map", "SELECT country AS place, date, cum_cases AS confirmed, cum_deaths FROM rep_a")
def rename_map(spark, d):
    return src.rename_map(tb.order_reports(spark, d), {"country": "place", "cum_cases": "confirmed"})


@query("coerce_numeric", """
    SELECT country, CAST(date AS VARCHAR) AS hour, cum_cases, cum_deaths, survivors, probable, suspected, in_treatment FROM num_b""")
def coerce_numeric(spark, d):
    return tb.event_reports(spark, d).selectExpr("country", f"{HOUR} AS hour", *tb.COUNTERS)


@query("fill_zero_int", """
    SELECT country, CAST(date AS VARCHAR) AS hour, cum_cases, cum_deaths, survivors, probable, suspected, in_treatment FROM rep_b""")
def fill_zero_int(spark, d):
    typed = src.fill_zero_int(tb.event_reports(spark, d), tb.COUNTERS)
    return typed.selectExpr("country", f"{HOUR} AS hour", *tb.COUNTERS)


@query("dimension_table", """
    SELECT country, week, phase, CASE phase WHEN 'Growing' THEN 0 WHEN 'Stable/Peak' THEN 1 WHEN 'Declining' THEN 2 ELSE 3 END AS code
    FROM ph_a""")
def dimension_table(spark, d):
    dim = src.dimension_table(spark, {p: i for i, p in enumerate(PHASE_ORDER)}, ["phase", "code"])
    rows = phases.label_phases(tb.order_weekly(spark, d), tb.ORDERS).select("country", "week", "phase")
    return joins.join_dimension(rows, dim.withColumn("code", F.col("code").cast("int")), "phase", rows=len(PHASE_ORDER))


@query("write_result", "SELECT country, week, phase, new_cases FROM ph_a")
def write_result(spark, d):
    path = scratch_path(spark, "phases")
    labelled = phases.label_phases(tb.order_weekly(spark, d), tb.ORDERS).select("country", "week", "phase", "new_cases")
    src.write_result(labelled, path, by=["phase"])
    return spark.read.parquet(path)


# ------------------------------------------------- projections and predicates


@query("case_fatality", "SELECT country, date, cfr FROM inc_a")
def case_fatality(spark, d):
    return tb.order_reports(spark, d).selectExpr("country", "date", f"{fn.case_fatality('cum_cases', 'cum_deaths')} AS cfr")


@query("clip_lower", f"""
    SELECT country, CAST(date AS VARCHAR) AS hour, raw, CASE WHEN raw IS NOT NULL THEN greatest(raw, 0) END AS clipped
    FROM (SELECT country, date, cum_cases - lag(cum_cases) OVER ({DAY}) AS raw FROM rep_b)""")
def clip_lower(spark, d):
    typed = src.fill_zero_int(tb.event_reports(spark, d), ["cum_cases"])
    steps = typed.selectExpr("*", f"cum_cases - lag(cum_cases) {series.over(tb.EVENTS)} AS raw")
    return steps.selectExpr("country", f"{HOUR} AS hour", "raw", f"{fn.clip_lower('raw')} AS clipped")


@query("clip_range", f"""
    SELECT country, week, change, CASE WHEN change IS NOT NULL THEN greatest(least(change, 2), -2) END AS clipped
    FROM (SELECT country, week, new_cases - lag(new_cases) OVER ({WEEK}) AS change FROM wk_a)""")
def clip_range(spark, d):
    rows = tb.order_weekly(spark, d).selectExpr("*", f"new_cases - lag(new_cases) {series.over(tb.ORDERS, 'week')} AS change")
    return rows.selectExpr("country", "week", "change", f"{fn.clip_range('change', '-2', '2')} AS clipped")


@query("null_if_zero", "SELECT country, week, nullif(new_deaths, 0) AS deaths, round(new_cases / nullif(new_deaths, 0), 6) AS per_death FROM wk_a")
def null_if_zero(spark, d):
    return tb.order_weekly(spark, d).selectExpr(
        "country", "week", f"{fn.null_if_zero('new_deaths')} AS deaths", f"round({fn.ratio('new_cases', 'new_deaths')}, 6) AS per_death"
    )


@query("scrub_nonfinite", """
    SELECT country, week, round(coalesce(CASE WHEN new_deaths > 0 THEN ln(new_deaths) END, 0.0), 6) AS log_deaths FROM wk_a""")
def scrub_nonfinite(spark, d):
    # 0 gives minus infinity here, which the operator turns into a missing value and then into 0.
    raw = F.when(F.col("new_deaths") > 0, F.ln("new_deaths")).otherwise(F.lit(float("-inf")))
    rows = features.scrub(tb.order_weekly(spark, d).withColumn("log_deaths", raw), ["log_deaths"])
    return rows.select("country", "week", *rounded(["log_deaths"]))


@query("drop_incomplete", "SELECT country, week, case_growth_rate IS NOT NULL AS kept FROM feat_a WHERE new_cases_lag3 IS NOT NULL AND case_growth_rate IS NOT NULL AND death_growth_rate IS NOT NULL")
def drop_incomplete(spark, d):
    table = series.window_features(tb.order_weekly(spark, d), tb.ORDERS, MULTI_COUNTRY_FEATURES)
    cols = [c for c in FEATURES if c != "country_enc"]
    return features.drop_incomplete(table, cols).select("country", "week", F.col("case_growth_rate").isNotNull().alias("kept"))


@query("filter_key", "SELECT country, week, cum_cases, new_cases FROM wk_a WHERE country = 'NATION_7'")
def filter_key(spark, d):
    return tb.order_weekly(spark, d).where(F.col("country") == "NATION_7").select("country", "week", "cum_cases", "new_cases")


@query("filter_in", "SELECT country, week, cum_cases, new_cases FROM wk_a WHERE country IN ('NATION_3', 'NATION_5', 'NATION_8')")
def filter_in(spark, d):
    keys = F.col("country").isin("NATION_3", "NATION_5", "NATION_8")
    return tb.order_weekly(spark, d).where(keys).select("country", "week", "cum_cases", "new_cases")


@query("split_by_date", """
    SELECT part, country, count(*) AS n_rows, min(week) AS first_week, max(week) AS last_week
    FROM (SELECT country, week, CASE WHEN week < DATE '1999-01-01' THEN 'train' ELSE 'test' END AS part FROM wk_a)
    GROUP BY part, country""")
def split_by_date(spark, d):
    weekly = cut_lineage(tb.order_weekly(spark, d))
    train, test = splits.split_by_date(weekly, "week", tb.CUT)
    both = train.withColumn("part", F.lit("train")).unionByName(test.withColumn("part", F.lit("test")))
    return both.groupBy("part", "country").agg(
        F.count(F.lit(1)).alias("n_rows"), F.min("week").alias("first_week"), F.max("week").alias("last_week")
    )


@query("split_flag", "SELECT country, week, CASE WHEN week < DATE '1999-01-01' THEN 'train' ELSE 'test' END AS split FROM wk_a")
def split_flag(spark, d):
    return tb.order_weekly(spark, d).select("country", "week", splits.split_flag("week", tb.CUT).alias("split"))


@query("select_features", f"SELECT country, week, phase, {rounded_sql(FEATURES)} FROM mat_a")
def select_features(spark, d):
    return tb.order_matrix(spark, d).select("country", "week", "phase", *rounded(FEATURES))


SCALED_SQL = """
    CASE {c} WHEN 'Growing' THEN 0 WHEN 'Stable/Peak' THEN 1 WHEN 'Declining' THEN 2 ELSE 3 END
      * max(new_cases) OVER (PARTITION BY country) / 4.0"""


@query("select_features_gauges", f"SELECT country, week, phase, split, {rounded_sql(EVENT_FEATURES)} FROM mat_b")
def select_features_gauges(spark, d):
    return tb.event_matrix(spark, d).select("country", "week", "phase", "split", *rounded(EVENT_FEATURES))


@query("scaled_code", f"SELECT country, week, phase, {SCALED_SQL.format(c='phase')} AS phase_scaled FROM ph_a")
def scaled_code(spark, d):
    rows = phases.label_phases(tb.order_weekly(spark, d), tb.ORDERS)
    return report.scaled_code(rows, tb.ORDERS, ["phase"]).select("country", "week", "phase", "phase_scaled")


@query("model_kind", "SELECT DISTINCT model, CASE model WHEN 'SEIR' THEN 'Mechanistic' ELSE 'Naive' END AS type FROM preds")
def model_kind(spark, d):
    return tb.naive_predictions(spark, d).select("model", evaluate.model_kind("model", NAIVE_KINDS).alias("type")).distinct()


LABELS_VALUES = ", ".join(f"('{k}', '{v}')" for k, v in MULTI_COUNTRY_FEATURES.labels().items())


@query("feature_labels", f"""
    SELECT feature, feature_label, round(avg(value), 4) AS mean_value
    FROM (UNPIVOT (SELECT {', '.join(FEATURES)} FROM mat_a) ON {', '.join(FEATURES)} INTO NAME feature VALUE value)
    JOIN (VALUES {LABELS_VALUES}) AS names(feature, feature_label) USING (feature) GROUP BY feature, feature_label""")
def feature_labels(spark, d):
    means = features.column_moments(tb.order_matrix(spark, d), FEATURES).select("feature", F.round("mean", 4).alias("mean_value"))
    return report.feature_labels(means, MULTI_COUNTRY_FEATURES.labels())


@query("scalar_functions", """
    SELECT country, date, CAST(date_trunc('week', date) AS DATE) AS week, CAST(date - DATE '1995-01-01' AS INTEGER) AS days,
           CAST(date + INTERVAL 7 DAY AS DATE) AS later, round_even(cum_deaths / cum_cases * 100.0, 0) / 100.0 AS half_even,
           greatest(cum_deaths * 2, 1) AS at_least_one, CAST(cum_cases * cum_cases AS DOUBLE) AS squared,
           printf('%.3f', cum_cases / 8.0) AS fixed, trim('  ' || country || ' ') AS trimmed,
           CASE WHEN cum_cases > 3 * cum_deaths THEN 'low' ELSE 'high' END AS argmax, cum_deaths IS NULL AS is_missing
    FROM rep_a""")
def scalar_functions(spark, d):
    rows = tb.order_reports(spark, d)
    scores = "array(CAST(3 * cum_deaths AS DOUBLE), CAST(cum_cases AS DOUBLE))"
    texts = {
        "country": "country",
        "date": fn.parse_date("date_format(date, 'M/d/yyyy')"),
        "week": fn.week_start("date"),
        "days": fn.days_between("date", "DATE '1995-01-01'"),
        "later": fn.next_week("date"),
        "half_even": fn.round_half_even("cum_deaths / cum_cases"),
        "at_least_one": "greatest(cum_deaths * 2, 1L)",
        "squared": "pow(cum_cases, 2)",
        "fixed": fn.fixed_decimals("cum_cases / 8D", 3),
        "trimmed": "trim(concat('  ', country, ' '))",
        "argmax": fn.argmax_label(scores, ["high", "low"]),
        "is_missing": "cum_deaths IS NULL",
    }
    return rows.selectExpr(*[f"{text} AS {name}" for name, text in texts.items()])


# ---------------------------------------------------------------------- joins


@query("join_increments", "SELECT country, date, cum_cases, cum_deaths, new_cases, new_deaths FROM inc_a")
def join_increments(spark, d):
    reports = tb.order_reports(spark, d)
    steps = series.increments(reports, tb.ORDERS).select("country", "date", "new_cases", "new_deaths")
    return joins.join_increments(reports, steps, tb.ORDERS)


@query("join_dimension", """
    SELECT w.country, w.week, coalesce(d.population, 0) AS population, coalesce(d.phase, 'Contained') AS phase
    FROM wk_a w LEFT JOIN (VALUES ('NATION_1', 12000000, 'Growing'), ('NATION_4', 4500000, 'Declining'),
                                  ('NATION_9', 7000000, 'Stable/Peak')) AS d(country, population, phase) USING (country)""")
def join_dimension(spark, d):
    rows = [("NATION_1", 12_000_000, "Growing"), ("NATION_4", 4_500_000, "Declining"), ("NATION_9", 7_000_000, "Stable/Peak")]
    dim = src.dimension_table(spark, rows, ["country", "population", "phase"])
    weekly = tb.order_weekly(spark, d).select("country", "week")
    out = joins.join_dimension(weekly, dim, "country", {"population": 0, "phase": "Contained"}, rows=len(rows))
    return out.withColumn("population", F.col("population").cast("int"))


def _day_number(date: str):
    return F.datediff(F.col(date), F.lit("1995-01-01").cast("date"))


@query("join_at_offset", """
    SELECT w.country, CAST(w.week - DATE '1995-01-01' AS INTEGER) AS day, a.cases AS cases_now, b.cases AS cases_soon
    FROM wk_a w LEFT JOIN daily_a a ON a.country = w.country AND a.date = w.week
    LEFT JOIN daily_a b ON a.country = b.country AND b.date = a.date + 7""")
def join_at_offset(spark, d):
    curve = tb.order_daily(spark, d).select("country", _day_number("date").alias("day"), "cases")
    weeks = tb.order_weekly(spark, d).select("country", _day_number("week").alias("day"))
    return joins.join_at_offset(weeks, curve, ["country"], "day", "cases", 7)


@query("interp_join", f"""
    SELECT q.country, q.t, round(CASE WHEN q.t <= e.ta THEN e.ya WHEN q.t >= e.tb THEN e.yb
             ELSE (s.y1 - s.y0) / (s.t1 - s.t0) * (q.t - s.t0) + s.y0 END, 6) AS level
    FROM (SELECT country, (date - DATE '1995-01-01') * 1.05e0 - 3.5e0 AS t FROM daily_a) q
    JOIN (SELECT country, CAST(min(week) - DATE '1995-01-01' AS DOUBLE) AS ta, CAST(arg_min(cum_cases, week) AS DOUBLE) AS ya,
                 CAST(max(week) - DATE '1995-01-01' AS DOUBLE) AS tb, CAST(arg_max(cum_cases, week) AS DOUBLE) AS yb
          FROM wk_a GROUP BY country) e ON q.country = e.country
    LEFT JOIN (SELECT country, CAST(week - DATE '1995-01-01' AS DOUBLE) AS t0, CAST(cum_cases AS DOUBLE) AS y0,
                      CAST(lead(week) OVER ({WEEK}) - DATE '1995-01-01' AS DOUBLE) AS t1,
                      CAST(lead(cum_cases) OVER ({WEEK}) AS DOUBLE) AS y1 FROM wk_a) s
      ON s.country = q.country AND q.t >= s.t0 AND q.t < s.t1""")
def interp_join(spark, d):
    points = tb.order_daily(spark, d).select("country", (_day_number("date") * 1.05 - 3.5).alias("t"))
    samples = tb.order_weekly(spark, d).select("country", _day_number("week").alias("t"), "cum_cases")
    out = joins.interp_join(points, samples, ["country"], "t", "cum_cases", "level")
    return out.withColumn("level", F.round("level", 6))


@query("attach_predictions", "SELECT country, week, phase, split, last_phase FROM naive_a")
def attach_predictions(spark, d):
    matrix = cut_lineage(tb.order_matrix(spark, d).select("country", "week", "phase", "split"))
    preds = tb.persistence_phase(matrix).select("country", "week", "last_phase")
    return joins.attach_predictions(matrix, preds, ["country", "week"])


@query("zip_importance", f"""
    SELECT feature, CAST(position AS INTEGER) AS position, round(spread, 4) AS spread FROM (
      SELECT feature, stddev_pop(value) AS spread,
             list_position([{', '.join(repr(c) for c in FEATURES)}], feature) - 1 AS position
      FROM (UNPIVOT (SELECT {', '.join(FEATURES)} FROM mat_a) ON {', '.join(FEATURES)} INTO NAME feature VALUE value) GROUP BY feature)""")
def zip_importance(spark, d):
    packed = tb.order_matrix(spark, d).agg(F.array(*[F.stddev_pop(c) for c in FEATURES]).alias("spreads"))
    return joins.zip_importance(packed, "spreads", FEATURES, "spread").withColumn("spread", F.round("spread", 4))


# --------------------------------------------------------------- aggregations


@query("dedupe_sum", "SELECT country, date, cases, deaths FROM daily_a")
def dedupe_sum(spark, d):
    return series.dedupe_sum(tb.order_rows(spark, d), tb.ORDERS, ["cases", "deaths"])


@query("weekly_rollup", "SELECT country, week, cum_cases, cum_deaths, new_cases, new_deaths, cfr FROM wk_a")
def weekly_rollup(spark, d):
    return tb.order_weekly(spark, d)


@query("weekly_rollup_gauges", "SELECT * FROM wk_b")
def weekly_rollup_gauges(spark, d):
    return tb.event_weekly(spark, d)


@query("weekly_rollup_carry", f"""
    SELECT country, CAST(date AS DATE) AS week, max(cum_cases) AS cum_cases, max(cum_deaths) AS cum_deaths,
           CAST(sum(nc) AS BIGINT) AS new_cases, CAST(sum(nd) AS BIGINT) AS new_deaths,
           arg_max(survivors, date) AS survivors, arg_max(probable, date) AS probable,
           arg_max(suspected, date) AS suspected, arg_max(in_treatment, date) AS in_treatment
    FROM (SELECT *, greatest(coalesce(cum_cases - lag(cum_cases) OVER ({DAY}), 0), 0) AS nc,
                 greatest(coalesce(cum_deaths - lag(cum_deaths) OVER ({DAY}), 0), 0) AS nd FROM carry_b)
    GROUP BY country, CAST(date AS DATE)""")
def weekly_rollup_carry(spark, d):
    spec = tb.EVENTS.with_(fill="carry")
    return series.weekly_table(tb.event_reports(spark, d), spec).drop("cfr")


@query("weekly_rollup_filled", f"""
    SELECT country, CAST(unnest(generate_series(week, coalesce(nxt - 7, week), INTERVAL 7 DAY)) AS DATE) AS week, cum_cases,
           CASE WHEN unnest(generate_series(week, coalesce(nxt - 7, week), INTERVAL 7 DAY)) = week THEN new_cases ELSE 0 END AS new_cases
    FROM (SELECT country, week, cum_cases, new_cases, lead(week) OVER ({WEEK}) AS nxt FROM wk_a)""")
def weekly_rollup_filled(spark, d):
    return series.weekly_table(tb.order_reports(spark, d), tb.ORDERS.with_(gaps="fill")).select("country", "week", "cum_cases", "new_cases")


@query("last_in_bucket", """
    SELECT country, CAST(date AS DATE) AS week, arg_max(in_treatment, date) FILTER (WHERE in_treatment IS NOT NULL) AS in_treatment,
           arg_max(probable, date) FILTER (WHERE probable IS NOT NULL) AS probable
    FROM num_b GROUP BY country, CAST(date AS DATE)""")
def last_in_bucket(spark, d):
    last = [F.expr(f"{series.last_in_bucket(c, 'date')} AS {c}") for c in ("in_treatment", "probable")]
    return tb.event_reports(spark, d).groupBy("country", F.expr(f"{fn.bucket_start('date', 'day')} AS week")).agg(*last)


@query("series_extent", """
    SELECT country, min(week) AS first_time, max(week) AS last_time, max(cum_cases) AS max_level, count(*) AS n_rows
    FROM wk_a GROUP BY country""")
def series_extent(spark, d):
    return series.series_extent(tb.order_weekly(spark, d), tb.ORDERS)


@query("value_counts", "SELECT phase, count(*) AS n_rows FROM ph_a GROUP BY phase ORDER BY n_rows DESC, phase")
def value_counts(spark, d):
    return features.value_counts(phases.label_phases(tb.order_weekly(spark, d), tb.ORDERS), "phase")


@query("distinct_sorted", "SELECT DISTINCT phase FROM mat_a ORDER BY phase")
def distinct_sorted(spark, d):
    return features.distinct_sorted(tb.order_matrix(spark, d), "phase")


@query("split_sizes", "SELECT split, count(*) AS n_rows, count(*) FILTER (WHERE country IN (SELECT country FROM fit_a)) AS n_flagged FROM mat_a GROUP BY split")
def split_sizes(spark, d):
    weekly = cut_lineage(tb.order_weekly(spark, d))
    known = tb.known_fits(tb.curve_params(weekly, tb.populations(spark, d))).select("country", F.lit(True).alias("known"))
    matrix = features.feature_matrix(weekly, tb.ORDERS, MULTI_COUNTRY_FEATURES).withColumn("split", splits.split_flag("week", tb.CUT))
    return splits.split_sizes(matrix.join(known, "country", "left"), F.coalesce("known", F.lit(False)))


@query("best_of_group", """
    SELECT dataset, round(max(weighted_f1) FILTER (WHERE model IN ('Persistence', 'Majority')), 6) AS best_naive FROM metrics GROUP BY dataset""")
def best_of_group(spark, d):
    table = evaluate.compare_models(tb.naive_predictions(spark, d), NAIVE_KINDS)
    best = evaluate.best_of_group(table, ["Persistence", "Majority"], "best_naive")
    return best.select("dataset", *rounded(["best_naive"]))


# --------------------------------------------------------- ordered operators


@query("increments", "SELECT country, date, cum_cases, cum_deaths, new_cases, new_deaths FROM inc_a")
def increments(spark, d):
    return series.increments(tb.order_reports(spark, d), tb.ORDERS)


@query("increments_single", """
    SELECT 'all' AS country, day AS date, cum_cases, greatest(coalesce(cum_cases - lag(cum_cases) OVER (ORDER BY day), 0), 0) AS new_cases
    FROM (SELECT CAST(date AS DATE) AS day, CAST(sum(cum_cases) AS BIGINT) AS cum_cases FROM rep_b GROUP BY CAST(date AS DATE))""")
def increments_single(spark, d):
    spec = tb.ORDERS.with_(cumulative=("cum_cases",), clip_negative=("cum_cases",))
    daily = src.fill_zero_int(tb.event_reports(spark, d), ["cum_cases"]).select(
        F.lit("all").alias("country"), F.col("date").cast("date").alias("date"), "cum_cases"
    )
    return series.increments(series.dedupe_sum(daily, spec), spec)


@query("partition_start", f"SELECT country, date, row_number() OVER ({DAY}) = 1 AS is_first FROM rep_a")
def partition_start(spark, d):
    return tb.order_reports(spark, d).selectExpr("country", "date", f"{series.partition_start(tb.ORDERS)} AS is_first")


LAG_COLUMNS = [c for c in FEATURES if "_lag" in c and c.startswith("new")]


@query("lags", f"SELECT country, week, {', '.join(LAG_COLUMNS)} FROM feat_a")
def lags(spark, d):
    weekly = tb.order_weekly(spark, d)
    return weekly.withColumns(fn.columns(series.lags(tb.ORDERS.increments, (1, 2, 3), tb.ORDERS))).select("country", "week", *LAG_COLUMNS)


@query("level_lags", f"""
    SELECT country, week, lag(cum_cases) OVER ({WEEK}) AS cum_cases_lag1, lag(survivors) OVER ({WEEK}) AS survivors_lag1,
           lag(in_treatment) OVER ({WEEK}) AS in_treatment_lag1 FROM wk_b""")
def level_lags(spark, d):
    cols = series.level_lags(["cum_cases", "survivors", "in_treatment"], tb.EVENTS)
    return tb.event_weekly(spark, d).withColumns(fn.columns(cols)).select("country", "week", *cols)


@query("trailing_mean", "SELECT country, week, round(cases_3w_avg, 6) AS cases_3w_avg, round(deaths_3w_avg, 6) AS deaths_3w_avg FROM feat_a")
def trailing_mean(spark, d):
    means = {f"{c}_3w_avg": series.trailing_mean(f"new_{c}", 3, tb.ORDERS) for c in ("cases", "deaths")}
    return tb.order_weekly(spark, d).withColumns(fn.columns(means)).select("country", "week", *rounded(means))


@query("growth_rate", "SELECT country, week, round(case_growth_rate, 6) AS case_growth_rate, round(death_growth_rate, 6) AS death_growth_rate FROM feat_a")
def growth_rate(spark, d):
    rates = {f"{c}_growth_rate": series.growth_rate(f"new_{c}s", f"cum_{c}s", 5.0, tb.ORDERS) for c in ("case", "death")}
    return tb.order_weekly(spark, d).withColumns(fn.columns(rates)).select("country", "week", *rounded(rates))


@query("past_mean", f"SELECT country, week, round(avg(new_cases) OVER ({WEEK} ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 6) AS past FROM wk_a")
def past_mean(spark, d):
    return tb.order_weekly(spark, d).selectExpr("country", "week", f"round({series.past_mean('new_cases', 3, tb.ORDERS)}, 6) AS past")


@query("future_mean", f"SELECT country, week, round(avg(new_cases) OVER ({WEEK} ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING), 6) AS future FROM wk_a")
def future_mean(spark, d):
    return tb.order_weekly(spark, d).selectExpr("country", "week", f"round({series.future_mean('new_cases', 3, tb.ORDERS)}, 6) AS future")


@query("elapsed_days", "SELECT country, week, days_into_epidemic FROM feat_a")
def elapsed_days(spark, d):
    return tb.order_weekly(spark, d).selectExpr("country", "week", f"{series.elapsed_days(tb.ORDERS)} AS days_into_epidemic")


@query("initial_value", "SELECT country, t0, t_max, y0, e0, i0 FROM seed_a")
def initial_value(spark, d):
    return series.initial_value(tb.order_weekly(spark, d), tb.ORDERS)


@query("split_by_fraction", """
    SELECT country, week, split, min(week) FILTER (WHERE split = 'test') OVER (PARTITION BY country) AS boundary FROM mat_b""")
def split_by_fraction(spark, d):
    matrix = cut_lineage(tb.event_matrix(spark, d).select("country", "week", "split"))
    return matrix.join(splits.split_boundary(matrix, "week", ["country"]), "country")


@query("split_by_fraction_global", """
    SELECT country, week, CASE WHEN row_number() OVER (ORDER BY week, country) <= floor(count(*) OVER () * 0.7e0)
             THEN 'train' ELSE 'test' END AS split FROM wk_a""")
def split_by_fraction_global(spark, d):
    return splits.split_by_fraction(tb.order_weekly(spark, d).select("country", "week"), ["week", "country"])


@query("tail_holdout", """
    SELECT country, week, CASE WHEN row_number() OVER (ORDER BY country, week) <= floor(count(*) OVER () * (1 - 0.15e0))
             THEN 'fit' ELSE 'validation' END AS part FROM mat_a WHERE split = 'train'""")
def tail_holdout(spark, d):
    train = tb.order_matrix(spark, d).where(F.col("split") == "train").select("country", "week")
    return splits.tail_holdout(train, ["country", "week"])


# ---------------------------------------------------------------------- phases


@query("label_phases", "SELECT country, week, new_cases, phase FROM ph_a")
def label_phases(spark, d):
    return phases.label_phases(tb.order_weekly(spark, d), tb.ORDERS).select("country", "week", "new_cases", "phase")


@query("label_phases_gauges", "SELECT country, week, new_cases, phase FROM ph_b")
def label_phases_gauges(spark, d):
    return phases.label_phases(tb.event_weekly(spark, d), tb.EVENTS).select("country", "week", "new_cases", "phase")


def _coded(spark, d):
    weekly = cut_lineage(tb.order_weekly(spark, d))
    matrix = features.feature_matrix(weekly, tb.ORDERS, MULTI_COUNTRY_FEATURES).withColumn("split", splits.split_flag("week", tb.CUT))
    return tb.with_curve_phase(spark, d, matrix, weekly)


@query("phase_from_curve", "SELECT country, week, phase, curve_phase FROM cph_a WHERE split = 'test' AND country IN (SELECT country FROM fit_a)")
def phase_from_curve(spark, d):
    coded, params = _coded(spark, d)
    return coded.where(F.col("split") == "test").join(params.select("country"), "country").select("country", "week", "phase", "curve_phase")


@query("phase_guard", "SELECT country, count(*) AS n_rows, count(*) FILTER (WHERE curve_phase = 'Contained') AS n_contained FROM cph_a GROUP BY country")
def phase_guard(spark, d):
    coded, _ = _coded(spark, d)
    return coded.groupBy("country").agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(F.col("curve_phase") == "Contained").alias("n_contained"))


@query("phase_curve_full", "SELECT country, week, split, phase, curve_phase FROM cph_a")
def phase_curve_full(spark, d):
    return _coded(spark, d)[0].select("country", "week", "split", "phase", "curve_phase")


# -------------------------------------------------------------- order and sets


@query("sort_series", "SELECT country, week, new_cases FROM wk_a ORDER BY country, week")
def sort_series(spark, d):
    return series.sort_series(tb.order_weekly(spark, d).select("country", "week", "new_cases"), tb.ORDERS, "week")


SPREAD_SQL = f"""
    SELECT split AS model, feature, stddev_pop(value) AS importance
    FROM (UNPIVOT (SELECT split, {', '.join(FEATURES)} FROM mat_a) ON {', '.join(FEATURES)} INTO NAME feature VALUE value)
    GROUP BY split, feature"""


def _spreads(spark, d):
    """Spread of every feature per split, as a stand-in for two models' importances."""
    packed = tb.order_matrix(spark, d).groupBy(F.col("split").alias("model")).agg(F.array(*[F.stddev_pop(c) for c in FEATURES]).alias("v"))
    return joins.zip_importance(packed, "v", FEATURES)


@query("top_k_features", f"""
    SELECT model, feature, round(importance, 4) AS importance, CAST(rank AS INTEGER) AS rank FROM (
      SELECT *, row_number() OVER (PARTITION BY model ORDER BY importance DESC, feature) AS rank FROM ({SPREAD_SQL})) WHERE rank <= 5""")
def top_k_features(spark, d):
    return evaluate.top_k_features(_spreads(spark, d), 5).select("model", "feature", F.round("importance", 4).alias("importance"), "rank")


@query("sort_values", f"SELECT model, feature, round(importance, 4) AS importance FROM ({SPREAD_SQL}) ORDER BY importance, model, feature")
def sort_values(spark, d):
    rows = _spreads(spark, d).select("model", "feature", F.round("importance", 4).alias("importance"))
    return evaluate.sort_values(rows, "importance", "model", "feature")


SCORES = ["accuracy", "weighted_f1", "macro_f1"]


@query("best_per_group", f"""
    SELECT dataset, model, type, {rounded_sql(SCORES)} FROM (
      SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY weighted_f1 DESC, model) AS r FROM metrics) WHERE r = 1""")
def best_per_group(spark, d):
    best = evaluate.best_per_group(evaluate.compare_models(tb.naive_predictions(spark, d), NAIVE_KINDS))
    return best.select("dataset", "model", "type", *rounded(SCORES))


@query("union_metrics", "SELECT dataset, model, subset, country, week, truth, pred FROM preds")
def union_metrics(spark, d):
    return tb.naive_predictions(spark, d)


# ------------------------------------------------------ learning preparation


@query("encode_labels", """
    SELECT country, week, phase, CAST(dense_rank() OVER (ORDER BY country) - 1 AS INTEGER) AS country_enc,
           CASE phase WHEN 'Contained' THEN 0.0e0 WHEN 'Declining' THEN 1.0e0 WHEN 'Growing' THEN 2.0e0 ELSE 3.0e0 END AS label
    FROM ph_a""")
def encode_labels(spark, d):
    rows = phases.label_phases(tb.order_weekly(spark, d), tb.ORDERS).select("country", "week", "phase")
    return models.label_indexer(PHASES).transform(features.encode_key(rows, "country"))


@query("decode_labels", "SELECT country, week, phase, phase AS decoded FROM ph_a")
def decode_labels(spark, d):
    rows = phases.label_phases(tb.order_weekly(spark, d), tb.ORDERS).select("country", "week", "phase")
    return models.decode_labels(models.label_indexer(PHASES).transform(rows), PHASES, "label", "decoded").drop("label")


STANDARD_SQL = ", ".join(
    f"round(({c} - (SELECT avg({c}) FROM mat_a WHERE split = 'train')) / coalesce(nullif((SELECT stddev_pop({c}) FROM mat_a WHERE split = 'train'), 0), 1), 4) AS {c}"
    for c in FEATURES
)


@query("standardize", f"SELECT country, week, split, {STANDARD_SQL} FROM mat_a")
def standardize(spark, d):
    matrix = cut_lineage(tb.order_matrix(spark, d))
    scaler = features.fit_standardizer(matrix.where(F.col("split") == "train"), FEATURES)
    return scaler.apply(matrix).select("country", "week", "split", *rounded(FEATURES, 4))


GAUGES_SQL = ", ".join(
    f"round(({c} - (SELECT avg({c}) FROM mat_b WHERE split = 'train')) / coalesce(nullif((SELECT stddev_pop({c}) FROM mat_b WHERE split = 'train'), 0), 1), 4) AS {c}"
    for c in EVENT_FEATURES
)


@query("standardize_gauges", f"SELECT country, week, split, {GAUGES_SQL} FROM mat_b")
def standardize_gauges(spark, d):
    matrix = cut_lineage(tb.event_matrix(spark, d))
    scaler = features.fit_standardizer(matrix.where(F.col("split") == "train"), EVENT_FEATURES)
    return scaler.apply(matrix).select("country", "week", "split", *rounded(EVENT_FEATURES, 4))


@query("balanced_weights_gauges", """
    SELECT country, week, phase, round(n / (k * n_class), 6) AS weight
    FROM (SELECT *, count(*) OVER () AS n, count(*) OVER (PARTITION BY phase) AS n_class,
                 (SELECT count(DISTINCT phase) FROM mat_b WHERE split = 'train') AS k FROM mat_b WHERE split = 'train')""")
def balanced_weights_gauges(spark, d):
    train = cut_lineage(tb.event_matrix(spark, d).where(F.col("split") == "train"))
    return features.balanced_weights(train).select("country", "week", "phase", *rounded(["weight"]))


@query("balanced_weights", """
    SELECT country, week, phase, round(n / (k * n_class), 6) AS weight
    FROM (SELECT *, count(*) OVER () AS n, count(*) OVER (PARTITION BY phase) AS n_class,
                 (SELECT count(DISTINCT phase) FROM mat_a WHERE split = 'train') AS k FROM mat_a WHERE split = 'train')""")
def balanced_weights(spark, d):
    train = cut_lineage(tb.order_matrix(spark, d).where(F.col("split") == "train"))
    return features.balanced_weights(train).select("country", "week", "phase", *rounded(["weight"]))


# ------------------------------------------------------------------ evaluation


@query("confusion", "SELECT dataset, model, subset, truth, pred, count(*) AS n FROM preds GROUP BY ALL")
def confusion(spark, d):
    return evaluate.confusion(tb.naive_predictions(spark, d))


REPORT_SQL = """
    WITH grid AS (SELECT DISTINCT dataset, model, subset, l.label FROM preds, (VALUES {values}) AS l(label)),
    filled AS (SELECT g.*, coalesce(s.tp, 0) AS tp, coalesce(s.predicted, 0) AS predicted, coalesce(s.support, 0) AS support,
                      coalesce(s.precision, 0.0) AS precision, coalesce(s.recall, 0.0) AS recall, coalesce(s.f1, 0.0) AS f1
               FROM grid g LEFT JOIN stats s USING (dataset, model, subset, label)),
    extra AS (SELECT dataset, model, subset, count(*) FILTER (WHERE label NOT IN ({names})) AS n_extra FROM stats GROUP BY ALL),
    lines AS (
      SELECT dataset, model, subset, label, precision, recall, f1, support FROM filled
      UNION ALL SELECT dataset, model, subset, CASE WHEN n_extra = 0 THEN 'accuracy' ELSE 'micro avg' END,
             coalesce(sum(tp) / nullif(CASE WHEN n_extra = 0 THEN sum(support) ELSE sum(predicted) END, 0), 0.0), coalesce(sum(tp) / nullif(sum(support), 0), 0.0),
             coalesce(2.0 * sum(tp) / nullif(CASE WHEN n_extra = 0 THEN sum(support) ELSE sum(predicted) END + sum(support), 0), 0.0), sum(support)
      FROM filled JOIN extra USING (dataset, model, subset) GROUP BY dataset, model, subset, n_extra
      UNION ALL SELECT dataset, model, subset, 'macro avg', avg(precision), avg(recall), avg(f1), sum(support)
      FROM filled GROUP BY dataset, model, subset
      UNION ALL SELECT dataset, model, subset, 'weighted avg', coalesce(sum(precision * support) / nullif(sum(support), 0), 0.0),
             coalesce(sum(recall * support) / nullif(sum(support), 0), 0.0), coalesce(sum(f1 * support) / nullif(sum(support), 0), 0.0), sum(support)
      FROM filled GROUP BY dataset, model, subset)
    SELECT dataset, model, subset, label, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1,
           CAST(support AS BIGINT) AS support FROM lines"""


def _report_sql(labels) -> str:
    return REPORT_SQL.format(values=", ".join(f"('{x}')" for x in labels), names=", ".join(f"'{x}'" for x in labels))


def _report(spark, d, labels):
    table = evaluate.class_report(tb.naive_predictions(spark, d), labels)
    return table.select("dataset", "model", "subset", "label", *rounded(["precision", "recall", "f1"]), "support")


@query("class_report", _report_sql(PHASES))
def class_report(spark, d):
    return _report(spark, d, PHASES)


@query("class_report_partial", _report_sql(("Declining", "Growing", "Unheard of")))
def class_report_partial(spark, d):
    return _report(spark, d, ("Declining", "Growing", "Unheard of"))


@query("summary_metrics", f"SELECT dataset, model, subset, {rounded_sql(SCORES)} FROM summary")
def summary_metrics(spark, d):
    return evaluate.summary_metrics(tb.naive_predictions(spark, d)).select("dataset", "model", "subset", *rounded(SCORES))


@query("compare_models", f"SELECT dataset, model, type, {rounded_sql(SCORES)} FROM metrics")
def compare_models(spark, d):
    return evaluate.compare_models(tb.naive_predictions(spark, d), NAIVE_KINDS).select("dataset", "model", "type", *rounded(SCORES))


@query("subset_metrics", f"SELECT dataset, model, subset, {rounded_sql(SCORES)} FROM summary WHERE subset = 'TOP-3'")
def subset_metrics(spark, d):
    members = tb.naive_predictions(spark, d).where(F.col("subset") == "TOP-3")
    return evaluate.summary_metrics(members).select("dataset", "model", "subset", *rounded(SCORES))


# --------------------------------------------------------------------- reports


@query("timeline", f"""
    SELECT n.country, n.week, w.new_cases, n.phase, curve_phase, last_phase, split,
           c1.code * peak / 4.0 AS phase_scaled, c2.code * peak / 4.0 AS curve_phase_scaled, c3.code * peak / 4.0 AS last_phase_scaled
    FROM naive_a n JOIN wk_a w ON n.country = w.country AND n.week = w.week
    JOIN (SELECT country, max(new_cases) AS peak FROM wk_a GROUP BY country) p ON p.country = n.country
    JOIN (VALUES ('Growing', 0), ('Stable/Peak', 1), ('Declining', 2), ('Contained', 3)) AS c1(phase, code) ON c1.phase = n.phase
    LEFT JOIN (VALUES ('Growing', 0), ('Stable/Peak', 1), ('Declining', 2), ('Contained', 3)) AS c2(phase, code) ON c2.phase = curve_phase
    LEFT JOIN (VALUES ('Growing', 0), ('Stable/Peak', 1), ('Declining', 2), ('Contained', 3)) AS c3(phase, code) ON c3.phase = last_phase""")
def timeline(spark, d):
    weekly = cut_lineage(tb.order_weekly(spark, d))
    matrix = features.feature_matrix(weekly, tb.ORDERS, MULTI_COUNTRY_FEATURES)
    coded, _ = tb.with_curve_phase(spark, d, matrix, weekly)
    return report.timeline(tb.persistence_phase(coded), weekly, tb.ORDERS, tb.CUT, ["phase", "curve_phase", "last_phase"])


@query("timeline_gauges", """
    SELECT n.country, n.week, w.new_cases, n.phase, curve_phase, split, c1.code * peak / 4.0 AS phase_scaled, c2.code * peak / 4.0 AS curve_phase_scaled
    FROM cph_b n JOIN wk_b w ON n.country = w.country AND n.week = w.week
    JOIN (SELECT country, max(new_cases) AS peak FROM wk_b GROUP BY country) p ON p.country = n.country
    JOIN (VALUES ('Growing', 0), ('Stable/Peak', 1), ('Declining', 2), ('Contained', 3)) AS c1(phase, code) ON c1.phase = n.phase
    LEFT JOIN (VALUES ('Growing', 0), ('Stable/Peak', 1), ('Declining', 2), ('Contained', 3)) AS c2(phase, code) ON c2.phase = curve_phase""")
def timeline_gauges(spark, d):
    weekly = cut_lineage(tb.event_weekly(spark, d))
    matrix = splits.split_by_fraction(features.feature_matrix(weekly, tb.EVENTS, tb.EVENT_FEATURES), ["week"], tb.EVENTS.keys)
    return report.timeline(tb.with_event_curve_phase(matrix, weekly), weekly, tb.EVENTS, None, ["phase", "curve_phase"])


@query("phase_spans", "SELECT country, week AS span_start, CAST(week + 7 AS DATE) AS span_end, phase FROM ph_a")
def phase_spans(spark, d):
    return report.phase_spans(phases.label_phases(tb.order_weekly(spark, d), tb.ORDERS), tb.ORDERS)


@query("metric_bars", """
    SELECT dataset, position, model, round(accuracy, 6) AS accuracy, round(weighted_f1, 6) AS weighted_f1
    FROM metrics JOIN (VALUES ('SEIR', 1), ('SEIR (TOP-3)', 2), ('Persistence', 3), ('Majority', 4)) AS o(model, position) USING (model)""")
def metric_bars(spark, d):
    table = evaluate.compare_models(tb.naive_predictions(spark, d), NAIVE_KINDS)
    bars = report.metric_bars(table, ["SEIR", "SEIR (TOP-3)", "Persistence", "Majority"])
    return bars.select("dataset", "position", "model", *rounded(["accuracy", "weighted_f1"]))


@query("best_vs_baseline", """
    SELECT dataset, round(max(weighted_f1) FILTER (WHERE dataset = 'A' AND model = 'SEIR (TOP-3)' OR dataset = 'B' AND model = 'SEIR'), 6) AS baseline,
           round(max(weighted_f1) FILTER (WHERE model = 'Persistence'), 6) AS best_ml,
           round(max(weighted_f1) FILTER (WHERE model = 'Majority'), 6) AS best_dl
    FROM metrics GROUP BY dataset""")
def best_vs_baseline(spark, d):
    table = evaluate.compare_models(tb.naive_predictions(spark, d), NAIVE_KINDS)
    best = report.best_vs_baseline(table, {"A": "SEIR (TOP-3)", "B": "SEIR"}, ["Persistence"], ["Majority"])
    return best.select("dataset", *rounded(["baseline", "best_ml", "best_dl"]))


# ---------------------------------------------------------------------- curves


@query("observed_curve", "SELECT country, day, i AS infectious FROM curve_a")
def observed_curve(spark, d):
    params = tb.curve_params(tb.order_weekly(spark, d), tb.populations(spark, d))
    return tb.order_curves(spark, d, params)


PAIRS_SQL = """
    SELECT w.country, c.day, CAST(w.cum_cases AS DOUBLE) AS observed, c.total AS modelled
    FROM wk_a w JOIN par_a p ON p.country = w.country JOIN total_a c ON c.country = w.country AND c.day = w.week - p.t0"""


@query("fit_vs_observed", PAIRS_SQL)
def fit_vs_observed(spark, d):
    weekly = cut_lineage(tb.order_weekly(spark, d))
    params = cut_lineage(tb.curve_params(weekly, tb.populations(spark, d)))
    total = curves.cumulative_curve(tb.order_curves(spark, d, params), ["country"])
    return curves.fit_vs_observed(weekly, params, total, tb.ORDERS)


@query("sum_squared_error", f"""
    SELECT country, sum((modelled - observed) * (modelled - observed)) AS sse FROM ({PAIRS_SQL}) GROUP BY country""")
def sum_squared_error(spark, d):
    return curves.sum_squared_error(fit_vs_observed(spark, d), ["country"])


@query("reproduction_number", "SELECT country, round(beta, 6) AS beta, round(gamma, 6) AS gamma, round(beta / gamma, 6) AS r0 FROM par_a")
def reproduction_number(spark, d):
    params = tb.curve_params(tb.order_weekly(spark, d), tb.populations(spark, d)).withColumn("rate", F.col("gamma"))
    return curves.reproduction_number(params, ["country"]).select("country", *rounded(["beta", "gamma", "r0"]))


# -------------------------------------------------------------------- learning


# All models are trained at the default settings of ``ModelSettings`` and each only once per session and directory.
# Statements state what any correct training gives on the same tables; accuracy and repeatability are tested on fixtures.
TREES = ("Random Forest", "Gradient Boosting")


def _model(spark, d, name):
    matrix = cut_lineage(tb.order_matrix(spark, d))
    return tb.trained(spark, d, "A", matrix, FEATURES, PHASES, [name])[name], matrix


TRAIN_SQL = "SELECT country, week, split, phase, true AS pred_listed, true AS beats_majority FROM mat_a"


def _scored(spark, d, name):
    """Every row with whether its prediction is a phase, and whether the model beats the most frequent training phase."""
    model, matrix = _model(spark, d, name)
    rows = cut_lineage(model.predict(matrix.select("country", "week", "split", "phase", *FEATURES)).select("country", "week", "split", "phase", "pred"))
    train = rows.where(F.col("split") == "train")
    hits = train.agg(F.avg((F.col("phase") == F.col("pred")).cast("double"))).first()[0]
    majority = features.value_counts(train, "phase").first()["n_rows"] / train.count()
    return rows.select("country", "week", "split", "phase", F.col("pred").isin(*PHASES).alias("pred_listed"), F.lit(hits >= majority).alias("beats_majority"))


@query("train_rf", TRAIN_SQL)
def train_rf(spark, d):
    return _scored(spark, d, "Random Forest")


@query("train_gbt", TRAIN_SQL)
def train_gbt(spark, d):
    return _scored(spark, d, "Gradient Boosting")


@query("train_mlp", TRAIN_SQL)
def train_mlp(spark, d):
    return _scored(spark, d, "MLP")


@query("train_lr", """
    SELECT phase, CASE WHEN phase IN (SELECT phase FROM mat_a WHERE split = 'train')
                       THEN round(1.0e0 / (SELECT count(DISTINCT phase) FROM mat_a WHERE split = 'train'), 2) ELSE 0.0e0 END AS mean_probability
    FROM (VALUES ('Contained'), ('Declining'), ('Growing'), ('Stable/Peak')) AS p(phase)""")
def train_lr(spark, d):
    """With balanced weights and a free intercept the optimum gives every trained class the same weighted mean."""
    model, matrix = _model(spark, d, "Logistic Regression")
    return models.mean_probabilities(model, matrix.where(F.col("split") == "train")).withColumn("mean_probability", F.round("mean_probability", 2))


@query("predict", "SELECT split, count(*) AS n_rows FROM mat_a GROUP BY split")
def predict(spark, d):
    model, matrix = _model(spark, d, "Random Forest")
    return model.predict(matrix).where(F.col("pred").isNotNull()).groupBy("split").agg(F.count(F.lit(1)).alias("n_rows"))


LABELS_SQL = ", ".join(f"('{c}', '{label}')" for c, label in MULTI_COUNTRY_FEATURES.labels().items())


@query("feature_importances", f"""
    SELECT model, feature, feature_label, round(1.0e0 / {len(FEATURES)}, 6) AS baseline, true AS in_range, 1.0e0 AS model_total
    FROM (VALUES ('Random Forest'), ('Gradient Boosting')) AS m(model), (VALUES {LABELS_SQL}) AS f(feature, feature_label)""")
def feature_importances(spark, d):
    fitted = [_model(spark, d, name)[0] for name in TREES]
    table = models.feature_importances(spark, fitted, MULTI_COUNTRY_FEATURES.labels())
    total = F.round(F.sum("importance").over(Window.partitionBy("model")), 6)
    return table.select("model", "feature", "feature_label", F.round("baseline", 6).alias("baseline"), F.col("importance").between(0, 1).alias("in_range"), total.alias("model_total"))


@query("coefficients", f"""
    SELECT phase, feature, feature_label, true AS at_optimum
    FROM (VALUES ('Contained'), ('Declining'), ('Growing'), ('Stable/Peak')) AS p(phase), (VALUES {LABELS_SQL}) AS f(feature, feature_label)""")
def coefficients(spark, d):
    """Each coefficient with whether the penalised loss is flat there, to 0.005."""
    model, matrix = _model(spark, d, "Logistic Regression")
    slopes = models.penalised_gradient(model, matrix.where(F.col("split") == "train"))
    flat = {(p, c): bool(abs(slopes[k][j]) < 5e-3) for k, p in enumerate(sorted(PHASES)) for j, c in enumerate(model.cols)}
    table = models.coefficients(spark, model, MULTI_COUNTRY_FEATURES.labels())
    known = spark.createDataFrame([(p, c, f) for (p, c), f in flat.items()], "phase string, feature string, at_optimum boolean")
    return table.join(F.broadcast(known), ["phase", "feature"]).select("phase", "feature", "feature_label", "at_optimum")


@query("loss_curve", "SELECT * FROM (VALUES (1, true), (2, true), (5, true), (10, true), (20, true), (50, true), (100, true), (200, true)) AS s(iteration, not_above_the_step_before)")
def loss_curve(spark, d):
    train = cut_lineage(tb.order_matrix(spark, d).where(F.col("split") == "train"))
    table = models.loss_curve(train, FEATURES, PHASES, ["country", "week"])
    before = F.lag("train_loss").over(Window.orderBy("iteration"))  # one row per documented step
    return table.select("iteration", F.coalesce(F.col("train_loss") <= before + 1e-9, F.lit(True)).alias("not_above_the_step_before"))


@query("model_comparison", """
    WITH names AS (SELECT * FROM (VALUES ('A', 'SEIR', 'Mechanistic'), ('A', 'SEIR (TOP-3)', 'Mechanistic'), ('B', 'SEIR', 'Mechanistic'),
      ('A', 'Random Forest', 'Machine Learning'), ('A', 'Gradient Boosting', 'Machine Learning'), ('A', 'Logistic Regression', 'Machine Learning'), ('A', 'MLP', 'Deep Learning'),
      ('B', 'Random Forest', 'Machine Learning'), ('B', 'Gradient Boosting', 'Machine Learning'), ('B', 'Logistic Regression', 'Machine Learning'), ('B', 'MLP', 'Deep Learning')) AS n(dataset, model, type))
    SELECT dataset, model, type, CASE WHEN dataset = 'B' THEN (SELECT count(*) FROM mat_b WHERE split = 'test')
             WHEN model = 'SEIR (TOP-3)' THEN (SELECT count(*) FROM mat_a WHERE split = 'test' AND country IN (SELECT country FROM fit_a))
             ELSE (SELECT count(*) FROM mat_a WHERE split = 'test') END AS support, true AS scores_in_range
    FROM names""")
def model_comparison(spark, d):
    """Both data sets end to end: features, four models each, curves, predictions, comparison."""
    weekly = cut_lineage(tb.order_weekly(spark, d))
    params = cut_lineage(tb.known_fits(tb.curve_params(weekly, tb.populations(spark, d))))
    names = list(models.TRAINERS)
    own = tb.trained(spark, d, "A", tb.order_matrix(spark, d), FEATURES, PHASES, names)
    a = pipelines.multi_country_study(tb.order_reports(spark, d), params, tb.order_curves(spark, d, params), tb.CUT, dataset="A", fitted=own)
    days = cut_lineage(tb.event_weekly(spark, d))
    spans = cut_lineage(tb.event_params(days))
    matrix = cut_lineage(tb.event_matrix(spark, d))
    detailed = tb.trained(spark, d, "B", matrix, EVENT_FEATURES, pipelines.phase_labels(matrix), names)
    b = pipelines.single_country_study(
        tb.event_reports(spark, d), spans, tb.event_curves(days, spans), dataset="B", spec=tb.EVENTS, features=tb.EVENT_FEATURES, fitted=detailed
    )
    scores = pipelines.compare_studies(a, b)
    fine = F.lit(True)
    for c in SCORES:
        fine = fine & F.col(c).between(0, 1)
    preds = evaluate.union_metrics([x.predictions.select("dataset", "model", "subset") for x in (a, b)])
    name = F.when(F.col("subset") == "all", F.col("model")).otherwise(F.format_string("%s (%s)", "model", "subset"))
    support = preds.groupBy("dataset", name.alias("model")).agg(F.count(F.lit(1)).alias("support"))
    return scores.join(support, ["dataset", "model"]).select("dataset", "model", "type", "support", F.coalesce(fine, F.lit(False)).alias("scores_in_range"))


@query("trained_reports", """
    WITH n AS (SELECT phase AS label, count(*) AS support FROM mat_a WHERE split = 'test' GROUP BY phase), t AS (SELECT count(*) AS support FROM mat_a WHERE split = 'test'),
    lines AS (SELECT p.label, coalesce(n.support, 0) AS support FROM (VALUES ('Contained'), ('Declining'), ('Growing'), ('Stable/Peak')) AS p(label) LEFT JOIN n USING (label)
      UNION ALL SELECT a.label, t.support FROM (VALUES ('accuracy'), ('macro avg'), ('weighted avg')) AS a(label), t)
    SELECT model, label, support, true AS report_agrees
    FROM (VALUES ('Random Forest'), ('Gradient Boosting'), ('Logistic Regression'), ('MLP')) AS m(model), lines""")
def trained_reports(spark, d):
    """The class reports of the four trained models on the test rows, each line held against its plain definition.

    The stored predictions are counted once more in SQL text: precision, recall and F1 must agree with the report.
    """
    matrix = cut_lineage(tb.order_matrix(spark, d))
    fitted = tb.trained(spark, d, "A", matrix, FEATURES, PHASES, list(models.TRAINERS))
    test = matrix.where(F.col("split") == "test")
    keep = ["country", "week"]
    preds = cut_lineage(evaluate.union_metrics([
        evaluate.melt_predictions(model.predict(test), "A", {name: "pred"}, keep) for name, model in fitted.items()
    ]))
    report = evaluate.class_report(preds, PHASES, ["model"])
    plain = spark.sql("""
        WITH c AS (SELECT model, label, count_if(truth = label) AS support, count_if(pred = label) AS predicted, count_if(pred = label AND truth = label) AS tp
                   FROM {preds} LATERAL VIEW explode(array('Contained', 'Declining', 'Growing', 'Stable/Peak')) AS label GROUP BY model, label),
        s AS (SELECT *, coalesce(tp / nullif(predicted, 0), 0D) AS precision, coalesce(tp / nullif(support, 0), 0D) AS recall,
                     coalesce(2D * tp / nullif(predicted + support, 0), 0D) AS f1 FROM c)
        SELECT model, label, precision, recall, f1 FROM s
        UNION ALL SELECT model, 'macro avg', avg(precision), avg(recall), avg(f1) FROM s GROUP BY model
        UNION ALL SELECT model, 'weighted avg', sum(precision * support) / sum(support), sum(recall * support) / sum(support), sum(f1 * support) / sum(support) FROM s GROUP BY model
        UNION ALL SELECT model, 'accuracy', sum(tp) / sum(support), sum(tp) / sum(support), sum(tp) / sum(support) FROM s GROUP BY model""", preds=preds)
    same = F.lit(True)
    for c in ("precision", "recall", "f1"):
        same = same & (F.abs(F.col(f"r.{c}") - F.col(f"q.{c}")) < 1e-9)
    met = report.alias("r").join(plain.alias("q"), (F.col("r.model") == F.col("q.model")) & (F.col("r.label") == F.col("q.label")), "left")
    return met.select("r.model", "r.label", "r.support", F.coalesce(same, F.lit(False)).alias("report_agrees"))


@query("phase_distribution", "SELECT phase, count(*) AS n_weeks FROM ph_a GROUP BY phase")
def phase_distribution(spark, d):
    return pipelines.phase_distribution(tb.order_weekly(spark, d), tb.ORDERS)


@query("phase_distribution_suppliers", f"""
    WITH day AS (SELECT CAST(l_suppkey AS VARCHAR) AS country, CAST(l_shipdate AS DATE) AS date, count(*) AS cases
                 FROM lineitem GROUP BY ALL),
    steps AS (SELECT country, date, CASE WHEN row_number() OVER ({DAY}) = 1 THEN 0 ELSE cases END AS new_cases FROM day),
    weeks AS (SELECT country, CAST(date_trunc('week', date) AS DATE) AS week, sum(new_cases) AS new_cases FROM steps GROUP BY ALL),
    means AS (SELECT *, avg(new_cases) OVER ({WEEK} ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS past,
                     avg(new_cases) OVER ({WEEK} ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING) AS future FROM weeks)
    SELECT phase, count(*) AS n_weeks FROM (
      SELECT CASE WHEN future IS NULL OR (past < 2 AND future < 2) THEN 'Contained' WHEN past = 0 THEN 'Growing'
                  WHEN future > past * 1.25 THEN 'Growing' WHEN future < past * 0.75 THEN 'Declining' ELSE 'Stable/Peak' END AS phase
      FROM means) GROUP BY phase""")
def phase_distribution_suppliers(spark, d):
    return pipelines.phase_distribution(series.weekly_table(tb.supplier_reports(spark, d), tb.SUPPLIERS), tb.SUPPLIERS)
