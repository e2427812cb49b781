"""Registered queries on keys that hold all rows, candidate curves, rejected lines, composite keys and replaced parts."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import sources as src
from .. import streaming
from ..operators import blocked, curves, features, series, splits
from ..session import cut_lineage, scratch_path
from ..spec import FeatureSpec, SeriesSpec
from . import testbed as tb
from .catalog import query, rounded, rounded_sql

MINUTES = SeriesSpec(time="minute", bucket="day")
MINUTE_FEATURES = FeatureSpec(encode_key=False)
#: Rows of a block here: few, so that the test tables have several blocks.
BLOCK_ROWS = 10_000

MINUTES_SQL = """
    SELECT 'ALL' AS country, l_shipdate + to_minutes((l_orderkey * 7 + l_linenumber * 131) % 1440) AS minute,
           count(*) AS new_cases, count(*) FILTER (l_returnflag = 'R') AS new_deaths
    FROM lineitem GROUP BY l_shipdate + to_minutes((l_orderkey * 7 + l_linenumber * 131) % 1440)"""
RATIOS = [c for c in MINUTE_FEATURES.columns() if c.endswith(("avg", "rate"))]
WHOLE = [c for c in MINUTE_FEATURES.columns() if c not in RATIOS]


def text_of(minute: str) -> str:
    return f"date_format({minute}, 'yyyy-MM-dd HH:mm:ss') AS minute"


@query("giant_series_features", f"""
    WITH g AS ({MINUTES_SQL}),
    lv AS (SELECT country, minute, CAST(sum(new_cases) OVER (ORDER BY minute) AS BIGINT) AS cum_cases,
                  CAST(sum(new_deaths) OVER (ORDER BY minute) AS BIGINT) AS cum_deaths FROM g),
    st AS (SELECT *, greatest(coalesce(cum_cases - lag(cum_cases) OVER (ORDER BY minute), 0), 0) AS new_cases,
                  coalesce(cum_deaths - lag(cum_deaths) OVER (ORDER BY minute), 0) AS new_deaths FROM lv),
    f AS (SELECT *, avg(new_cases) OVER (ORDER BY minute ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS past,
                 avg(new_cases) OVER (ORDER BY minute ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING) AS future,
                 CAST(CAST(minute AS DATE) - CAST(min(minute) OVER () AS DATE) AS INTEGER) AS days_into_epidemic,
                 lag(new_cases, 1) OVER w AS new_cases_lag1, lag(new_cases, 2) OVER w AS new_cases_lag2, lag(new_cases, 3) OVER w AS new_cases_lag3,
                 lag(new_deaths, 1) OVER w AS new_deaths_lag1, lag(new_deaths, 2) OVER w AS new_deaths_lag2, lag(new_deaths, 3) OVER w AS new_deaths_lag3,
                 avg(new_cases) OVER (ORDER BY minute ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS cases_3w_avg,
                 avg(new_deaths) OVER (ORDER BY minute ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS deaths_3w_avg,
                 CASE WHEN lag(cum_cases, 2) OVER w <> 0 THEN greatest(least(lag(new_cases, 1) OVER w / lag(cum_cases, 2) OVER w, 5.0), -5.0) END AS case_growth_rate,
                 CASE WHEN lag(cum_deaths, 2) OVER w <> 0 THEN greatest(least(lag(new_deaths, 1) OVER w / lag(cum_deaths, 2) OVER w, 5.0), -5.0) END AS death_growth_rate,
                 lag(cum_cases, 1) OVER w AS cum_cases_lag1, lag(cum_deaths, 1) OVER w AS cum_deaths_lag1
          FROM st WINDOW w AS (ORDER BY minute))
    SELECT country, CAST(minute AS VARCHAR) AS minute, cum_cases, cum_deaths, new_cases, new_deaths, {', '.join(WHOLE)}, {rounded_sql(RATIOS)},
           CASE WHEN future IS NULL OR (past < 2 AND future < 2) THEN 'Contained' WHEN past = 0 THEN 'Growing' WHEN future > past * 1.25 THEN 'Growing'
                WHEN future < past * 0.75 THEN 'Declining' ELSE 'Stable/Peak' END AS phase
    FROM f""")
def giant_series_features(spark, d):
    table = blocked.giant_series_features(tb.line_minutes(spark, d), MINUTES, MINUTE_FEATURES, time="minute", rows=BLOCK_ROWS)
    return table.select(
        "country", F.expr(text_of("minute")), *MINUTES.cumulative, *MINUTES.increments, *WHOLE, *rounded(RATIOS), "phase"
    )


@query("last_known_giant_series", f"""
    WITH g AS ({MINUTES_SQL}), s AS (SELECT *, CASE WHEN new_deaths > 0 THEN new_cases END AS seen FROM g)
    SELECT country, CAST(minute AS VARCHAR) AS minute, seen, last_value(seen IGNORE NULLS) OVER (ORDER BY minute) AS carried,
           first_value(seen IGNORE NULLS) OVER (ORDER BY minute ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS coming FROM s""")
def last_known_giant_series(spark, d):
    seen = tb.line_minutes(spark, d).withColumn("seen", F.when(F.col("new_deaths") > 0, F.col("new_cases")))
    rows = blocked.in_blocks(seen, ["country", "minute"], BLOCK_ROWS)
    both = blocked.last_known(blocked.last_known(rows, ["country"], {"carried": "seen"}), ["country"], {"coming": "seen"}, backward=True)
    return both.select("country", F.expr(text_of("minute")), "seen", "carried", "coming")


ORDER_MINUTE = "timestampadd(MINUTE, CAST((o_orderkey * 13) % 1440 AS INT), o_orderdate) AS minute"
ORDER_MINUTE_SQL = "SELECT o_orderkey, 'ALL' AS country, o_orderdate + to_minutes((o_orderkey * 13) % 1440) AS minute FROM orders"


@query("asof_join", f"""
    SELECT o_orderkey, CAST(q.minute AS VARCHAR) AS minute, new_cases, new_deaths
    FROM ({ORDER_MINUTE_SQL}) q ASOF LEFT JOIN ({MINUTES_SQL}) s ON q.country = s.country AND q.minute >= s.minute""")
def asof_join(spark, d):
    asked = tb.table(spark, d, "orders").select("o_orderkey", F.lit("ALL").alias("country"), F.expr(ORDER_MINUTE))
    found = blocked.asof_join(asked, tb.line_minutes(spark, d), ["country"], "minute", ["new_cases", "new_deaths"], BLOCK_ROWS)
    return found.select("o_orderkey", F.expr(text_of("minute")), "new_cases", "new_deaths")


@query("interp_long", f"""
    WITH s AS (SELECT country, date_diff('minute', TIMESTAMP '1995-01-01', minute) AS t, CAST(new_cases AS DOUBLE) AS y FROM ({MINUTES_SQL})),
    q AS (SELECT o_orderkey, country, date_diff('minute', TIMESTAMP '1995-01-01', minute) AS t FROM ({ORDER_MINUTE_SQL})),
    b AS (SELECT q.*, s.t AS t0, s.y AS y0 FROM q ASOF LEFT JOIN s ON q.country = s.country AND q.t >= s.t),
    e AS (SELECT b.*, s.t AS t1, s.y AS y1 FROM b ASOF LEFT JOIN s ON b.country = s.country AND b.t < s.t)
    SELECT o_orderkey, t, round(CASE WHEN t0 IS NULL THEN y1 WHEN t1 IS NULL THEN y0 ELSE (y1 - y0) / (t1 - t0) * (t - t0) + y0 END, 6) AS level FROM e""")
def interp_long(spark, d):
    since = F.expr("timestampdiff(MINUTE, TIMESTAMP_NTZ '1995-01-01 00:00:00', minute)")
    asked = tb.table(spark, d, "orders").select("o_orderkey", F.lit("ALL").alias("country"), F.expr(ORDER_MINUTE))
    samples = tb.line_minutes(spark, d).withColumn("t", since)
    found = blocked.interp_long(asked.withColumn("t", since), samples, ["country"], "t", "new_cases", "level", BLOCK_ROWS)
    return found.select("o_orderkey", "t", F.round("level", 6).alias("level"))


LINES_SQL = """SELECT 'ALL' AS lead, l_shipdate, l_orderkey, l_linenumber FROM lineitem"""
LINE_ORDER = ["lead", "l_shipdate", "l_orderkey", "l_linenumber"]


def _lines(spark, d):
    return tb.table(spark, d, "lineitem").select(F.lit("ALL").alias("lead"), "l_shipdate", "l_orderkey", "l_linenumber")


@query("split_by_fraction_one_lead", f"""
    SELECT l_orderkey, l_linenumber, CASE WHEN row_number() OVER (ORDER BY lead, l_shipdate, l_orderkey, l_linenumber) <= floor(count(*) OVER () * 0.7e0)
             THEN 'train' ELSE 'test' END AS split FROM ({LINES_SQL})""")
def split_by_fraction_one_lead(spark, d):
    return splits.split_by_fraction(_lines(spark, d), LINE_ORDER).select("l_orderkey", "l_linenumber", "split")


@query("tail_holdout_one_lead", f"""
    SELECT l_orderkey, l_linenumber, CASE WHEN row_number() OVER (ORDER BY lead, l_shipdate, l_orderkey, l_linenumber) <= floor(count(*) OVER () * (1 - 0.15e0))
             THEN 'fit' ELSE 'validation' END AS part FROM ({LINES_SQL})""")
def tail_holdout_one_lead(spark, d):
    return splits.tail_holdout(_lines(spark, d), LINE_ORDER).select("l_orderkey", "l_linenumber", "part")


@query("split_by_date_embargo", """
    SELECT part, country, count(*) AS n_rows, min(week) AS first_week, max(week) AS last_week FROM (
      SELECT country, week, CASE WHEN week < DATE '1999-01-01' - 21 THEN 'train' WHEN week >= DATE '1999-01-01' THEN 'test' END AS part FROM wk_a)
    WHERE part IS NOT NULL GROUP BY part, country""")
def split_by_date_embargo(spark, d):
    weekly = cut_lineage(tb.order_weekly(spark, d))
    train, test = splits.split_by_date(weekly, "week", tb.CUT, embargo_days=21)
    both = train.withColumn("part", F.lit("train")).unionByName(test.withColumn("part", F.lit("test")))
    return both.groupBy("part", "country").agg(F.count(F.lit(1)).alias("n_rows"), F.min("week").alias("first_week"), F.max("week").alias("last_week"))


ERRORS_SQL = """
    SELECT country, candidate, count(*) AS n_days, sum((modelled - observed) * (modelled - observed)) AS sse FROM (
      SELECT w.country, c.candidate, CAST(w.cum_cases AS DOUBLE) AS observed,
             5e0 * (SELECT count(*) FROM seg s WHERE s.country = w.country AND s.candidate = c.candidate AND s.date <= w.week) AS modelled
      FROM wk_a w JOIN (SELECT DISTINCT country, candidate FROM seg) c USING (country)) GROUP BY country, candidate"""
SEGMENTS_SQL = """seg AS (SELECT n_name AS country, c_mktsegment AS candidate, CAST(o_orderdate AS DATE) AS date
    FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)"""


def _candidate_errors(spark, d):
    """Each country's weekly level against the running totals of its market segments, five times each."""
    weekly = cut_lineage(tb.order_weekly(spark, d).select("country", "week", "cum_cases"))
    spans = weekly.groupBy("country").agg(F.min("week").alias("t0"), F.max("week").alias("t_end"))
    daily = cut_lineage(tb.segment_daily(spark, d))
    keys = ["country", "candidate"]
    lines = curves.observed_curve(daily, spans.join(daily.select(*keys).distinct(), "country"), keys, "date", "cases")
    totals = curves.cumulative_curve(lines, keys).withColumn("modelled", F.col("modelled") * 5)
    seen = weekly.join(spans, "country").select("country", F.datediff("week", "t0").alias("day"), F.col("cum_cases").alias("observed"))
    return curves.candidate_errors(seen, totals, ["country"])


@query("candidate_errors", f"WITH {SEGMENTS_SQL} {ERRORS_SQL}")
def candidate_errors(spark, d):
    return _candidate_errors(spark, d)


@query("best_curve", f"""
    WITH {SEGMENTS_SQL}, err AS ({ERRORS_SQL})
    SELECT country, candidate, n_days, sse, n_candidates FROM (
      SELECT *, row_number() OVER (PARTITION BY country ORDER BY n_days DESC, sse, candidate) AS place, count(*) OVER (PARTITION BY country) AS n_candidates FROM err)
    WHERE place = 1""")
def best_curve(spark, d):
    return curves.best_candidate(_candidate_errors(spark, d), ["country"])


@query("encode_composite_key", """
    SELECT r_name AS region, n_name AS nation, c_custkey, CAST(dense_rank() OVER (ORDER BY r_name, n_name) - 1 AS INTEGER) AS series_enc
    FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""")
def encode_composite_key(spark, d):
    customer, nation, region = (tb.table(spark, d, t) for t in ("customer", "nation", "region"))
    rows = customer.join(nation, customer.c_nationkey == nation.n_nationkey).join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    named = rows.select(F.col("r_name").alias("region"), F.col("n_name").alias("nation"), "c_custkey")
    return features.encode_key(named, ["region", "nation"], "series_enc")


#: A report line as text; by its counters some lack fields, some have one too many, some leave a quote open.
LINE_PARTS = ("country", "CAST(date AS STRING)", "CAST(cum_cases AS STRING)", "CAST(cum_deaths AS STRING)")
REJECTS_SQL = """
    SELECT *, CASE (cum_cases * 7 + cum_deaths) % 50
        WHEN 0 THEN country || ',' || CAST(date AS VARCHAR)
        WHEN 1 THEN country || ',' || CAST(date AS VARCHAR) || ',' || cum_cases || ',' || cum_deaths || ',"a, b",more'
        WHEN 2 THEN '"' || country || ',' || CAST(date AS VARCHAR) || ',' || cum_cases
        ELSE country || ',' || CAST(date AS VARCHAR) || ',' || cum_cases || ',' || cum_deaths || ',"a, b"' END AS record,
        CASE (cum_cases * 7 + cum_deaths) % 50 WHEN 0 THEN 'short' WHEN 1 THEN 'long' WHEN 2 THEN 'quotes' END AS reason,
        CASE (cum_cases * 7 + cum_deaths) % 50 WHEN 0 THEN 2 WHEN 1 THEN 5 WHEN 2 THEN 1 END AS n_read
    FROM rep_a"""


def _report_lines(spark, d) -> tuple:
    kind = (F.col("cum_cases") * 7 + F.col("cum_deaths")) % 50
    country, date, cases, deaths = map(F.expr, LINE_PARTS)
    line = (
        F.when(kind == 0, F.concat_ws(",", country, date))
        .when(kind == 1, F.concat_ws(",", country, date, cases, deaths, F.lit('"a, b"'), F.lit("more")))
        .when(kind == 2, F.concat(F.lit('"'), F.concat_ws(",", country, date, cases)))
        .otherwise(F.concat_ws(",", country, date, cases, deaths, F.lit('"a, b"')))
    )
    path = scratch_path(spark, "lines")
    tb.order_reports(spark, d).select(line.alias("line")).write.text(path)
    return src.read_with_rejects(spark, path, ["country", "date", "cum_cases", "cum_deaths", "notes"], "date", header=False)


@query("rejected_records", f"SELECT record, reason, n_read FROM ({REJECTS_SQL}) WHERE reason IS NOT NULL")
def rejected_records(spark, d):
    return _report_lines(spark, d)[1].drop("file")


@query("accepted_records", f"SELECT country, date, cum_cases, cum_deaths, 'a, b' AS notes FROM ({REJECTS_SQL}) WHERE reason IS NULL")
def accepted_records(spark, d):
    counters = ["cum_cases", "cum_deaths"]
    return src.fill_zero_int(src.coerce_numeric(_report_lines(spark, d)[0], counters), counters)


@query("overwrite_parts", """
    SELECT 'A' AS dataset, country, week, new_cases FROM wk_a WHERE week >= DATE '1999-01-01'
    UNION ALL SELECT 'B', country, week, new_cases FROM wk_b""")
def overwrite_parts(spark, d):
    path = scratch_path(spark, "parts")
    cols = ["country", "week", "new_cases"]
    a = cut_lineage(tb.order_weekly(spark, d).select(F.lit("A").alias("dataset"), *cols))
    b = tb.event_weekly(spark, d).select(F.lit("B").alias("dataset"), *cols)
    src.overwrite_parts(a.unionByName(b), path, ["dataset"])
    for _ in range(2):  # a rerun of one data set, twice, leaves the other
        src.overwrite_parts(a.where(F.col("week") >= F.lit(tb.CUT).cast("date")), path, ["dataset"])
    return spark.read.parquet(path).select("dataset", *cols)


REPORT_SCHEMA = "country string, date date, cum_cases long, cum_deaths long"


@query("weekly_rollup_stream", "SELECT country, week, cum_cases, cum_deaths, new_cases, new_deaths, cfr FROM wk_a")
def weekly_rollup_stream(spark, d):
    """Reports arrive in four files by date; every eleventh is late and comes in a fifth, after a first run has ended."""
    folder, target = scratch_path(spark, "reports"), scratch_path(spark, "rollup")
    reports = cut_lineage(tb.order_reports(spark, d))
    late = (F.col("cum_cases") % 11) == 0
    quarter = F.when(F.col("date") < "1996-08-01", 0).when(F.col("date") < "1998-04-01", 1).when(F.col("date") < "1999-12-01", 2).otherwise(3)
    for k in range(4):
        reports.where(~late & (quarter == k)).coalesce(1).write.mode("append").parquet(folder)
    streaming.stream_weekly(spark, folder, target, tb.ORDERS, REPORT_SCHEMA, "4000 days", files_per_batch=1)
    reports.where(late).coalesce(1).write.mode("append").parquet(folder)
    streaming.stream_weekly(spark, folder, target, tb.ORDERS, REPORT_SCHEMA, "4000 days", files_per_batch=1)
    return streaming.read_weekly(spark, target, tb.ORDERS)
