"""Surveillance-shaped tables derived from the benchmark star schema.

Orders act as cases (shipped in full as deaths), nations as countries: many
long series. Hourly event streams act as detailed reports with gauges, missing
values and text: few series with a daily bucket.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.curves import observed_curve
from ..operators.evaluate import melt_predictions, union_metrics, with_subset
from ..operators.features import feature_matrix, value_counts
from ..operators.models import TRAINERS, PhaseModel
from ..operators.phases import phase_from_curve
from ..operators.series import TASK_ROWS, dealt, initial_value, over, weekly_table
from ..operators.splits import split_by_fraction, split_flag
from ..session import cut_lineage, persisted
from ..sources import coerce_numeric
from ..spec import MULTI_COUNTRY_FEATURES, FeatureSpec, ModelSettings, SeriesSpec

ORDERS = SeriesSpec()
EVENTS = SeriesSpec(
    keys=("country",),
    time="date",
    bucket="day",
    gauges=("survivors", "probable", "suspected", "in_treatment"),
    clip_negative=("cum_cases", "cum_deaths"),
)
SUPPLIERS = SeriesSpec()
EVENT_FEATURES = FeatureSpec(level_lags=("cum_cases", "cum_deaths", "survivors", "in_treatment"), encode_key=False)
CUT = "1999-01-01"


# The columns in use; a stated schema spares a pass over the file footers.
SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_nationkey int, c_mktsegment string",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_orderdate timestamp_ntz",
    "lineitem": "l_orderkey bigint, l_suppkey bigint, l_linenumber int, l_returnflag string, l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, event_type string, value double",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(f"{sf_dir}/{name}.parquet")


def order_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """country, date, cases, deaths: one row per order."""
    orders, customer, nation = (table(spark, sf_dir, t) for t in ("orders", "customer", "nation"))
    joined = orders.join(customer, orders.o_custkey == customer.c_custkey).join(
        nation, customer.c_nationkey == nation.n_nationkey
    )
    return joined.select(
        F.col("n_name").alias("country"),
        F.col("o_orderdate").cast("date").alias("date"),
        F.expr("1L AS cases"),
        F.expr("IF(o_orderstatus = 'F', 1L, 0L) AS deaths"),
    )


def accumulate(daily: DataFrame, cols: dict[str, str]) -> DataFrame:
    """Daily counts -> running totals per country."""
    w = Window.partitionBy("country").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    return daily.select("country", "date", *[F.sum(c).over(w).cast("long").alias(out) for c, out in cols.items()])


def order_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    daily = order_rows(spark, sf_dir).groupBy("country", "date").agg(
        F.sum("cases").alias("cases"), F.sum("deaths").alias("deaths")
    )
    return daily


def order_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """country, date, cum_cases, cum_deaths."""
    return accumulate(order_daily(spark, sf_dir), {"cases": "cum_cases", "deaths": "cum_deaths"})


def supplier_reports(spark: SparkSession, sf_dir: str, rows: int = TASK_ROWS) -> DataFrame:
    """The many-series variant: one series per supplier over shipped lines, dealt out at about ``rows`` days to a task."""
    lines = table(spark, sf_dir, "lineitem")
    daily = lines.groupBy(
        F.col("l_suppkey").cast("string").alias("country"), F.col("l_shipdate").cast("date").alias("date")
    ).agg(
        F.count(F.lit(1)).alias("cases"),
        F.sum(F.when(F.col("l_returnflag") == "R", 1).otherwise(0)).alias("deaths"),
    )
    return accumulate(dealt(daily, ["country"], rows), {"cases": "cum_cases", "deaths": "cum_deaths"})


def line_minutes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """country, minute, new_cases, new_deaths: all shipped lines as one series, at the minute its numbers give a line."""
    minute = F.expr("timestampadd(MINUTE, CAST((l_orderkey * 7 + l_linenumber * 131) % 1440 AS INT), l_shipdate)")
    return table(spark, sf_dir, "lineitem").groupBy(F.lit("ALL").alias("country"), minute.alias("minute")).agg(
        F.count(F.lit(1)).alias("new_cases"), F.count_if(F.col("l_returnflag") == "R").alias("new_deaths")
    )


def segment_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """country, candidate, date, cases: orders per day of each market segment of a country."""
    orders, customer, nation = (table(spark, sf_dir, t) for t in ("orders", "customer", "nation"))
    joined = orders.join(customer, orders.o_custkey == customer.c_custkey).join(nation, customer.c_nationkey == nation.n_nationkey)
    return joined.groupBy(
        F.col("n_name").alias("country"), F.col("c_mktsegment").alias("candidate"), F.col("o_orderdate").cast("date").alias("date")
    ).agg(F.count(F.lit(1)).alias("cases"))


def event_text_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly detailed reports as text; an hour whose first value is small files 'No report'."""
    hourly = table(spark, sf_dir, "events").groupBy(
        F.col("event_type").alias("country"), F.date_trunc("hour", F.col("ts")).cast("timestamp_ntz").alias("date")
    ).agg(
        F.count(F.lit(1)).alias("cases"),
        F.count_if(F.col("value") >= 20).alias("deaths"),
        F.count_if(F.col("value") < 20).alias("probable"),
        F.count_if(F.col("value") < 5).alias("suspected"),
        F.count_if(F.col("value") >= 50).alias("treated"),
        F.min_by("value", "event_id").alias("first_value"),
    )
    w = Window.partitionBy("country").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    silent = F.col("first_value") < 5

    def text(c):
        return F.when(silent, F.lit("No report")).otherwise(c.cast("string"))

    return hourly.select(
        "country",
        "date",
        text(F.sum("cases").over(w)).alias("cum_cases"),
        text(F.sum("deaths").over(w)).alias("cum_deaths"),
        text(F.sum("probable").over(w)).alias("survivors"),
        F.when(~silent & (F.col("probable") > 0), F.col("probable").cast("string")).alias("probable"),
        F.when(F.col("suspected") > 0, F.format_string(" %d ", "suspected")).otherwise(F.lit("n/a")).alias("suspected"),
        text(F.col("treated")).alias("in_treatment"),
    )


def populations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """country, population: a thousand people per customer."""
    customer, nation = table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation")
    return (
        customer.join(nation, customer.c_nationkey == nation.n_nationkey)
        .groupBy(F.col("n_name").alias("country"))
        .agg((F.count(F.lit(1)) * 1000).cast("double").alias("population"))
    )


COUNTERS = ("cum_cases", "cum_deaths", "survivors", "probable", "suspected", "in_treatment")


def event_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The detailed reports with numbers, NULL where nothing was reported."""
    return coerce_numeric(event_text_reports(spark, sf_dir), COUNTERS)


def order_weekly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return weekly_table(order_reports(spark, sf_dir), ORDERS)


def event_weekly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return weekly_table(event_reports(spark, sf_dir), EVENTS)


def order_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Feature rows with the date split; the keys are looked up in the raw rows, so nothing is stored."""
    keys = order_rows(spark, sf_dir).where(F.col("date").isNotNull())
    matrix = feature_matrix(order_weekly(spark, sf_dir), ORDERS, MULTI_COUNTRY_FEATURES, values=keys)
    return matrix.withColumn("split", split_flag("week", CUT))


def event_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Feature rows with the positional split inside every series."""
    return split_by_fraction(feature_matrix(event_weekly(spark, sf_dir), EVENTS, EVENT_FEATURES), ["week"], EVENTS.keys)


def curve_params(weekly: DataFrame, people: DataFrame) -> DataFrame:
    """Stated curve parameters of every country: rates follow from its share of deaths.

    The curve starts four weeks into the series and ends eight weeks before its end, so rows lie on both sides of it.
    """
    share = weekly.groupBy("country").agg(F.expr("CAST(max(cum_deaths) AS DOUBLE) / CAST(max(cum_cases) AS DOUBLE) AS share"))
    return (
        initial_value(weekly, ORDERS)
        .join(share, "country")
        .join(people, "country")
        .withColumns({
            "beta": F.when(F.col("share") < 1.0 / 3.0, F.lit(0.3)).otherwise(0.1 + 0.1 * F.col("share")),
            "gamma": 0.05 + 0.05 * F.col("share"),
            "t_end": F.expr("date_add(t0, t_max - 56)"),
            "t0": F.expr("date_add(t0, 28)"),
        })
    )


def known_fits(params: DataFrame) -> DataFrame:
    """Parameters of the countries with at least the average population."""
    mean = params.agg(F.avg("population")).first()[0]
    return params.where(F.col("population") >= F.lit(mean))


def order_curves(spark: SparkSession, sf_dir: str, params: DataFrame) -> DataFrame:
    """Daily orders of the countries in ``params`` as their curves."""
    return observed_curve(order_daily(spark, sf_dir), params, ORDERS.keys, "date", "cases")


def event_params(weekly: DataFrame) -> DataFrame:
    """Curve parameters of the detailed series: fifty people per case, a curve that ends three days early."""
    return weekly.groupBy("country").agg(
        F.min("week").alias("t0"), F.date_sub(F.max("week"), 3).alias("t_end"), (F.max("cum_cases") * 50).cast("double").alias("population")
    )


def event_curves(weekly: DataFrame, params: DataFrame) -> DataFrame:
    return observed_curve(weekly, params, EVENTS.keys, "week", "new_cases")


def with_curve_phase(
    spark: SparkSession, sf_dir: str, rows: DataFrame, weekly: DataFrame, member: str | None = None
) -> tuple[DataFrame, DataFrame]:
    """Rows with ``curve_phase`` (and ``member``), and the parameters of the countries that have a curve."""
    params = cut_lineage(known_fits(curve_params(weekly, populations(spark, sf_dir))))
    return phase_from_curve(rows, order_curves(spark, sf_dir, params), params, ORDERS.keys, "week", member=member), params


def with_event_curve_phase(rows: DataFrame, weekly: DataFrame) -> DataFrame:
    params = event_params(weekly)
    return phase_from_curve(rows, event_curves(weekly, params), params, EVENTS.keys, "week")


def majority_phase(rows: DataFrame, matrix: DataFrame) -> DataFrame:
    """The most frequent training phase of ``matrix`` on every row; ties go to the first name."""
    top = value_counts(matrix.where(F.col("split") == "train"), "phase").first()["phase"]
    return rows.withColumn("top_phase", F.lit(top))


def persistence_phase(matrix: DataFrame) -> DataFrame:
    """The phase of the previous row of the series as a prediction."""
    return matrix.selectExpr("*", f"lag(phase) {over(ORDERS, 'week')} AS last_phase")


def naive_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long test predictions of rule-based models on both data sets."""
    weekly = cut_lineage(order_weekly(spark, sf_dir))
    matrix = feature_matrix(weekly, ORDERS, MULTI_COUNTRY_FEATURES).withColumn("split", split_flag("week", CUT))
    coded, _ = with_curve_phase(spark, sf_dir, matrix, weekly, member="known")
    days = cut_lineage(event_weekly(spark, sf_dir))
    full = split_by_fraction(feature_matrix(days, EVENTS, EVENT_FEATURES), ["week"], EVENTS.keys)
    detailed = cut_lineage(with_event_curve_phase(full, days))
    keep = ["country", "week"]
    rows_a = majority_phase(persistence_phase(coded), matrix).where(F.col("split") == "test")
    rows_b = majority_phase(persistence_phase(detailed), detailed).where(F.col("split") == "test")
    naive = {"Persistence": "last_phase", "Majority": "top_phase"}
    a = melt_predictions(rows_a, "A", {"SEIR": "curve_phase", **naive}, [*keep, "known"])
    a = with_subset(a, F.col("known"), "SEIR", "TOP-3").drop("known")
    return union_metrics([a, melt_predictions(rows_b, "B", {"SEIR": "curve_phase", **naive}, keep)])


TRAINED: dict[tuple, PhaseModel] = {}


def trained(spark: SparkSession, sf_dir: str, dataset: str, matrix: DataFrame, cols: Sequence[str], labels: Sequence[str], names: Sequence[str]) -> dict[str, PhaseModel]:
    """The named models at full settings.

    A model is trained once for a training table, which its rows tell: their number and the sum of their hashes.
    """
    train = cut_lineage(matrix.where(F.col("split") == "train"))
    rows = train.agg(F.count(F.lit(1)), F.sum(F.xxhash64(*train.columns).cast("decimal(38,0)"))).first()
    out = {}
    for name in names:
        key = (spark.sparkContext.applicationId, dataset, name, tuple(cols), tuple(labels), *rows)
        if key not in TRAINED:
            more = {"order": ["country", "week"]} if name == "MLP" else {}
            with persisted(train) as kept:
                TRAINED[key] = TRAINERS[name](kept, cols, labels, ModelSettings(), **more)
        out[name] = TRAINED[key]
    return out
