import datetime

from epiwave import sources as src
from epiwave.functions import columns, parse_date, parse_number
from epiwave.operators import series
from epiwave.spec import MULTI_COUNTRY, SINGLE_COUNTRY

# The header names of the single-country report.
DETAILED = "\n".join([
    "Date, Survivors ,Cumulative_Confirmed_Cases,Cumulative_Confirmed_Deaths,Probable_Cases,Suspected_cases,In_Treatment_Centers,Qualitative notes",
    '9/8/2014,10,30,5,2,No report,,"Beds added, staff trained; ""urgent"""',
    "9/7/2014,,,,,,,No report",
    "9/1/2014,7,20,4,3,1,6,",
    "",
])


def test_detailed_reports(spark, tmp_path):
    path = tmp_path / "detailed.csv"
    path.write_text(DETAILED)
    out = src.read_detailed_reports(spark, str(path), "X")
    assert out.columns == ["country", "date", "cum_cases", "cum_deaths", "survivors", "probable", "suspected", "in_treatment"]
    rows = {r["date"]: r for r in out.collect()}
    assert rows[datetime.date(2014, 9, 8)]["cum_cases"] == 30 and rows[datetime.date(2014, 9, 8)]["suspected"] is None
    assert rows[datetime.date(2014, 9, 7)]["cum_cases"] is None
    weekly = series.weekly_table(out, SINGLE_COUNTRY).orderBy("week").collect()
    assert [(r["week"].day, r["cum_cases"], r["new_cases"], r["survivors"]) for r in weekly] == [(1, 20, 0, 0), (8, 30, 30, 10)]


def test_multi_country_reports(spark, tmp_path):
    path = tmp_path / "many.csv"
    path.write_text("Where,Date,Total,Dead\nX,2015-01-05,4,1\nX,2015-01-05,2,\nY,bad date,1,1\n")
    out = src.read_multi_country_reports(spark, str(path))
    daily = series.daily_table(out, MULTI_COUNTRY).orderBy("country").collect()
    assert [(r["country"], r["date"], r["cum_cases"], r["cum_deaths"]) for r in daily] == [
        ("X", datetime.date(2015, 1, 5), 6, 1),
    ]


def test_number_and_date_text(spark):
    texts = ["12", " 3.5 ", "-1e2", "5d", "No report", "", "NaN", "Infinity", "1e999", None]
    frame = spark.createDataFrame([(t,) for t in texts], "t string")
    out = [r[0] for r in frame.withColumns(columns({"n": parse_number("t")})).select("n").collect()]
    assert out == [12.0, 3.5, -100.0] + [None] * 7
    dates = spark.createDataFrame([("9/1/2014",), ("2014-09-01",), ("1.9.2014",), (None,)], "t string")
    out = [r[0] for r in dates.withColumns(columns({"d": parse_date("t")})).select("d").collect()]
    assert out == [datetime.date(2014, 9, 1)] * 2 + [None] * 2


def test_rename_and_fill(spark):
    frame = spark.createDataFrame([(1.9, None)], "a double, b double")
    out = src.fill_zero_int(src.rename_map(src.rename_positional(frame, [" x ", "y"]).transform(src.trim_headers), {"y": "z"}), ["x", "z"])
    assert out.columns == ["x", "z"] and tuple(out.first()) == (1, 0)


def test_written_results_round_trip(spark, tmp_path):
    frame = spark.createDataFrame([("A", "m", 0.5), ("B", "m", 0.25)], "dataset string, model string, score double")
    for fmt in ("parquet", "csv"):
        path = str(tmp_path / fmt)
        src.write_result(frame, path, fmt=fmt, by=["dataset"])
        back = spark.read.format(fmt).option("header", True).load(path)
        assert sorted((r["dataset"], r["model"], float(r["score"])) for r in back.collect()) == [("A", "m", 0.5), ("B", "m", 0.25)]


def test_rejected_records_are_counted(spark, tmp_path):
    (tmp_path / "r.csv").write_text('Date,n\n2020-01-01,1\n2020-01-02,2,3\n2020-01-03,"a\nb"\n')
    one = src.rejected_records(spark, str(tmp_path / "r.csv"), ["Date", "n"]).first()
    assert one["n_records"] == 4 and one["n_rejected"] >= 2
    whole = src.rejected_records(spark, str(tmp_path / "r.csv"), ["Date", "n"], multi_line=True).first()
    assert (whole["n_records"], whole["n_rejected"]) == (3, 1)
    assert src.read_reports(spark, str(tmp_path / "r.csv"), ["Date", "n"], multi_line=True).where("n LIKE '%b'").count() == 1
