"""The rollup of a stream of files against the rollup of all of them."""

import random

import pytest

from epiwave import streaming
from epiwave.operators import series
from epiwave.spec import SeriesSpec

SPEC = SeriesSpec(gauges=("beds",), clip_negative=("cum_cases", "cum_deaths"))
SCHEMA = "country string, date date, cum_cases long, cum_deaths long, beds long"
COLUMNS = ["country", "week", "cum_cases", "cum_deaths", "new_cases", "new_deaths", "beds", "cfr"]


def rows(rng):
    out = []
    for k, days in (("a", 90), ("b", 40), ("c", 1)):
        total = 0
        for d in range(0, days, rng.randint(1, 3)):
            total = max(0, total + rng.randint(-2, 9))
            out.append((k, d, total, total // 3, rng.choice([None, d])))
            if rng.random() < 0.2:
                out.append((k, d, rng.choice([None, 1]), 0, None))  # a second report of the day is added to the first
    return out + [(None, 3, 1, 1, 1), ("a", None, 1, 1, 1)]


def frame(spark, data):
    plain = spark.createDataFrame(data, "country string, d int, cum_cases long, cum_deaths long, beds long")
    return plain.selectExpr("country", "date_add(DATE '2021-01-04', d) AS date", "cum_cases", "cum_deaths", "beds")


def test_late_files_revise_weeks(spark, tmp_path):
    rng = random.Random(3)
    data = rows(rng)
    rng.shuffle(data)
    source, target = str(tmp_path / "in"), str(tmp_path / "out")
    for k in range(4):
        frame(spark, data[k::4]).coalesce(1).write.mode("append").parquet(source)
        streaming.stream_weekly(spark, source, target, SPEC, SCHEMA, watermark="200 days")
        so_far = [r for j in range(k + 1) for r in data[j::4]]
        want = series.weekly_table(frame(spark, so_far), SPEC)
        got = streaming.read_weekly(spark, target, SPEC)
        assert sorted(map(str, got.select(*COLUMNS).collect())) == sorted(map(str, want.select(*COLUMNS).collect()))
    streaming.stream_weekly(spark, source, target, SPEC, SCHEMA, watermark="200 days")  # no new file, no change
    assert streaming.read_weekly(spark, target, SPEC).count() == got.count()


def test_reports_beyond_the_watermark_are_left_out(spark, tmp_path):
    source, target = str(tmp_path / "in"), str(tmp_path / "out")
    for data in ([("a", 100, 9, 1, None)], [("a", 101, 10, 1, None)], [("a", 5, 4, 0, None), ("a", 99, 8, 1, None)]):
        frame(spark, data).coalesce(1).write.mode("append").parquet(source)
        streaming.stream_weekly(spark, source, target, SPEC, SCHEMA, watermark="10 days")
    want = series.weekly_table(frame(spark, [("a", 99, 8, 1, None), ("a", 100, 9, 1, None), ("a", 101, 10, 1, None)]), SPEC)
    assert sorted(map(str, streaming.read_weekly(spark, target, SPEC).select(*COLUMNS).collect())) == sorted(map(str, want.select(*COLUMNS).collect()))


def test_what_a_stream_cannot_fill(spark, tmp_path):
    with pytest.raises(ValueError):
        streaming.stream_weekly(spark, str(tmp_path), str(tmp_path), SPEC.with_(fill="carry"), SCHEMA)
