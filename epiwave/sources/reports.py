"""Reading surveillance reports, normalising their schema, writing results."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import functions as fn
from ..spec import DETAILED_REPORT_COLUMNS


def read_reports(
    spark: SparkSession,
    path: str,
    columns: Sequence[str],
    date_column: str | None = "Date",
    date_formats: Sequence[str] = ("M/d/yyyy", "yyyy-MM-dd"),
    multi_line: bool = False,
    by_name: bool = False,
    rejects: bool = False,
    header: bool = True,
) -> DataFrame:
    """Scan a headed CSV with every column as text, then parse the date column.

    The schema is stated, so no pass over the data is spent on inference. Quoted
    fields may hold commas; a record is one line, so that files can be split,
    unless ``multi_line`` lets quoted fields hold line breaks. ``by_name`` makes a
    file whose header has other names or another order an error. A record that
    does not fit the columns has NULLs; ``rejects`` keeps its text in ``_corrupt_record``.
    """
    names = [*columns, *["_corrupt_record"] * rejects]
    schema = T.StructType([T.StructField(c, T.StringType()) for c in names])
    raw = (
        spark.read.schema(schema)
        .option("header", header)
        .option("columnPruning", not rejects)
        .option("enforceSchema", not by_name)
        .option("multiLine", multi_line)
        .option("columnNameOfCorruptRecord", "_corrupt_record")
        .option("quote", '"')
        .option("escape", '"')
        .option("mode", "PERMISSIVE")
        .csv(path)
    )
    return raw.withColumns(fn.columns({date_column: fn.parse_date(f"`{date_column}`", date_formats)})) if date_column else raw


def read_with_rejects(
    spark: SparkSession, path: str, columns: Sequence[str], date_column: str | None = "Date", multi_line: bool = False, header: bool = True
) -> tuple[DataFrame, DataFrame]:
    """(records, rejects): the records that fit the columns, and a side table of those that don't.

    A reject has file, record (its text), reason and n_read (fields with a value that could be read). The reason is ``quotes``
    where a quoted field is left open or goes on after its end, else ``short`` or ``long`` for another number of fields. A
    bad date is no reject: the record stays, with a missing date.
    """
    raw = read_reports(spark, path, columns, date_column=None, multi_line=multi_line, rejects=True, header=header)
    text = F.col("_corrupt_record")
    bare = F.regexp_replace(text, '"(?:[^"]|"")*"', "")
    fields = F.length(bare) - F.length(F.replace(bare, F.lit(","))) + 1
    reason = F.when(F.contains(bare, F.lit('"')), "quotes").when(fields < len(columns), "short").otherwise("long")
    read = sum((F.col(f"`{c}`").isNotNull().cast("int") for c in columns), F.lit(0))
    file = F.regexp_extract("_metadata.file_path", "[^/]*$", 0)
    records = raw.where(text.isNull()).drop("_corrupt_record")
    if date_column:
        records = records.withColumns(fn.columns({date_column: fn.parse_date(f"`{date_column}`")}))
    return records, raw.where(text.isNotNull()).select(file.alias("file"), text.alias("record"), reason.alias("reason"), read.alias("n_read"))


def rejected_records(spark: SparkSession, path: str, columns: Sequence[str], multi_line: bool = False) -> DataFrame:
    """path, n_records, n_rejected, n_chars (of all fields) of every file; a rejected record does not fit the columns."""
    raw = read_reports(spark, path, columns, multi_line=multi_line, rejects=True, date_column=None)
    # The fields are read as well, as a misfit only shows when they are parsed.
    return raw.groupBy(F.col("_metadata.file_path").alias("path")).agg(
        F.count("*").alias("n_records"),
        F.count_if(F.col("_corrupt_record").isNotNull()).alias("n_rejected"),
        F.sum(F.length(F.concat_ws("", *[F.col(f"`{c}`") for c in columns]))).alias("n_chars"),
    )


def rename_positional(df: DataFrame, names: Sequence[str]) -> DataFrame:
    return df.toDF(*names)


def trim_headers(df: DataFrame) -> DataFrame:
    return df.toDF(*[c.strip() for c in df.columns])


def rename_map(df: DataFrame, names: Mapping[str, str]) -> DataFrame:
    return df.withColumnsRenamed(dict(names))


def coerce_numeric(df: DataFrame, cols: Iterable[str]) -> DataFrame:
    """Text -> double, unreadable text -> NULL."""
    return df.withColumns(fn.columns({c: fn.parse_number(c) for c in cols}))


def fill_zero_int(df: DataFrame, cols: Iterable[str]) -> DataFrame:
    """NULL -> 0, then truncate towards zero into a long."""
    return df.withColumns(fn.columns({c: fn.fill_zero(c) for c in cols}))


def dimension_table(spark: SparkSession, rows: Mapping | Sequence, names: Sequence[str]) -> DataFrame:
    """A lookup table from literals held by the caller (a dict or rows)."""
    data = [(k, v) for k, v in rows.items()] if isinstance(rows, Mapping) else [tuple(r) for r in rows]
    return spark.createDataFrame(data, list(names))


def write_result(df: DataFrame, path: str, fmt: str = "parquet", by: Sequence[str] = (), mode: str = "errorifexists"):
    """Write a result table, optionally partitioned by low-cardinality columns."""
    writer = df.write.mode(mode)
    if by:
        writer = writer.partitionBy(*by)
    if fmt == "csv":
        writer = writer.option("header", True).option("escape", '"')
    writer.format(fmt).save(path)


def overwrite_parts(df: DataFrame, path: str, by: Sequence[str]) -> None:
    """Replaces the parts (values of ``by``) that ``df`` has rows of, and leaves the others as they are.

    Each part is replaced at the commit of the job, so a run that is repeated after a failure gives the same table. A part
    is written by the tasks that hold its rows.
    """
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def read_multi_country_reports(spark: SparkSession, path: str) -> DataFrame:
    """Four-column reports (country, date, cumulative cases, cumulative deaths), renamed by position."""
    raw = read_reports(spark, path, ["c0", "Date", "c2", "c3"])
    named = rename_positional(raw, ["country", "date", "cum_cases", "cum_deaths"])
    return coerce_numeric(named, ["cum_cases", "cum_deaths"])


def read_detailed_reports(spark: SparkSession, path: str, country: str) -> DataFrame:
    """Detailed daily reports of one country; the country becomes the series key."""
    header = spark.read.option("header", True).csv(path).columns
    raw = trim_headers(read_reports(spark, path, header, date_column=_named(header, "Date"), by_name=True))
    named = rename_map(raw, DETAILED_REPORT_COLUMNS | {"Date": "date"})
    numbers = list(DETAILED_REPORT_COLUMNS.values())
    return coerce_numeric(named, numbers).select(F.lit(country).alias("country"), "date", *numbers)


def _named(header: Sequence[str], name: str) -> str:
    return next(c for c in header if c.strip() == name)
