"""The weekly rollup as a stream: files of reports come in, also late ones, and weeks are revised.

Reports of one key and day are summed in the stream's state until the watermark passes the day. Each micro-batch hands on
the days it changed. From the first week it touched, a key's weeks are computed again, from its days and the last day
before; they are stored as the batch's revision. A batch that is repeated after a failure writes the same folders again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import bucket_start
from ..operators.series import BUCKET, daily_table, rollup
from ..spec import SeriesSpec

EVENT, BATCH = "_event_time", "batch"


def _latest(table: DataFrame, keys: list[str]) -> DataFrame:
    """The row of the last batch for each key."""
    values = [c for c in table.columns if c not in (*keys, BATCH)]
    return table.groupBy(*keys).agg(F.max_by(F.struct(*values), BATCH).alias("_row")).select(*keys, "_row.*")


def stream_weekly(
    spark: SparkSession, source: str, target: str, spec: SeriesSpec, schema: str, watermark: str = "60 days", files_per_batch: int = 100
) -> None:
    """Takes in the files of ``source`` (Parquet, ``schema``) that are new since the last call, then ends.

    Rows have the keys of ``spec``, its time as a date, its counters and gauges. Rows that are later than ``watermark``
    behind the newest day seen are left out; all others count as if they had been there from the start. Days and weeks go to
    folders below ``target``; ``read_weekly`` reads the present state. Missing counters must be filled with zeros and
    empty weeks be skipped, as both else depend on days that may still come.
    """
    if spec.fill != "zero" or spec.gaps != "skip":
        raise ValueError("a stream takes fill='zero' and gaps='skip'")
    keys, counters = list(spec.keys), (*spec.cumulative, *spec.gauges)
    days, weeks = f"{target}/days", f"{target}/weeks"

    def revise(changed: DataFrame, batch: int) -> None:
        changed.write.mode("overwrite").parquet(f"{days}/{BATCH}={batch}")
        seen = spark.read.parquet(f"{days}/{BATCH}={batch}")
        since = seen.groupBy(*keys).agg(F.expr(f"min({bucket_start(f'`{spec.time}`', spec.bucket)}) AS _since"))
        # Batches after this one can only be there when it is repeated.
        past = spark.read.option("basePath", days).parquet(days).where(F.col(BATCH) <= batch)
        known = _latest(past.join(since.select(*keys), keys, "left_semi"), [*keys, spec.time]).join(since, keys)
        later = known.where(F.col(spec.time) >= F.col("_since"))
        values = [spec.time, *counters]
        before = known.where(F.col(spec.time) < F.col("_since")).groupBy(*keys).agg(F.max_by(F.struct(*values), spec.time).alias("_row"))
        rows = later.select(*keys, *values).unionByName(before.select(*keys, "_row.*"))
        weekly = rollup(daily_table(rows, spec), spec).join(since, keys).where(F.col(BUCKET) >= F.col("_since")).drop("_since")
        weekly.write.mode("overwrite").parquet(f"{weeks}/{BATCH}={batch}")

    reports = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(source)
    placed = reports.na.drop(subset=[*keys, spec.time]).withColumn(EVENT, F.col(spec.time).cast("timestamp")).withWatermark(EVENT, watermark)
    numbers = [F.sum(F.expr(f"try_cast(`{c}` AS BIGINT)")).alias(c) for c in counters]
    summed = placed.groupBy(*keys, EVENT).agg(*numbers).select(*keys, F.col(EVENT).cast("date").alias(spec.time), *counters)
    query = (
        summed.writeStream.outputMode("update").foreachBatch(revise)
        .option("checkpointLocation", f"{target}/checkpoint").trigger(availableNow=True).start()
    )
    query.awaitTermination()


def read_weekly(spark: SparkSession, target: str, spec: SeriesSpec) -> DataFrame:
    """One row per key and week: the last revision."""
    weeks = f"{target}/weeks"
    return _latest(spark.read.option("basePath", weeks).parquet(weeks), [*spec.keys, BUCKET])
