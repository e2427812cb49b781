"""Small helpers of the operators."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from epiwave import session

BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


@contextmanager
def arrow_rows(spark: SparkSession, rows: int) -> Iterator[None]:
    """Jobs run inside hand at most ``rows`` rows at once to Python, for rows that hold many values each."""
    before = spark.conf.get(BATCH_ROWS)
    spark.conf.set(BATCH_ROWS, str(rows))
    try:
        yield
    finally:
        spark.conf.set(BATCH_ROWS, before)


def memory_returned() -> None:
    """Gives the memory that a Python worker no longer uses back to the system; workers outlive the stages they serve."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):
        pass  # another C library, without this call


def stored(df: DataFrame) -> DataFrame:
    """``df`` as a table of the shared folder; the shuffle files of its job go at once.

    Spark drops shuffle files when the driver's collector finds their plan gone, which may be long after the job.
    """
    out = session.cut_lineage(df)
    df.sparkSession.sparkContext._jvm.System.gc()
    return out


def dropped(table: DataFrame) -> None:
    """Removes a table that ``stored`` made and that nothing reads any more."""
    spark = table.sparkSession
    for folder in {f.rsplit("/", 1)[0] for f in table.inputFiles()}:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
