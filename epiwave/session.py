"""Session helpers: shared scratch space, lineage cuts and temporary persistence."""

from __future__ import annotations

import uuid
from contextlib import contextmanager

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach: ``spark.checkpoint.dir``, else one in the warehouse, which is shared as well.

    The rule is the same for every master.
    """
    sc = spark.sparkContext
    path = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if path is None:
        path = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_scratch"
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(path)
    return path


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Compute ``df`` once into a table of the shared folder and go on from there.

    The table outlives any executor, and being columnar it lets later steps read
    only the columns and rows they need.
    """
    spark = df.sparkSession
    path = scratch_path(spark, "table")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def scratch_removed(spark: SparkSession):
    """Remove on leaving what was written to the shared folder meanwhile; results must be stored elsewhere by then."""
    fs_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(shared_dir(spark))
    fs = fs_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    before = {str(x.getPath()) for x in fs.listStatus(fs_path)} if fs.exists(fs_path) else set()
    try:
        yield
    finally:
        for x in fs.listStatus(fs_path) if fs.exists(fs_path) else ():
            if str(x.getPath()) not in before:
                fs.delete(x.getPath(), True)


@contextmanager
def persisted(df: DataFrame):
    """Keep ``df`` in memory and on disk while models iterate over it."""
    kept = df.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        yield kept
    finally:
        kept.unpersist()
