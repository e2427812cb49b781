"""Line deduplication over levelled sorted runs of line hashes.

Documents come in batches of falling ids. A batch's line hashes are merge-anti-joined with the runs written so far: a
hash found there is held by a larger document, any other is new and its largest holder is in the batch. The batch then
adds its own sorted run, and ``fanout`` runs of a level are compacted into one of the next.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from epiwave import session
from epiwave.llm.common import stored

#: The characters stripped from both ends of a line.
BLANKS = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
HASH = ["h1", "h2"]


def line_key(line: Column) -> Column:
    return F.translate(F.btrim(line, F.lit(BLANKS)), UPPER, LOWER)


class LineRuns:
    """Runs of (h1, h2, n_docs, max_doc), sorted by hash, in levels.

    max_doc stands in the run of the batch that brought the hash first; runs of later batches, whose documents are
    smaller, add to n_docs alone.
    """

    def __init__(self, spark: SparkSession, fanout: int = 3):
        self.spark, self.fanout = spark, fanout
        self.levels: list[list[DataFrame]] = []

    def runs(self) -> list[DataFrame]:
        return [r for level in self.levels for r in level]

    def write(self, run: DataFrame, level: int) -> None:
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(stored(run.repartition(*HASH).sortWithinPartitions(*HASH)))
        if len(self.levels[level]) >= self.fanout:
            full, self.levels[level] = self.levels[level], []
            self.write(self.merged(full), level + 1)

    @staticmethod
    def merged(runs: list[DataFrame]) -> DataFrame:
        return reduce(DataFrame.unionByName, runs).groupBy(*HASH).agg(F.sum("n_docs").alias("n_docs"), F.max("max_doc").alias("max_doc"))

    def add(self, lines: DataFrame) -> None:
        """A batch of (doc, h1, h2). All its documents must be smaller than those of earlier batches."""
        own = lines.groupBy(*HASH).agg(F.countDistinct("doc").alias("n_docs"), F.max("doc").alias("max_doc"))
        if not self.levels:
            self.write(own, 0)
            return
        own = stored(own)
        held = self.merged(self.runs()).select(*HASH)
        new = own.join(held, HASH, "left_anti")
        more = own.join(held, HASH, "left_semi").withColumn("max_doc", F.lit(None).cast("long"))
        self.write(new.unionByName(more), 0)

    def totals(self) -> DataFrame:
        return self.merged(self.runs())


def dedup_lines(docs: DataFrame, min_chars: int = 40, min_docs: int = 5, batches: int = 4, id_col="doc_id", text_col="text") -> DataFrame:
    """``docs`` without lines that many documents hold; their last holder, by id, keeps them.

    A line's key is the line stripped of blanks, with A-Z lower-cased. Keys of at least ``min_chars`` code points in at
    least ``min_docs`` documents (distinct ids) lose all their lines except those of the largest id. Adds n_lines and
    n_dropped; columns of these names in ``docs`` are replaced.

    Null and empty texts are one empty line, and stay as they are when nothing is dropped. A row without an id loses and
    counts nothing. Rows with the same id and text fare alike; rows with the same id and other texts are parts of one
    document. The batches change the order of work only, never the result.
    """
    spark = docs.sparkSession
    mine = docs.select(F.col(id_col).cast("long").alias("doc"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    mine = mine.filter("doc IS NOT NULL").withColumn("copy", F.xxhash64("text"))
    least, most = mine.agg(F.min("doc"), F.max("doc")).first()
    width = max(1, -(-((most or 0) - (least or 0) + 1) // batches))
    key = line_key(F.col("line"))
    lines = (
        mine.select("doc", "copy", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
        .withColumn("key", key).filter(F.length("key") >= min_chars)
        .select("doc", "copy", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit("second"), "key").alias("h2"), F.floor((F.lit(most) - F.col("doc")) / width).cast("int").alias("batch"))
    )
    path = session.scratch_path(spark, "lines")
    lines.write.partitionBy("batch").parquet(path)
    schema = "doc long, copy long, pos int, h1 long, h2 long, batch int"
    lines = spark.read.schema(schema).parquet(path)
    runs = LineRuns(spark)
    for b in range(batches):
        runs.add(lines.filter(F.col("batch") == b).select("doc", *HASH))
    common = stored(runs.totals().filter(F.col("n_docs") >= min_docs).select(*HASH, "max_doc"))
    dropped = lines.join(common, HASH).filter("doc < max_doc").groupBy("doc", "copy").agg(F.collect_set("pos").alias("__gone"))
    dropped = dropped.select(F.col("doc").alias("__doc"), F.col("copy").alias("__copy"), "__gone")
    text = F.col(text_col)
    split = F.split(F.coalesce(text, F.lit("")), "\n")
    joined = docs.withColumn("__c", F.xxhash64(F.coalesce(text, F.lit("")))).join(
        dropped, (F.col(id_col).cast("long") == F.col("__doc")) & (F.col("__c") == F.col("__copy")), "left"
    )
    left = F.array_except(F.sequence(F.lit(0), F.size(split) - 1), F.col("__gone"))
    kept = F.when(F.col("__gone").isNull(), text).otherwise(F.array_join(F.transform(left, lambda k: F.get(split, k)), "\n"))
    others = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    counted = joined.withColumns({
        "__kept": kept, "__lines": F.size(split).cast("long"), "__dropped": F.coalesce(F.size("__gone"), F.lit(0)).cast("long"),
    })
    return counted.select(
        *(F.col("__kept").alias(c) if c == text_col else F.col(c) for c in others),
        F.col("__lines").alias("n_lines"), F.when(F.col("__gone").isNull(), 0).otherwise(F.col("__dropped")).cast("long").alias("n_dropped"),
    )
