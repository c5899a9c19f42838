"""Keeping facts current from a stream of file changes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

#: Changes up to which a delta is laid over the base: rows, and per cent of it; and the share of files from which all is built anew.
OVERLAY_ROWS, OVERLAY_PERCENT, REBUILD_PERCENT = 1000, 1, 50


def changes(spark: SparkSession, folder: str, schema: str, files_per_trigger: int = 100) -> DataFrame:
    """A stream of the Parquet files that appear in a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def once_each(stream: DataFrame, key: list[str], at: str, within: str) -> DataFrame:
    """The first event of each key within a stretch of event time: repeated notices of one change come as one."""
    return stream.withWatermark(at, within).dropDuplicatesWithinWatermark(key)


def windowed_counts(stream: DataFrame, at: str, by: list[str], size: str, late: str) -> DataFrame:
    """n by tumbling windows of event time."""
    return stream.withWatermark(at, late).groupBy(F.window(at, size), *by).agg(F.count("*").alias("n"))


def fact_changes(before: DataFrame, after: DataFrame, key: list[str]) -> DataFrame:
    """added and removed facts of the files (column file) that after has; other files' facts stay as they are."""
    touched = before.join(after.select("file").distinct(), "file", "left_semi")
    added = after.select(key).distinct().join(touched.select(key), key, "left_anti").withColumn("change", F.lit("added"))
    return added.unionByName(touched.select(key).distinct().join(after.select(key), key, "left_anti").withColumn("change", F.lit("removed")))


def policy(n_changes: int, n_facts: int, n_files: int, n_changed_files: int) -> str:
    """overlay, merge or rebuild, by how much has changed."""
    if n_files and n_changed_files * 100 > n_files * REBUILD_PERCENT:
        return "rebuild"
    return "overlay" if n_changes < OVERLAY_ROWS or n_changes * 100 < n_facts * OVERLAY_PERCENT else "merge"


def latest_each(batch: DataFrame, key: list[str], at: str) -> DataFrame:
    """The last row of each key in a batch."""
    last = Window.partitionBy(*key).orderBy(F.desc(at))
    return batch.withColumn("place", F.row_number().over(last)).where("place = 1").drop("place")


def run_available(stream: DataFrame, each: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Hands all that has come, batch by batch, to each, and ends: for a job that a commit starts. A batch may come twice after a loss; its number tells."""
    query = stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def stored_counts(spark: SparkSession, stream: DataFrame, by: list[str], folder: str, checkpoint: str) -> DataFrame:
    """n by the columns, over all that the stream has: partial counts of each batch, summed at the end. A batch that is run again replaces its own."""

    def each(batch: DataFrame, number: int) -> None:
        batch.groupBy(*by).agg(F.count("*").alias("n")).write.mode("overwrite").parquet(f"{folder}/batch={number}")

    run_available(stream, each, checkpoint)
    return spark.read.parquet(folder).groupBy(*by).agg(F.sum("n").alias("n"))


def maintain(spark: SparkSession, stream: DataFrame, key: list[str], folder: str, checkpoint: str, buckets: int = 64) -> None:
    """Keeps the facts of files current from a stream of all facts of changed files (columns file and key), and the changes of each batch.

    State lies in buckets of files; a batch writes only the buckets it touches, under its number, and the highest number of a bucket is
    its state. So a batch that is run again replaces what it wrote, and no state is ever half written.
    """
    bucket = F.pmod(F.xxhash64("file"), F.lit(buckets)).cast("int")

    def each(batch: DataFrame, number: int) -> None:
        new = batch.select("file", *[k for k in key if k != "file"]).distinct().withColumn("bucket", bucket).persist()
        touched = [r.bucket for r in new.select("bucket").distinct().collect()]  # buckets at most
        if touched:
            before = maintained(spark, folder, number).where(F.col("bucket").isin(touched)) if number else new.limit(0)
            changed = fact_changes(before, new, key)
            changed.write.mode("overwrite").parquet(f"{folder}/changes/batch={number}")
            kept = before.join(new.select("file").distinct(), "file", "left_anti").select(*new.columns)
            kept.unionByName(new).write.mode("overwrite").partitionBy("bucket").parquet(f"{folder}/state/batch={number}")
        new.unpersist()

    run_available(stream, each, checkpoint)


def maintained(spark: SparkSession, folder: str, before: int | None = None) -> DataFrame:
    """The facts as of all batches, or as of those before a number: of each bucket the rows of its last batch."""
    rows = spark.read.parquet(f"{folder}/state")
    rows = rows if before is None else rows.where(F.col("batch") < before)
    last = rows.groupBy("bucket").agg(F.max("batch").alias("batch"))
    return rows.join(F.broadcast(last), ["bucket", "batch"], "left_semi").drop("batch")  # last: a row for each bucket
