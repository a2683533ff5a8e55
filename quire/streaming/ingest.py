"""Documents that keep arriving: new files are converted as they come, and progress is followed by job."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery


def books(spark: SparkSession, folder: str, files_per_trigger: int = 1000) -> DataFrame:
    """A stream of (path, content, source_hash, modificationTime) of the books put into a folder."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    files = spark.readStream.format("binaryFile").schema(schema).option("recursiveFileLookup", True).option("maxFilesPerTrigger", files_per_trigger).load(folder)
    return files.where(F.col("path").rlike(r"(?i)\.(pdf|cbz)\z")).select("path", "content", F.sha2("content", 256).alias("source_hash"), "modificationTime")


def payloads(spark: SparkSession, folder: str, schema: str, files_per_trigger: int = 1000) -> DataFrame:
    """A stream of rows of JSON lines files."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).json(folder)


def stage_counts(events: DataFrame, late: str = "10 minutes", every: str = "5 minutes") -> DataFrame:
    """(start, stage, n) over a stream (ts, stage): events by window, closed once `late` has gone by."""
    x = events.withWatermark("ts", late).groupBy(F.window("ts", every), "stage").agg(F.count(F.lit(1)).alias("n"))
    return x.select(F.col("window.start").alias("start"), "stage", "n")


def latest(events: DataFrame) -> DataFrame:
    """(doc, stage, seq): the newest stage of each document of a stream (doc, stage, seq); for output mode update or complete."""
    return events.groupBy("doc").agg(F.max_by("stage", "seq").alias("stage"), F.max("seq").alias("seq"))


def each_batch(stream: DataFrame, work: Callable[[DataFrame], DataFrame], table: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Runs `work` on what has arrived and appends its rows to a Parquet table, in a folder for each batch: a batch that is run again replaces its own."""

    def run(batch: DataFrame, number: int) -> None:
        work(batch).write.mode("overwrite").parquet(f"{table}/batch={number}")

    return stream.writeStream.outputMode(mode).foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
