"""Runs over a queue of books: batch by batch, to be cancelled between books and taken up again, each book converted once.

    run = Run(spark, "/shared/run-1")
    run.enqueue("/books", settings); run.convert("/books", out, cache, ...)     # in one thread
    run.cancel()                                                                # in another, or from another program

A run is a folder: the queue, the outcomes of each batch, and a mark that asks it to stop. What a batch has written is kept.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from quire.session import Staged, make_folder, remove

from . import folder as D

JOB = "uri string, path string, source_hash string, format string, why string, input_order int, candidate string, output_path string, doc_id string, source_path string"
OUTCOME = "path string, output_path string, status string, kind string, exit_code int, message string, pages long, chapters long, images long, cache_hit boolean, input_order int"


class Run:
    """One run's folder. Programs that share the folder share the run."""

    def __init__(self, spark: SparkSession, place: str):
        self.spark, self.place = spark, place.rstrip("/")
        self.tag = "run-" + uuid.uuid5(uuid.NAMESPACE_URL, self.place).hex

    def _exists(self, name: str) -> bool:
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.place}/{name}")
        return at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(at)

    def enqueue(self, folder: str, settings: D.Settings | None = None) -> DataFrame:
        """The queue, made and numbered once: taking a run up again keeps its books' output paths."""
        if not self._exists("queue/_SUCCESS"):
            D.queue(self.spark, folder, settings or D.Settings(), Staged(self.spark, "run")).select(*[c.split()[0] for c in JOB.split(", ")]).write.mode("overwrite").parquet(f"{self.place}/queue")
        return self.spark.read.schema(JOB).parquet(f"{self.place}/queue")

    def outcomes(self) -> DataFrame:
        """OUTCOME rows of this run so far, one for each book that has been tried: its last."""
        make_folder(self.spark, f"{self.place}/outcomes")
        told = self.spark.read.schema(OUTCOME + ", batch string").parquet(f"{self.place}/outcomes")
        names = [c.split()[0] for c in OUTCOME.split(", ")]
        return told.groupBy("path").agg(F.max_by(F.struct(*names[1:]), "batch").alias("o")).select("path", "o.*")

    def jobs(self) -> DataFrame:
        """The queue with each book's status: pending, done or error, and what its outcome says. Of other runs there is nothing in it."""
        queue = self.spark.read.schema(JOB).parquet(f"{self.place}/queue").select("path", "input_order")
        return queue.join(self.outcomes().drop("input_order"), "path", "left").withColumn("status", F.coalesce("status", F.lit("pending")))

    def counts(self) -> dict[str, int]:
        found = {r.status: r["count"] for r in self.jobs().groupBy("status").count().collect()}
        return {s: found.get(s, 0) for s in ("pending", "done", "error")}

    def cancel(self, now: bool = False) -> None:
        """Asks the run to stop after the batch under way; with `now`, that batch's jobs are interrupted too, and its books stay pending."""
        make_folder(self.spark, f"{self.place}/stop")
        if now:
            self.spark.interruptTag(self.tag)

    @property
    def cancelled(self) -> bool:
        return self._exists("stop")

    def convert(self, folder: str, out: str, cache: str, provider: Callable[[bytes, dict], str] | None = None, settings: D.Settings | None = None, batch: int = 1000, retry: bool = False, model: Callable[[bytes, dict], str] | None = None, check: Callable[[str], str | None] | None = None) -> dict[str, int]:
        """Converts what is pending (with `retry`, what failed too), `batch` books at a time, until the end or until it is cancelled; returns the counts.

        A batch's outcomes are written at once when its books are, so a book whose batch was interrupted is tried again, and no other.
        """
        settings = settings or D.Settings()
        remove(self.spark, f"{self.place}/stop")
        queue = self.enqueue(folder, settings)
        tried = self.outcomes().where("status = 'done'" if retry else "true").select("path")
        left = Staged(self.spark, "run").put(queue.join(tried, "path", "left_anti"))
        chunk = F.floor((F.col("input_order") - 1) / batch)
        for r in left.groupBy(chunk.alias("n")).count().orderBy("n").toLocalIterator():  # a number for each batch
            if self.cancelled:
                break
            self.spark.addTag(self.tag)
            try:
                got = D.convert_jobs(self.spark, folder, left.where(chunk == r.n), out, cache, provider, settings, check, model)
                number = self.spark.range(1).select(F.date_format(F.current_timestamp(), "yyyyMMddHHmmssSSSSSS")).first()[0]
                got.select(*[F.col(c.split()[0]).cast(c.split()[1]) for c in OUTCOME.split(", ")]).coalesce(1).write.parquet(f"{self.place}/outcomes/batch={number}")
            except Exception:
                if not self.cancelled:
                    raise
                break  # interrupted: its books stay pending
            finally:
                self.spark.removeTag(self.tag)
        return self.counts()
