"""What a session needs: Python workers that find this package, and tables cut from their lineage."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def reachable(spark: SparkSession) -> SparkSession:
    """On a local master, workers get this package's folder whatever the working folder is. On a cluster it is installed or shipped with --py-files."""
    context = spark.sparkContext
    if context.master.startswith("local"):
        root = str(Path(__file__).resolve().parents[1])
        known = context.environment.get("PYTHONPATH", "")
        if root not in known.split(":"):
            context.environment["PYTHONPATH"] = f"{root}:{known}".rstrip(":")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Only a local master gets one of its own."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    found = found or spark.sparkContext.getCheckpointDir()
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="quire-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def make_folder(spark: SparkSession, path: str) -> None:
    """On whatever file system the path names."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(place)


def remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    if jvm is not None:
        place = jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


class Staged:
    """Tables written to the shared folder, so that what follows rereads instead of recomputing them.

    They are dropped by drop() or when the program ends; what the caller gets may still read them.
    A Parquet table, unlike an RDD checkpoint, is compressed, prunes columns, and leaves the
    partitioning open: joins on it get exchanges of their own, which adaptive execution can split.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root, self.n = reachable(spark), f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}", 0
        atexit.register(self._end)

    def _end(self) -> None:
        try:
            remove(self.spark, self.root)
        except Exception:  # noqa: BLE001  the session may be gone already, and with it its folder
            return

    def put(self, df: DataFrame) -> DataFrame:
        self.n += 1
        path = f"{self.root}/{self.n}"
        df.write.option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._staged = path
        return out

    def drop(self, df: DataFrame) -> None:
        remove(self.spark, df._staged)
