"""Recognition by a service that holds files: upload, recognise, delete, with nothing left behind.

The service is the caller's: an object with upload(content, name) -> id, recognise(id, options) -> JSON text and delete(id), each of which may raise
ProviderError. A remote file is in a journal, one small file in a shared folder, from its upload until its deletion; what a task that failed or was lost has
left there, swept() deletes.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from typing import Protocol

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession, functions as F

from quire.session import make_folder, reachable

from .archives import file_system
from .providers import ProviderError, with_retries

#: Calls that a task has under way at a time.
CALLS = 8
ANSWERS = "cache_key string, json string, kind string, error string"


class Service(Protocol):
    def upload(self, content: bytes, name: str) -> str: ...
    def recognise(self, file_id: str, options: dict) -> str: ...
    def delete(self, file_id: str) -> None: ...


class Journal:
    """Remote files that are there, one entry each: <folder>/<something unique>.json."""

    def __init__(self, folder: str):
        self.folder = folder.rstrip("/")

    def enter(self, file_id: str, key: str) -> str:
        system, path = file_system(self.folder)
        entry = f"{path}/{uuid.uuid4().hex}.json"
        with system.open_output_stream(f"{entry}.new") as out:
            out.write(json.dumps({"file_id": file_id, "cache_key": key}).encode())
        system.move(f"{entry}.new", entry)
        return entry

    def strike(self, entry: str) -> None:
        system, path = file_system(self.folder)
        entry = f"{path}/{entry.rpartition('/')[2]}"
        if system.get_file_info(entry).type == pafs.FileType.File:
            system.delete_file(entry)


def one(service: Service, journal: Journal, key: str, content: bytes, name: str, options: dict, keep: bool, sleep: Callable[[float], None]) -> tuple:
    """ANSWERS values for one file. An upload is tried once, as the reference sequence does: a second one could leave a file that nobody knows of."""
    try:
        file_id = service.upload(content, name)
    except ProviderError as e:
        return key, None, "Api", f"upload: {e}"
    entry = journal.enter(file_id, key)
    try:
        said, kind, why = with_retries(lambda: service.recognise(file_id, options), sleep), None, None
        if not json.loads(said).get("pages"):
            said, kind, why = None, "OcrSchema", "the answer has no pages"
    except ProviderError as e:
        said, kind, why = None, "Api", f"recognise: {e}"
    except (ValueError, AttributeError) as e:
        said, kind, why = None, "OcrSchema", f"the answer is not understood: {e}"
    if keep:
        journal.strike(entry)
    else:
        try:
            service.delete(file_id)
            journal.strike(entry)
        except ProviderError:
            pass  # the entry stays, for swept(): an answer is not lost for that
    return key, said, kind, why


def recognised(jobs: DataFrame, service: Service, journal: str, options: dict | None = None, keep_remote: bool = False, sleep: Callable[[float], None] = time.sleep) -> DataFrame:
    """ANSWERS rows for jobs (cache_key, content, and name if there is one) that no cache has; equal keys are called once, CALLS at a time in each task.

    The rows must be written before anything else reads them, or calls are made again. Call swept() when they are.
    """
    make_folder(reachable(jobs.sparkSession), journal)
    named = jobs if "name" in jobs.columns else jobs.withColumn("name", F.concat("cache_key", F.lit(".pdf")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        book = Journal(journal)
        with ThreadPoolExecutor(CALLS) as pool:
            for b in batches:
                for at in range(0, b.num_rows, CALLS):  # no more contents are held as bytes than are under way
                    rows = b.slice(at, CALLS).to_pylist()
                    got = list(pool.map(lambda r: one(service, book, r["cache_key"], r["content"], r["name"], options or {}, keep_remote, sleep), rows))
                    yield pa.RecordBatch.from_arrays([pa.array([g[i] for g in got], pa.string()) for i in range(4)], [c.split()[0] for c in ANSWERS.split(", ")])

    return named.select("cache_key", "content", "name").dropDuplicates(["cache_key"]).mapInArrow(run, ANSWERS)


def swept(spark: SparkSession, service: Service, journal: str) -> DataFrame:
    """(file_id, cache_key, error) of the remote files that the journal still has, each deleted if the service lets it be; call it when no recognition runs.

    A file that the service no longer knows (404) counts as deleted.
    """
    make_folder(reachable(spark), journal)
    entries = spark.read.option("pathGlobFilter", "*.json").text(journal, wholetext=True).select(F.input_file_name().alias("entry"), F.from_json("value", "file_id string, cache_key string").alias("e"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        book = Journal(journal)
        for b in batches:
            errors = []
            for entry, file_id in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                why = None
                try:
                    service.delete(file_id)
                except ProviderError as e:
                    why = None if e.status == 404 else str(e)
                if why is None:
                    book.strike(entry)
                errors.append(why)
            yield pa.RecordBatch.from_arrays([b.column(1), b.column(2), pa.array(errors, pa.string())], ["file_id", "cache_key", "error"])

    return entries.select("entry", "e.file_id", "e.cache_key").where("file_id is not null").mapInArrow(run, "file_id string, cache_key string, error string")
