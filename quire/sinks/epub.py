"""E-book files from entry rows: one ZIP for each document, staged beside its place, checked, then moved there at once."""

from __future__ import annotations

import os
import subprocess
import tempfile
import zipfile
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from quire.session import reachable

RESULT = "doc_id string, output_path string, n_entries int, bytes long, error string"
#: The oldest time that a ZIP can hold; a fixed one, so that the same entries give the same file.
EPOCH = (1980, 1, 1, 0, 0, 0)


def same_file(a: str, b: str) -> bool:
    """Whether two paths lead to one file, by whatever links."""
    return os.path.exists(a) and os.path.exists(b) and os.path.samefile(a, b)


def publish(path: str, write: Callable[[str], None], check: Callable[[str], str | None] | None = None, source: str | None = None) -> str | None:
    """Writes to a temporary file in the destination's folder and moves it into place; returns what stood against it, leaving the destination as it was."""
    if source and same_file(source, path):
        return "source and destination are one file"
    folder = os.path.dirname(path) or "."
    os.makedirs(folder, exist_ok=True)
    handle, temp = tempfile.mkstemp(prefix=".quire-", suffix=os.path.splitext(path)[1], dir=folder)
    os.close(handle)
    try:
        write(temp)
        with open(temp, "rb+") as f:
            os.fsync(f.fileno())
        why = check(temp) if check else None
        if why is None and source and same_file(source, path):
            why = "source and destination are one file"
        if why is None:
            os.replace(temp, path)
        return why
    finally:
        if os.path.exists(temp):
            os.unlink(temp)


def zip_entries(rows: pd.DataFrame, target) -> None:
    with zipfile.ZipFile(target, "w") as z:
        for r in rows.sort_values("entry_no", kind="stable").itertuples():
            info = zipfile.ZipInfo(r.path, EPOCH)
            info.compress_type = zipfile.ZIP_STORED if r.method == "stored" else zipfile.ZIP_DEFLATED
            info.external_attr = 0o644 << 16
            z.writestr(info, bytes(r.bytes))


def write_books(entries: DataFrame, folder: str, check: Callable[[str], str | None] | None = None) -> DataFrame:
    """RESULT rows: writes each document's entries where a task runs, as <folder>/<output_path> if the rows have one, else as <folder>/<doc_id>.epub.

    folder must be shared. A retry writes the same file again. A column source_path guards that file from being written over.
    """

    def one(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        path = os.path.join(folder, rows["output_path"].iloc[0] if "output_path" in rows else f"{key[0]}.epub")
        why = publish(path, lambda temp: zip_entries(rows, temp), check, rows["source_path"].iloc[0] if "source_path" in rows else None)
        return pd.DataFrame([(str(key[0]), path, len(rows), os.path.getsize(path) if why is None else None, why)], columns=["doc_id", "output_path", "n_entries", "bytes", "error"])

    reachable(entries.sparkSession)
    return entries.groupBy("doc_id").applyInPandas(one, RESULT)


def checker(program: str, fail_on_warnings: bool = False) -> Callable[[str], str | None]:
    """A check for write_books() that runs a program on each package: what it says of one that doesn't pass. As operators.batch.validation, a program that ends well is believed whatever it prints, but for warnings if these are to fail."""

    def check(path: str) -> str | None:
        try:
            done = subprocess.run([program, path], capture_output=True, check=False)
        except OSError as e:
            return f"{program} can't be run: {e.strerror}"
        said = b"\n".join(x for x in (done.stdout, done.stderr) if x).decode("utf-8", "replace")
        warnings, errors = said.count("WARNING"), said.count("ERROR")
        if done.returncode == 0 and not (fail_on_warnings and warnings):
            return None
        return f"{errors} errors, {warnings} warnings" + (f"\n{said}" if said.strip() else "")

    return check


def dumps(chapters: DataFrame, payloads: DataFrame, names: DataFrame) -> DataFrame:
    """(name, bytes) of files to look at: for each of `names` (doc_id, path) its chapters as one markdown text, and the recognition's payload as JSON."""
    text = F.concat(F.lit("# "), "title", F.lit("\n\n"), "markdown", F.lit("\n"))
    by = chapters.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("chapter_no", text.alias("t")))).alias("own"))
    shown = by.select("doc_id", F.lit("normalized_chapters.md").alias("file"), F.array_join(F.col("own.t"), "\n").cast("binary").alias("bytes"))
    said = payloads.select("doc_id", F.lit("ocr_payload.json").alias("file"), F.to_json("payload").cast("binary").alias("bytes"))
    return shown.unionByName(said).join(names.select("doc_id", "path"), "doc_id").select(F.concat_ws("/", "path", "file").alias("name"), "bytes")
