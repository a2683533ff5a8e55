"""Files by name as a data sink: caches and packages on any file system that pyarrow reaches.

    register(spark)
    rows.write.format("keyed_files").mode("append").save(folder)                       # name, bytes
    entries.write.format("keyed_files").option("shape", "packages").mode("append").save(folder)  # name, entry_no, path, method, bytes

Tasks write below a hidden folder beside the files' places. When all have ended, the driver moves what the tasks that count have
written to its place, one rename for each file; if one fails for good, the hidden folder goes, and nothing has changed. So a task that fails, is lost or is run twice leaves no
file of its own, and a reader sees a whole file or none.
"""

from __future__ import annotations

import struct
import time
import uuid
import zlib
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from quire.session import reachable
from quire.sources.archives import file_system

#: The oldest time that a ZIP can hold, as it stands there; a fixed one, so that the same entries give the same file.
EPOCH = (1 << 5 | 1) << 16
#: Renames that the driver has under way at a time.
MOVES = 16


class Package:
    """A ZIP file written to a stream from front to back, each entry's sizes before its data."""

    def __init__(self, out):
        self.out, self.at, self.directory, self.n = out, 0, [], 0

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.at += len(data)

    def add(self, path: str, data: bytes, stored: bool) -> None:
        name, body = path.encode(), data
        if not stored:
            deflate = zlib.compressobj(6, zlib.DEFLATED, -15)
            body = deflate.compress(data) + deflate.flush()
        if self.at + len(body) + 1024 > 0xFFFFFFFF or len(data) > 0xFFFFFFFF or self.n == 0xFFFF:
            raise ValueError("the package is too large")
        shared = struct.pack("<HHHIIIIHH", 20, 0 if path.isascii() else 0x800, 0 if stored else 8, EPOCH, zlib.crc32(data), len(body), len(data), len(name), 0)
        self.directory.append(b"PK\1\2" + struct.pack("<H", 3 << 8 | 20) + shared + struct.pack("<HHHII", 0, 0, 0, 0o100644 << 16, self.at) + name)
        self._put(b"PK\3\4" + shared + name)
        self._put(body)
        self.n += 1

    def close(self) -> None:
        start = self.at
        for entry in self.directory:
            self._put(entry)
        self._put(struct.pack("<4sHHHHIIH", b"PK\5\6", 0, 0, self.n, self.n, self.at - start, start, 0))


@dataclass
class Written(WriterCommitMessage):
    """The folder in which a task's files wait."""

    folder: str


def _safe(name: str) -> str:
    """A name below the folder, whatever it says."""
    parts = [p for p in name.split("/") if p not in ("", ".")]
    if not parts or ".." in parts or parts[0].startswith(".staging-"):
        raise ValueError(f"not a file's name: {name!r}")
    return "/".join(parts)


def _folders(system: pafs.FileSystem, below: str, name: str) -> None:
    """The folders of a name, below one that must be there: what the job's end has deleted is not made anew."""
    parts = name.split("/")[:-1]
    for i in range(len(parts)):
        system.create_dir("/".join([below, *parts[: i + 1]]), recursive=False)


def _deleted(system: pafs.FileSystem, folder: str) -> None:
    """A folder that tasks may still be writing to, for a moment, is deleted."""
    for _ in range(50):
        try:
            if system.get_file_info(folder).type != pafs.FileType.Directory:
                return
            system.delete_dir(folder)
        except OSError:  # something came in meanwhile
            time.sleep(0.1)


class FileWriter(DataSourceArrowWriter):
    def __init__(self, options: dict):
        self.folder, self.packages = options["path"].rstrip("/"), options.get("shape", "files") == "packages"
        self.job = uuid.uuid4().hex

    def _place(self) -> tuple[pafs.FileSystem, str]:
        system, path = file_system(self.folder)
        return system, path.rstrip("/")

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        system, folder = self._place()
        own = f"{folder}/.staging-{self.job}/{uuid.uuid4().hex}"
        system.create_dir(own, recursive=False)  # fails once the job has ended
        try:
            for _ in (self._packages if self.packages else self._files)(system, own, batches):
                pass
        except BaseException:
            _deleted(system, own)
            raise
        return Written(own)

    def _files(self, system: pafs.FileSystem, staging: str, batches: Iterator[pa.RecordBatch]) -> Iterator[str]:
        for b in batches:
            for name, data in zip(b.column("name"), b.column("bytes"), strict=True):
                path = _safe(name.as_py())
                _folders(system, staging, path)
                with system.open_output_stream(f"{staging}/{path}") as out:
                    out.write(data.as_py())
                yield path

    def _packages(self, system: pafs.FileSystem, staging: str, batches: Iterator[pa.RecordBatch]) -> Iterator[str]:
        """Rows of a name follow each other, in the order of its entries: one entry is held at a time."""
        now, package = None, None
        for b in batches:
            for i in range(b.num_rows):
                name = _safe(b.column("name")[i].as_py())
                if name != now:
                    if package is not None:
                        package.close()
                        package.out.close()
                        yield now
                    _folders(system, staging, name)
                    now, package = name, Package(system.open_output_stream(f"{staging}/{name}"))
                package.add(b.column("path")[i].as_py(), b.column("bytes")[i].as_py(), b.column("method")[i].as_py() == "stored")
        if package is not None:
            package.close()
            package.out.close()
            yield now

    def begin(self) -> FileWriter:
        system, folder = self._place()
        system.create_dir(f"{folder}/.staging-{self.job}", recursive=True)
        return self

    def _clean(self) -> None:
        system, folder = self._place()
        _deleted(system, f"{folder}/.staging-{self.job}")

    def commit(self, messages: list[Written | None]) -> None:
        system, folder = self._place()

        def move(source: str, target: str) -> None:
            system.create_dir(target.rpartition("/")[0], recursive=True)
            if system.type_name == "hdfs" and system.get_file_info(target).type == pafs.FileType.File:
                system.delete_file(target)  # its moves don't replace
            system.move(source, target)

        with ThreadPoolExecutor(MOVES) as pool:
            for m in filter(None, messages):
                found = system.get_file_info(pafs.FileSelector(m.folder, recursive=True))
                files = [x.path for x in found if x.type == pafs.FileType.File]
                list(pool.map(move, files, [folder + f[len(m.folder) :] for f in files]))
        self._clean()

    def abort(self, messages: list[Written | None]) -> None:
        self._clean()


class FileSink(DataSource):
    """format("keyed_files"). Options: shape (files: name, bytes; packages: name, entry_no, path, method, bytes)."""

    @classmethod
    def name(cls) -> str:
        return "keyed_files"

    def writer(self, schema, overwrite: bool) -> FileWriter:
        if overwrite:
            raise ValueError("files are replaced one by one: use mode('append')")
        return FileWriter(dict(self.options)).begin()


def register(spark: SparkSession) -> SparkSession:
    reachable(spark).dataSource.register(FileSink)
    return spark


def write_files(files: DataFrame, folder: str) -> None:
    """Each row (name, bytes) as a file below the folder; of rows with one name, any."""
    register(files.sparkSession)
    files.select("name", F.col("bytes").cast("binary").alias("bytes")).write.format("keyed_files").mode("append").save(folder)


def write_packages(entries: DataFrame, folder: str) -> None:
    """Each name's entries (name, entry_no, path, method, bytes) as one ZIP file below the folder. A task holds one entry at a time, however large a package is."""
    register(entries.sparkSession)
    own = entries.select("name", "entry_no", "path", "method", "bytes").repartition("name").sortWithinPartitions("name", "entry_no", "path")
    own.write.format("keyed_files").option("shape", "packages").mode("append").save(folder)
