"""Archives as a data source: entries from central directories, contents in bounded pieces.

    register(spark)
    spark.read.format("archives").option("mode", "directory").load(folder)

Files are opened where tasks run and only the parts that are needed are read: the end of a file, its directory a piece at a time, an entry's
data a piece at a time. Small files share a partition; a large one is dealt over several by its entries' places. Filters
on `archive`, `path` and `declared_size` are pushed down, so that what they leave out is neither opened nor inflated.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import BinaryIO, NamedTuple

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, StringContains, StringEndsWith, StringStartsWith

from quire.operators import archive as A
from quire.session import reachable

#: Bytes of a partition, of a piece that is read, and of a batch that is handed on.
SPLIT, PIECE, BATCH = 64 << 20, 64 << 10, 16 << 20
#: Expanded bytes for each compressed one.
RATIO = 1000

ENTRY = "archive string, entry_index int, path string, is_dir boolean, unix_mode int, encrypted boolean, declared_size long, compressed_size long"
SCHEMAS = {"directory": ENTRY, "content": f"{ENTRY}, bytes binary, error string", "files": "path string, size long, content binary, source_hash string"}
_ARROW = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "boolean": pa.bool_(), "binary": pa.binary()}


class BadArchive(ValueError):
    """What a file's bytes have against being an archive."""


def batch(rows: list[tuple], names: list[str], kinds: str) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], _ARROW[k.split()[1]]) for i, k in enumerate(kinds.split(", "))], names)


class Entry(NamedTuple):
    index: int
    path: str
    unix_mode: int
    flags: int
    method: int
    crc: int
    compressed: int
    declared: int
    offset: int

    @property
    def is_dir(self) -> bool:
        return self.path.endswith("/")

    @property
    def encrypted(self) -> bool:
        return bool(self.flags & 1)


def _exactly(f: BinaryIO, n: int) -> bytes:
    data = f.read(n)
    if len(data) < n:
        raise BadArchive("ends early")
    return data


def directory(f: BinaryIO, size: int) -> Iterator[Entry]:
    """Entries in the order of the central directory, which is read a piece at a time."""
    f.seek(max(0, size - 22 - 65535))
    start, tail = f.tell(), f.read(22 + 65535)
    at = tail.rfind(b"PK\5\6")
    while at >= 0 and (len(tail) < at + 22 or at + 22 + struct.unpack_from("<H", tail, at + 20)[0] > len(tail)):
        at = tail.rfind(b"PK\5\6", 0, at)
    if at < 0:
        raise BadArchive("no end of a directory")
    count, length, offset = struct.unpack_from("<HII", tail, at + 10)
    end = start + at
    if at >= 20 and tail[at - 20 : at - 16] == b"PK\6\7":
        place = struct.unpack_from("<Q", tail, at - 12)[0]
        f.seek(place)
        head = _exactly(f, 56)
        if head[:4] != b"PK\6\6":
            raise BadArchive("broken end of a directory")
        count, length, offset = struct.unpack_from("<QQQ", head, 32)
        end = place
    before = end - length - offset  # bytes that stand before the archive
    if before < 0:
        raise BadArchive("the directory lies outside the file")
    f.seek(before + offset)
    held, left = b"", length
    for index in range(count):
        need = 46
        while True:
            while len(held) < need and left:
                piece = _exactly(f, min(left, max(PIECE, need - len(held))))
                held, left = held + piece, left - len(piece)
            if len(held) < need or held[:4] != b"PK\1\2":
                raise BadArchive("broken directory")
            name, extra, comment = struct.unpack_from("<HHH", held, 28)
            if len(held) >= 46 + name + extra + comment:
                break
            need = 46 + name + extra + comment
        flags, method, _, _, crc, compressed, declared = struct.unpack_from("<HHHHIII", held, 8)
        mode, place = struct.unpack_from("<II", held, 38)
        raw = held[46 : 46 + name]
        more = held[46 + name : 46 + name + extra]
        while len(more) >= 4:
            kind, n = struct.unpack_from("<HH", more)
            if kind == 1:  # 64-bit numbers, of those that need them
                wide, at64 = more[4 : 4 + n], 0
                values = [declared, compressed, place]
                for i, v in enumerate(values):
                    if v == 0xFFFFFFFF and at64 + 8 <= len(wide):
                        values[i] = struct.unpack_from("<Q", wide, at64)[0]
                        at64 += 8
                declared, compressed, place = values
            more = more[4 + n :]
        held = held[46 + name + extra + comment :]
        yield Entry(index, raw.decode("utf-8", "replace") if flags & 0x800 else raw.decode("cp437"), mode >> 16, flags, method, crc, compressed, declared, before + place)


def limit_broken(expanded: int, compressed: int, most: int = A.MAX_ENTRY) -> str | None:
    """What the bytes that have come out so far have against them."""
    if expanded > most:
        return "too large"
    return "expands too much" if expanded > 0 and (not compressed or expanded > compressed * RATIO) else None


def _pieces(f: BinaryIO, entry: Entry) -> Iterator[bytes]:
    """An entry's data, PIECE bytes at a time, whatever it expands to."""
    f.seek(entry.offset)
    head = _exactly(f, 30)
    if head[:4] != b"PK\3\4":
        raise BadArchive("broken entry")
    name, extra = struct.unpack_from("<HH", head, 26)
    f.seek(entry.offset + 30 + name + extra)
    left = entry.compressed
    inflate = zlib.decompressobj(-15) if entry.method == 8 else None
    rest = b""
    while left or rest:
        if not rest:
            rest = _exactly(f, min(PIECE, left))
            left -= len(rest)
        if inflate is None:
            yield rest
            rest = b""
        else:
            out = inflate.decompress(rest, PIECE)
            rest = inflate.unconsumed_tail
            if out:
                yield out
            if inflate.eof:
                return
    while inflate is not None and not inflate.eof:  # what is still held back
        out = inflate.decompress(b"", PIECE)
        if not out:
            raise BadArchive("data ends early")
        yield out


def content(f: BinaryIO, entry: Entry, keep: bool = True) -> tuple[bytes | None, str | None]:
    """(bytes, error): read until the end or a limit; size, ratio and checksum are those of the bytes that came out."""
    if entry.encrypted:
        return None, "encrypted"
    if entry.method not in (0, 8):
        return None, f"compression method {entry.method}"
    most = A.MAX_INFO if entry.path.lower() == "comicinfo.xml" else A.MAX_ENTRY
    kept, n, crc = [], 0, 0
    try:
        for piece in _pieces(f, entry):
            n, crc = n + len(piece), zlib.crc32(piece, crc)
            why = limit_broken(n, entry.compressed, most)
            if why or n > entry.declared:
                return None, why or "size differs from declared"
            if keep:
                kept.append(piece)
    except (BadArchive, zlib.error) as e:
        return None, str(e)
    if n != entry.declared:
        return None, "size differs from declared"
    return (None, "wrong checksum") if crc != entry.crc else (b"".join(kept) if keep else None, None)


def is_junk(path: str) -> bool:
    """What archivers and desktops leave behind: the same paths as functions.paths.is_junk."""
    return any(p.lower() in ("__macosx", ".ds_store", "thumbs.db") or p.startswith("._") for p in path.split("/"))


def opened(uri: str) -> tuple[BinaryIO, int]:
    """A file on whatever file system its path names, open for reading anywhere in it, and its size."""
    system, path = file_system(uri)
    return system.open_input_file(path), system.get_file_info(path).size


def file_system(uri: str) -> tuple[pafs.FileSystem, str]:
    if uri.startswith("file:") or "://" not in uri:
        return pafs.LocalFileSystem(), "/" + uri.removeprefix("file:").lstrip("/") if uri.startswith("file:") else uri
    return pafs.FileSystem.from_uri(uri)


def listed(folder: str, recursive: bool, extensions: tuple[str, ...]) -> list[tuple[str, int]]:
    """(uri, size) of the archives in a folder, or of the one file that the path names, in the order of their paths."""
    system, path = file_system(folder)
    scheme = "file:" if isinstance(system, pafs.LocalFileSystem) else folder.split("://", 1)[0] + "://" + (folder.split("://", 1)[1].split("/", 1)[0] if system.type_name != "s3" else "")
    one = system.get_file_info(path)
    found = [one] if one.type == pafs.FileType.File else system.get_file_info(pafs.FileSelector(path, recursive=recursive))
    named = [(scheme + x.path, x.size) for x in found if x.type == pafs.FileType.File and (x is one or x.path.lower().endswith(extensions))]
    return sorted(named)


@dataclass
class Part(InputPartition):
    """Files, each with the range of places in it whose entries belong to this partition."""

    files: list[tuple[str, int, int, int]] = field(default_factory=list)


def _test(f: Filter) -> tuple[str, Callable] | None:
    """(column, test) of a filter that can be checked before anything is read."""
    column = f.attribute[0] if len(f.attribute) == 1 else None
    if column not in ("archive", "path", "declared_size"):
        return None
    simple = {EqualTo: lambda v: lambda x: x == v, StringStartsWith: lambda v: lambda x: x.startswith(v), StringEndsWith: lambda v: lambda x: x.endswith(v), StringContains: lambda v: lambda x: v in x, LessThan: lambda v: lambda x: x < v, LessThanOrEqual: lambda v: lambda x: x <= v, GreaterThan: lambda v: lambda x: x > v, GreaterThanOrEqual: lambda v: lambda x: x >= v}
    if isinstance(f, In):
        return column, lambda x, v=frozenset(f.value): x in v
    made = simple.get(type(f))
    return (column, made(f.value)) if made else None


class ArchiveReader(DataSourceReader):
    def __init__(self, options: dict):
        self.folder, self.mode = options["path"], options.get("mode", "directory")
        self.recursive = options.get("recursive", "false").lower() == "true"
        self.extensions = tuple(options.get("extensions", ".cbz,.zip").lower().split(","))
        self.split = int(options.get("split", SPLIT))
        self.filters: list[Filter] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if self.mode != "files" and _test(f):
                self.filters.append(f)
            else:
                yield f

    def _tests(self, columns: tuple[str, ...]) -> list[tuple[str, Callable]]:
        return [t for t in map(_test, self.filters) if t and t[0] in columns]

    def partitions(self) -> list[Part]:
        tests = self._tests(("archive",))
        out, room = [Part()], self.split
        for uri, size in listed(self.folder, self.recursive, self.extensions):
            if not all(t(uri) for _, t in tests):
                continue
            n = max(1, -(-size // self.split)) if self.mode == "content" else 1  # a directory, and a file's hash, come from one reading
            edges = [size * i // n for i in range(n + 1)]
            for lo, hi in zip(edges, edges[1:], strict=False):
                cost = hi - lo if self.mode != "directory" else min(size, PIECE)
                if out[-1].files and cost > room:
                    out.append(Part())
                    room = self.split
                out[-1].files.append((uri, size, lo, hi))
                room -= cost
        return out

    def read(self, part: Part) -> Iterator[pa.RecordBatch]:
        kinds = SCHEMAS[self.mode]
        names, rows, held = [c.split()[0] for c in kinds.split(", ")], [], 0
        for uri, _, lo, hi in part.files:
            for row in self._rows(uri, lo, hi):
                rows.append(row)
                held += 200 + (len(row[8] or b"") if self.mode == "content" else 0)
                if held > BATCH or len(rows) == 10_000:
                    yield batch(rows, names, kinds)
                    rows, held = [], 0
        if rows:
            yield batch(rows, names, kinds)

    def _rows(self, uri: str, lo: int, hi: int) -> Iterator[tuple]:
        f, size = opened(uri)
        with f:
            if self.mode == "files":
                digest, head = hashlib.sha256(), f.read(8)
                digest.update(head)
                while piece := f.read(PIECE):
                    digest.update(piece)
                yield uri, size, head, digest.hexdigest()
                return
            tests, total, nothing = self._tests(("path", "declared_size")), 0, (None,) * (len(SCHEMAS[self.mode].split(", ")) - 1)
            try:
                for e in directory(f, size):
                    total += 0 if e.is_dir else e.declared
                    if self.mode == "directory":
                        if all(t(e.path if c == "path" else e.declared) for c, t in tests):
                            yield uri, e.index, e.path, e.is_dir, e.unix_mode, e.encrypted, e.declared, e.compressed
                        continue
                    if e.is_dir or not (lo <= e.offset < hi or e.offset >= hi == size) or not all(t(e.path if c == "path" else e.declared) for c, t in tests):
                        continue
                    place = f.tell()
                    over = e.index >= A.MAX_ENTRIES or total > A.MAX_TOTAL
                    data, why = (None, "the archive is too large") if over else content(f, e, not is_junk(e.path))
                    f.seek(place)
                    yield uri, e.index, e.path, e.is_dir, e.unix_mode, e.encrypted, e.declared, e.compressed, data, why
            except BadArchive:
                if lo == 0 and not tests:
                    yield uri, *nothing


class ArchiveSource(DataSource):
    """format("archives"). Options: mode (directory, content, files), recursive, extensions, split (bytes of a partition)."""

    @classmethod
    def name(cls) -> str:
        return "archives"

    def schema(self) -> str:
        return SCHEMAS[self.options.get("mode", "directory")]

    def reader(self, schema) -> ArchiveReader:
        return ArchiveReader(dict(self.options))


def register(spark: SparkSession) -> SparkSession:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    reachable(spark).dataSource.register(ArchiveSource)
    return spark


def read(spark: SparkSession, folder: str, mode: str = "directory", recursive: bool = False, **options: str) -> DataFrame:
    """Rows of SCHEMAS[mode] for the archives in a folder; what is no archive has one row without path."""
    return register(spark).read.format("archives").options(mode=mode, recursive=str(recursive).lower(), **options).load(folder)
