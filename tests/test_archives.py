"""Archives as a data source: directories, contents in bounded pieces, pushed filters, large files."""

import io
import os
import resource
import struct
import zipfile
import zlib

import pytest
from pyspark.sql import functions as F

from quire.operators import archive as A
from quire.plans.samples import png
from quire.sources import archives as Z, books as K


def packed(files, method=zipfile.ZIP_DEFLATED, comment=b""):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", method) as z:
        for path, data in files:
            z.writestr(zipfile.ZipInfo(path, (1980, 1, 1, 0, 0, 0)), data, method)
        z.comment = comment
    return out.getvalue()


def listed(data):
    return list(Z.directory(io.BytesIO(data), len(data)))


def one(data, index=0):
    return Z.content(io.BytesIO(data), listed(data)[index])


@pytest.mark.parametrize("method", [zipfile.ZIP_STORED, zipfile.ZIP_DEFLATED])
def test_same_as_the_standard_library(method):
    files = [("a.txt", b"x" * 200_000), ("ü/é.png", png()), ("empty", b""), ("dir/", b""), *((f"n{i}", os.urandom(i)) for i in range(0, 3000, 7))]
    data = b"before" + packed(files, method, b"a comment PK\5\6 in it")
    plain = b"before" + packed(files, method)  # the standard library stumbles over that comment
    want = zipfile.ZipFile(io.BytesIO(plain)).infolist()
    got = listed(data)
    assert [(e.path, e.declared, e.compressed, e.crc, e.is_dir, e.unix_mode) for e in got] == [(x.filename, x.file_size, x.compress_size, x.CRC, x.is_dir(), x.external_attr >> 16) for x in want]
    f = io.BytesIO(data)
    assert [Z.content(f, e) for e in got] == [(zipfile.ZipFile(io.BytesIO(plain)).read(x), None) for x in want]


def test_wide_numbers(tmp_path):
    """64-bit sizes and places, as of an archive beyond 4 GiB: a sparse file, so that nothing is written."""
    place, size = tmp_path / "wide.zip", 5 << 30
    head = struct.pack("<4sHHHHHIIIHH", b"PK\3\4", 45, 0, 0, 0, 0, 0, 0xFFFFFFFF, 0xFFFFFFFF, 4, 20) + b"wide" + struct.pack("<HHQQ", 1, 16, size, size)
    extra = struct.pack("<HHQQ", 1, 16, size, size)
    entry = struct.pack("<4sHHHHHHIIIHHHHHII", b"PK\1\2", 45, 45, 0, 0, 0, 0, 0, 0xFFFFFFFF, 0xFFFFFFFF, 4, len(extra), 0, 0, 0, 0, 0) + b"wide" + extra
    at = len(head) + size
    end64 = struct.pack("<4sQHHIIQQQQ", b"PK\6\6", 44, 45, 45, 0, 0, 1, 1, len(entry), at) + struct.pack("<4sIQI", b"PK\6\7", 0, at + len(entry), 1)
    with place.open("wb") as f:
        f.write(head)
        f.seek(at)
        f.write(entry + end64 + struct.pack("<4sHHHHIIH", b"PK\5\6", 0, 0, 0xFFFF, 0xFFFF, 0xFFFFFFFF, 0xFFFFFFFF, 0))
    with place.open("rb") as f:
        (e,) = Z.directory(f, place.stat().st_size)
        assert (e.path, e.declared, e.compressed, e.offset) == ("wide", size, size, 0)
        assert [(x.file_size, x.filename) for x in zipfile.ZipFile(place).infolist()] == [(size, "wide")]


def test_observed_ratio():
    assert Z.limit_broken(1000, 1) is None and Z.limit_broken(1001, 1) == "expands too much"
    assert Z.limit_broken(1, 0) == "expands too much" and Z.limit_broken(0, 0) is None
    assert Z.limit_broken(A.MAX_ENTRY + 1, 1 << 40) == "too large" and Z.limit_broken(A.MAX_ENTRY, 1 << 40) is None


def rewritten(data, declared=None, compressed=None, crc=None, flags=None, method=None):
    """The first entry's numbers in the central directory changed."""
    at = data.index(b"PK\1\2")
    out = bytearray(data)
    for place, kind, value in ((8, "<H", flags), (10, "<H", method), (16, "<I", crc), (20, "<I", compressed), (24, "<I", declared)):
        if value is not None:
            struct.pack_into(kind, out, at + place, value)
    return bytes(out)


def test_what_came_out_is_held_against_what_was_declared():
    data = packed([("a", b"abc" * 1000)])
    assert one(data) == (b"abc" * 1000, None)
    assert one(rewritten(data, declared=2999))[1] == "size differs from declared"
    assert one(rewritten(data, declared=3001))[1] == "size differs from declared"
    assert one(rewritten(data, crc=1))[1] == "wrong checksum"
    assert one(rewritten(data, flags=1))[1] == "encrypted"
    assert one(rewritten(data, method=12))[1] == "compression method 12"
    bomb = packed([("a", b"\0" * 5_000_000)])
    few = len(zlib.compress(b"\0" * 5_000_000, 9)) // 6
    assert one(rewritten(bomb, compressed=few))[1] in ("expands too much", "data ends early")
    assert one(packed([("ComicInfo.xml", b"\0" * (A.MAX_INFO + 1))], zipfile.ZIP_STORED))[1] == "too large"


def test_broken_directories():
    data = packed([("a", b"b")])
    for bad in (b"", b"PK", data[:-1], data[:-30], data.replace(b"PK\1\2", b"PK\1\3"), data[30:]):
        with pytest.raises(Z.BadArchive):
            listed(bad)


def test_a_large_archive_takes_little_memory(spark, tmp_path):
    """3 GiB of zeros, stored: longer than a row can be, refused by its directory and, read nonetheless, at the limit of an entry."""
    size = 3 << 30
    head = struct.pack("<4sHHHHHIIIHH", b"PK\3\4", 20, 0, 0, 0, 0, 0, size, size, 5, 0) + b"1.png"
    entry = struct.pack("<4sHHHHHHIIIHHHHHII", b"PK\1\2", 20, 20, 0, 0, 0, 0, 0, size, size, 5, 0, 0, 0, 0, 0, 0) + b"1.png"
    with (tmp_path / "big.cbz").open("wb") as f:
        f.write(head)
        f.seek(len(head) + size)
        f.write(entry + struct.pack("<4sHHHHIIH", b"PK\5\6", 0, 0, 1, 1, len(entry), len(head) + size, 0))
    entries = Z.read(spark, str(tmp_path))
    assert A.verdicts(entries).first().broken == "entry_too_large"
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    with (tmp_path / "big.cbz").open("rb") as f:
        (e,) = Z.directory(f, size + 200)
    with (tmp_path / "big.cbz").open("rb") as f:
        assert Z.content(f, e, keep=False) == (None, "too large")
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 64 << 10  # KiB
    got = Z.read(spark, str(tmp_path), "content").collect()
    assert [(r.path, r.bytes, r.error) for r in got] == [("1.png", None, "the archive is too large")]


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    root = tmp_path_factory.mktemp("archives")
    for i in range(6):
        (root / ("deep" if i > 3 else "")).mkdir(exist_ok=True)
        (root / ("deep" if i > 3 else "") / f"{i} ü.CBZ").write_bytes(packed([(f"p/{j}.png", png(1 + j, 2)) for j in range(5)] + [("__MACOSX/x", b"fork"), ("ComicInfo.xml", b"<ComicInfo/>")]))
    (root / "none.zip").write_bytes(b"no archive")
    (root / "other.txt").write_bytes(b"text")
    return root


def test_directory_mode(spark, folder):
    flat, deep = Z.read(spark, str(folder)), Z.read(spark, str(folder), recursive=True)
    assert flat.select("archive").distinct().count() == 5 and deep.select("archive").distinct().count() == 7
    assert deep.where("path is null").first().archive == f"file:{folder}/none.zip"
    books = spark.read.format("binaryFile").option("pathGlobFilter", "*.CBZ").option("recursiveFileLookup", True).load(str(folder))
    want = K.entries(books.select("path", "content"))
    assert sorted(map(repr, deep.where("path is not null").collect())) == sorted(map(repr, want.collect()))


@pytest.mark.parametrize("split", ["1", "300", "100000"])
def test_content_in_ranges(spark, folder, split):
    """Every entry comes once, however a file is dealt."""
    got = Z.read(spark, str(folder), "content", recursive=True, split=split)
    books = spark.read.format("binaryFile").option("pathGlobFilter", "*.CBZ").option("recursiveFileLookup", True).load(str(folder)).select("path", "content")
    want = K.contents(books, K.entries(books))
    columns = ["archive", "entry_index", "path", "bytes", "error"]
    assert sorted(map(repr, got.where("path is not null").select(*columns).collect())) == sorted(map(repr, want.collect()))
    assert got.where("path is null").count() == 1
    if split == "300":
        assert got.rdd.getNumPartitions() > 6


def test_files_mode(spark, folder):
    got = {r.path: r for r in Z.read(spark, str(folder), "files").collect()}
    books = spark.read.format("binaryFile").load(str(folder)).where(F.lower("path").rlike(r"\.(cbz|zip)$"))
    want = {r.path: (r.length, r.h) for r in books.select("path", "length", F.sha2("content", 256).alias("h")).collect()}
    assert {p: (r.size, r.source_hash) for p, r in got.items()} == want and all(len(r.content) == 8 for r in got.values())


def test_filters_are_pushed(spark, folder):
    x = Z.read(spark, str(folder), "content", recursive=True)
    some = x.where((F.col("archive") == f"file:{folder}/1 ü.CBZ") & F.col("path").startswith("p/") & (F.col("declared_size") > 0) & F.col("path").isin("p/1.png", "p/3.png", "ComicInfo.xml"))
    assert sorted((r.path, r.bytes) for r in some.collect()) == [("p/1.png", png(2, 2)), ("p/3.png", png(4, 2))]
    reader = Z.ArchiveReader({"path": str(folder), "mode": "content", "recursive": "true"})
    assert list(reader.pushFilters([Z.EqualTo(("archive",), f"file:{folder}/1 ü.CBZ"), Z.StringEndsWith(("path",), ".png")])) == []
    parts = reader.partitions()
    assert [f[0] for p in parts for f in p.files] == [f"file:{folder}/1 ü.CBZ"]
    assert [b.num_rows for p in parts for b in reader.read(p)] == [5]
    left = Z.EqualTo(("error",), "x")
    assert list(reader.pushFilters([left])) == [left]
