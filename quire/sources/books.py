"""Book files: formats, PDF metadata, archives, comic info, images. Bytes are read where they are, by executors."""

from __future__ import annotations

import io
import re
import struct
import xml.parsers.expat as expat
import zlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from quire.functions import paths as P, text as T
from quire.operators import archive as A
from quire.session import reachable

from . import archives as Z, jpeg


def scan(spark: SparkSession, folder: str, recursive: bool = False, extensions: str = "[pP][dD][fF],[cC][bB][zZ]") -> DataFrame:
    """(path, content, source_hash) of the books in a folder, in any order. Other files are not read."""
    files = reachable(spark).read.format("binaryFile").option("pathGlobFilter", f"*.{{{extensions}}}").option("recursiveFileLookup", recursive).load(folder)
    return files.where(P.is_book("path")).select("path", "content", F.sha2("content", 256).alias("source_hash"))


def detected(books: DataFrame) -> DataFrame:
    """Adds format (pdf or cbz) and error, by extension and first bytes."""
    ext, head = F.lower(F.regexp_extract("path", r"\.([^./]+)\z", 1)), F.hex(F.substring("content", 1, 5))
    zipped = F.substring(head, 1, 8).isin("504B0304", "504B0506", "504B0708")
    fmt = F.when((ext == "pdf") & (head == "255044462D"), "pdf").when((ext == "cbz") & zipped, "cbz")
    why = F.when(~ext.isin("pdf", "cbz"), "unsupported extension").when(fmt.isNull(), "content does not fit the extension")
    return books.withColumn("format", fmt).withColumn("error", F.when(why.isNotNull(), F.struct(F.lit("BadArgs").alias("kind"), F.lit(2).alias("exit_code"), why.alias("message"))))


_ESCAPES = {"n": "\n", "r": "\r", "t": "\t", "b": "\b", "f": "\f", "(": "(", ")": ")", "\\": "\\"}
_ESCAPE = re.compile(r"\\(\r\n|[0-7]{1,3}|.)", re.S)


def decode_pdf_string(raw: str | None) -> str | None:
    """A PDF string as text: (literal) with escapes or <hex>; UTF-16 with its mark, else UTF-8 as far as it goes. Null for bad hex."""
    if not raw:
        return None
    if raw.startswith("<"):
        digits = re.sub(r"\s+", "", raw[1:-1])
        if re.search(r"[^0-9A-Fa-f]", digits):
            return None
        data = bytes.fromhex(digits + "0" * (len(digits) % 2))
    else:

        def one(m: re.Match) -> str:
            x = m[1]
            if x[0] in "01234567":
                return chr(int(x, 8) & 0xFF)
            return "" if x in ("\n", "\r", "\r\n") else _ESCAPES.get(x, x)

        data = b"".join(bytes([ord(c)]) if ord(c) < 256 else c.encode() for c in _ESCAPE.sub(one, raw[1:-1]))
    return data[2:].decode("utf-16-be", "replace") if data.startswith(b"\xfe\xff") else data.decode("utf-8", "replace")


@F.pandas_udf(StringType())
def pdf_string(raw: pd.Series) -> pd.Series:
    return raw.map(decode_pdf_string)


def pdf_info(c: Column, key: str) -> Column:
    """The raw first value of a key of the Info dictionary; bytes stand as Latin-1 characters."""
    return F.nullif(F.regexp_extract(c, rf"/{key}\s*(\((?:[^()\\]|\\.)*\)|<[0-9A-Fa-f\s]*>)", 1), F.lit(""))


def xmp_text(c: Column, tag: str) -> Column:
    found = F.regexp_extract(c, rf"(?s)<{tag}[^>]*>(.*?)</{tag}>", 1)
    item = F.regexp_extract(found, r"(?s)<rdf:li[^>]*>(.*?)</rdf:li>", 1)
    return T.clean_value(T.xml_unescape(T.strip_tags(F.when(item != "", item).otherwise(found))))


def xmp_items(c: Column, tag: str) -> Column:
    found = F.regexp_extract(c, rf"(?s)<{tag}[^>]*>(.*?)</{tag}>", 1)
    items = F.regexp_extract_all(found, F.lit(r"(?s)<rdf:li[^>]*>(.*?)</rdf:li>"), F.lit(1))
    return F.filter(F.transform(items, lambda x: T.clean_value(T.xml_unescape(T.strip_tags(x)))), lambda x: x.isNotNull())


def pdf_metadata(books: DataFrame) -> DataFrame:
    """(path, title, author, publisher, description, language, subjects): the Info dictionary first, then XMP."""
    raw, utf = F.decode("content", "ISO-8859-1"), F.col("content").cast("string")
    x = books.select("path", raw.alias("raw"), utf.alias("utf"))
    info = lambda k: T.clean_value(pdf_string(pdf_info(F.col("raw"), k)))
    xmp = lambda t: xmp_text(F.col("utf"), t)
    subjects = F.concat(F.coalesce(T.keywords(pdf_string(pdf_info(F.col("raw"), "Keywords"))), F.array().cast("array<string>")), xmp_items(F.col("utf"), "dc:subject"))
    return x.select("path", F.coalesce(info("Title"), xmp("dc:title")).alias("title"), F.coalesce(info("Author"), xmp("dc:creator")).alias("author"), F.coalesce(info("Publisher"), xmp("dc:publisher")).alias("publisher"), F.coalesce(info("Subject"), xmp("dc:description")).alias("description"), F.coalesce(info("Lang"), xmp("dc:language")).alias("language"), subjects.alias("subjects"))


ENTRY = Z.ENTRY


def entries(books: DataFrame) -> DataFrame:
    """ENTRY rows from the central directories of (path, content); what is no archive has one row without path."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in ENTRY.split(", ")]
        for b in batches:
            for archive, content in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                data = content.as_py()
                try:
                    rows = [(archive, e.index, e.path, e.is_dir, e.unix_mode, e.encrypted, e.declared, e.compressed) for e in Z.directory(io.BytesIO(data), len(data))]
                except Z.BadArchive:
                    rows = [(archive, *[None] * 7)]
                yield Z.batch(rows, names, ENTRY)

    reachable(books.sparkSession)
    return books.select("path", "content").mapInArrow(run, ENTRY)


def contents(books: DataFrame, entry_rows: DataFrame | None = None) -> DataFrame:
    """(archive, entry_index, path, bytes, error): each file read within its limits, its checksum, ratio and declared size held against what came out. Of what no page can be, the bytes are checked and not kept.

    Archives that break a rule of their directory are not opened: entry_rows, if given, are checked first. Archives too large for a row are read by sources.archives.
    """
    if entry_rows is not None:
        bad = A.verdicts(entry_rows).where("broken is not null").select(F.col("archive").alias("path"))
        books = books.join(bad, "path", "left_anti")
    kinds = "archive string, entry_index int, path string, bytes binary, error string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in kinds.split(", ")]
        for b in batches:
            for archive, content in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                data = content.as_py()
                f = io.BytesIO(data)
                try:
                    files = [e for e in Z.directory(io.BytesIO(data), len(data)) if not e.is_dir]
                except Z.BadArchive:
                    continue
                for e in files:
                    yield Z.batch([(archive, e.index, e.path, *Z.content(f, e, not Z.is_junk(e.path)))], names, kinds)

    reachable(books.sparkSession)
    return books.select("path", "content").mapInArrow(run, kinds)


def probe_image(data: bytes | None) -> tuple:
    """(media type, extension, width, height, error). The signature decides, not a name; the data of both kinds is read to its end."""
    if data is None or len(data) < 4:
        return None, None, None, None, None
    if data.startswith(b"\x89PNG\r\n\x1a\n"):
        return _png(data)
    if data.startswith(b"\xff\xd8"):
        return _jpeg(data)
    return None, None, None, None, None


def _png(data: bytes) -> tuple:
    at, size, bits, kind, raw = 8, None, 0, 0, []
    fail = lambda why: ("image/png", "png", None, None, why)
    while at + 12 <= len(data):
        n, name = struct.unpack(">I4s", data[at : at + 8])
        body = data[at + 8 : at + 8 + n]
        if len(body) < n or len(data) < at + 12 + n or zlib.crc32(name + body) != struct.unpack(">I", data[at + 8 + n : at + 12 + n])[0]:
            return fail("broken chunk")
        at += 12 + n
        if name == b"IHDR":
            if n != 13:
                return fail("broken header")
            size, bits, kind = struct.unpack(">II", body[:8]), body[8], body[9]
        elif name == b"acTL":
            return fail("animated")
        elif name == b"IDAT":
            raw.append(body)
        elif name == b"IEND":
            break
    else:
        return fail("no end")
    if not size or kind not in (0, 2, 3, 4, 6):
        return fail("broken header")
    w, h = size
    each = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}[kind] * bits
    wanted = h * (1 + (w * each + 7) // 8)
    if not w or not h or w > A.MAX_AXIS or h > A.MAX_AXIS or w * h > A.MAX_PIXELS or wanted > A.MAX_DECODED:
        return fail("too large")
    try:
        d = zlib.decompressobj()
        got = len(d.decompress(b"".join(raw), A.MAX_DECODED))
    except zlib.error:
        return fail("broken data")
    if got < wanted and data[28:29] != b"\x01":
        return fail("data too short")
    return "image/png", "png", w, h, None


def _jpeg(data: bytes) -> tuple:
    try:
        w, h = jpeg.size_of(data, A.MAX_PIXELS)
    except jpeg.BadImage as e:
        return "image/jpeg", "jpg", None, None, str(e)
    return ("image/jpeg", "jpg", None, None, "too large") if 4 * w * h > A.MAX_DECODED else ("image/jpeg", "jpg", w, h, None)


def probed(files: DataFrame) -> DataFrame:
    """Adds media_type, extension, width, height and probe_error to (path, bytes). An error is told for a signature or an image's extension that the bytes don't bear out; other files are none."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            got = pd.DataFrame([probe_image(x) for x in b["bytes"]], columns=["media_type", "extension", "width", "height", "probe_error"], index=b.index)
            for c in ("width", "height"):
                got[c] = got[c].astype("Int64")
            yield pd.concat([b, got], axis=1)

    more = [StructField("media_type", StringType()), StructField("extension", StringType()), StructField("width", IntegerType()), StructField("height", IntegerType()), StructField("probe_error", StringType())]
    kinds = StructType([*files.schema.fields, *more])
    out = reachable(files.sparkSession) and files.mapInPandas(run, kinds)
    return out.withColumn("probe_error", F.coalesce("probe_error", F.when(F.col("media_type").isNull() & P.has_image_extension("path") & ~P.is_junk("path"), F.lit("no image"))))


def parse_comic_info(data: bytes) -> dict:
    """Fields and pages of a ComicInfo file. Names count in any case, texts of one name run together; a DTD or an unknown entity is an error."""
    if len(data) > A.MAX_INFO:
        raise ValueError("comic info is too large")
    fields: dict[str, list[str]] = {}
    pages: list[dict] = []
    stack: list[str] = []
    parser = expat.ParserCreate()

    def start(name: str, attrs: dict) -> None:
        stack.append(name.rpartition(":")[2].lower())
        if stack[-1] == "page":
            own = {k.lower(): v for k, v in attrs.items()}
            kinds = {t.lower() for t in re.split(r"[\s,;|]+", own.get("type", "")) if t}
            image = own.get("image", "").strip()
            pages.append({"image": int(image) if image.isdigit() else len(pages), "deleted": "deleted" in kinds, "front_cover": "frontcover" in kinds})

    def refuse(*_: object) -> None:
        raise ValueError("a document type is not allowed")

    parser.StartElementHandler, parser.EndElementHandler = start, lambda _: stack.pop()
    parser.CharacterDataHandler = lambda s: fields.setdefault(stack[-1], []).append(s)
    parser.StartDoctypeDeclHandler = parser.EntityDeclHandler = refuse
    try:
        parser.Parse(data, True)
    except expat.ExpatError as e:
        raise ValueError(str(e)) from e
    get = lambda k: " ".join("".join(fields.get(k, [])).split()) or None
    return {"title": get("title"), "writer": get("writer"), "publisher": get("publisher"), "summary": get("summary"), "language": get("languageiso"), "right_to_left": (get("manga") or "").lower() == "yesandrighttoleft", "pages": pages}


COMIC_INFO = "archive string, title string, writer string, publisher string, summary string, language string, right_to_left boolean, pages array<struct<image:int,deleted:boolean,front_cover:boolean>>, error string"


_INFO_PAGES = pa.list_(pa.struct([("image", pa.int32()), ("deleted", pa.bool_()), ("front_cover", pa.bool_())]))


def comic_info(files: DataFrame) -> DataFrame:
    """COMIC_INFO rows from the root ComicInfo.xml files among (archive, path, bytes)."""
    kinds = {"right_to_left": pa.bool_(), "pages": _INFO_PAGES}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in COMIC_INFO.split(", ")]
        for b in batches:
            rows = []
            for archive, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                try:
                    rows.append({"archive": archive, **parse_comic_info(data), "error": None})
                except ValueError as e:
                    rows.append({"archive": archive, "right_to_left": False, "pages": [], "error": str(e)})
            yield pa.RecordBatch.from_arrays([pa.array([r.get(n) for r in rows], kinds.get(n, pa.string())) for n in names], names)

    return reachable(files.sparkSession) and files.where("lower(path) = 'comicinfo.xml' and bytes is not null").select("archive", "bytes").mapInArrow(run, COMIC_INFO)
