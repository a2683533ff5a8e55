"""Files: formats, archives, images, caches, conversions, packages, streams."""

import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from quire.functions import paths as P
from quire.operators import archive as A, batch as B
from quire.plans import convert
from quire.plans.samples import comic, png
from quire.sinks import epub as S
from quire.sources import books as K, payloads as Y, providers as V
from quire.streaming import ingest

IMAGE = "aGVsbG8="
PAYLOAD = {"model": "m", "pages": [{"index": 1, "markdown": "# Two\nlast"}, {"index": 0, "markdown": "# One\n![p](pic.png)\n\n[t.html](t.html)", "images": [{"id": "pic.png", "image_base64": IMAGE, "top": 1}], "tables": [{"id": "t.html", "html": "<table><tr><td>1</td></tr></table>"}]}]}


def test_scan_and_formats(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    for name, data in (("b.pdf", b"%PDF-1.4\n"), ("a.CBZ", b"PK\x03\x04x"), ("c.pdf", b"nothing"), ("d.txt", b"%PDF-"), ("sub/e.pdf", b"%PDF-1.7")):
        (tmp_path / name).write_bytes(data)
    flat = K.detected(K.scan(spark, str(tmp_path))).orderBy(P.path_key("path")).collect()
    assert [(r.path.rpartition("/")[2], r.format, r.error and r.error.exit_code) for r in flat] == [("a.CBZ", "cbz", None), ("b.pdf", "pdf", None), ("c.pdf", None, 2)]
    assert K.scan(spark, str(tmp_path), recursive=True).count() == 4


def test_pdf_metadata(spark):
    pdf = rb"%PDF-1.4 << /Title (A \(b\) \101\n) /Author <FEFF00410042> /Subject (About) /Keywords (x, y;X) /Lang (fr) >> <dc:publisher><rdf:Bag><rdf:li>P &amp; Q</rdf:li></rdf:Bag></dc:publisher><dc:subject><rdf:Bag><rdf:li>z</rdf:li><rdf:li>w</rdf:li></rdf:Bag></dc:subject>"
    r = K.pdf_metadata(spark.createDataFrame([("a.pdf", pdf)], "path string, content binary")).first()
    assert (r.title, r.author, r.publisher, r.description, r.language, r.subjects) == ("A (b) A", "AB", "P & Q", "About", "fr", ["x", "y", "X", "z", "w"])
    assert K.decode_pdf_string("<4>") == "@" and K.decode_pdf_string("<4g>") is None and K.decode_pdf_string("(a\\\nb)") == "ab"


def test_natural_order(spark):
    paths = ["chapter10/1", "chapter2/10", "chapter2/2", "chapter2/1", "page01", "page1", "Page1", "a", "a/b", "007", "7"]
    got = [r.p for r in spark.createDataFrame([(p,) for p in paths], "p string").orderBy(P.natural_key("p")).collect()]
    assert got == ["7", "007", "a", "a/b", "chapter2/1", "chapter2/2", "chapter2/10", "chapter10/1", "Page1", "page1", "page01"]


@pytest.mark.parametrize(
    ("change", "broken"),
    [({}, None), ({"path": "../a.png"}, "unsafe_path"), ({"path": "/a.png"}, "unsafe_path"), ({"unix_mode": 0o120777}, "irregular_entry"), ({"unix_mode": 0}, None), ({"encrypted": True}, "encrypted"), ({"declared_size": 1000, "compressed_size": 1}, None), ({"declared_size": 1001, "compressed_size": 1}, "ratio_exceeded"), ({"declared_size": (100 << 20) + 1, "compressed_size": 1 << 30}, "entry_too_large"), ({"path": "notes.txt"}, "no_pages")],
)
def test_rules(spark, change, broken):
    row = {"archive": "a", "entry_index": 0, "path": "p/1.png", "is_dir": False, "unix_mode": 0o100644, "encrypted": False, "declared_size": 10, "compressed_size": 10} | change
    assert A.verdicts(spark.createDataFrame([tuple(row.values())], K.ENTRY)).first().broken == broken


def test_two_infos_break_an_archive(spark):
    rows = [("a", i, p, False, None, False, 1, 1) for i, p in enumerate(("1.png", "ComicInfo.xml", "comicinfo.XML"))]
    assert A.verdicts(spark.createDataFrame(rows, K.ENTRY)).first().broken == "duplicate_info"


def test_images():
    assert K.probe_image(png(3, 4)) == ("image/png", "png", 3, 4, None)
    assert K.probe_image(png(animated=True))[4] == "animated" and K.probe_image(png()[:-3])[4] and K.probe_image(png().replace(b"IDAT", b"IDAX"))[4]
    assert K.probe_image(b"text")[0] is None and K.probe_image(None)[0] is None
    assert K.probe_image(b"\xff\xd8\xff\xd9")[4] == "no frame"


def test_comic_info():
    x = K.parse_comic_info(b'<?xml version="1.0" encoding="windows-1252"?><ComicInfo><Title>A<![CDATA[ & ]]>B&#33;\xe9</Title><Manga>Yes</Manga><Pages><Page Type="Deleted"/><Page Image="5" Type="Other, FrontCover"/></Pages></ComicInfo>')
    assert (x["title"], x["right_to_left"]) == ("A & B!\xe9", False)
    assert x["pages"] == [{"image": 0, "deleted": True, "front_cover": False}, {"image": 5, "deleted": False, "front_cover": True}]
    for bad in (b'<!DOCTYPE C SYSTEM "http://127.0.0.1:1/x"><C/>', b"<!DOCTYPE C><C/>", b"<C>&x;</C>", b"<C>"):
        with pytest.raises(ValueError):
            K.parse_comic_info(bad)


def test_comic_conversion(spark):
    books = spark.createDataFrame([("dir/x.cbz", comic())], "path string, content binary").withColumn("source_hash", F.sha2("content", 256))
    files = K.contents(books, K.entries(books))
    assert files.where("error is not null").count() == 0
    pages = K.probed(files).where("media_type is not null").select("archive", F.col("entry_index").alias("source_index"), F.col("path").alias("source_path"), "media_type", "extension", "width", "height", "bytes")
    out = convert.comics(books.select(F.col("path").alias("archive"), "source_hash"), pages, K.comic_info(files))
    book = out["books"].first()
    assert (book.title, book.author, book.language, book.direction, book.cover_image) == ("Book & 0", "W0", "ja", "rtl", "page-0001.png")
    assert out["chapters"].count() == 2
    opf = next(r.bytes for r in out["entries"].collect() if r.path.endswith("content.opf")).decode()
    assert 'page-progression-direction="rtl"' in opf and "pre-paginated" in opf


def test_broken_archives(spark):
    data = bytearray(comic())
    data[60] ^= 0xFF
    books = spark.createDataFrame([("a.cbz", bytes(data)), ("b.cbz", b"no archive")], "path string, content binary")
    entries = K.entries(books)
    assert entries.where("archive = 'b.cbz'").first().path is None
    assert K.contents(books.where("path = 'a.cbz'")).where("error is not null").count() == 1


def jobs(spark, payload, doc="d1"):
    none = None
    x = spark.createDataFrame([(doc, "in/My Book.pdf", "ab" * 32, payload, none, none, none, none)], "doc_id string, path string, source_hash string, json string, title string, author string, publisher string, language string")
    return x.withColumn("payload", Y.parsed("json")).drop("json")


def test_recognised_conversion(spark, tmp_path):
    out = convert.recognised(jobs(spark, json.dumps(PAYLOAD)))
    assert [r.title for r in out["chapters"].orderBy("chapter_no").collect()] == ["One", "Two"]
    text = out["chapters"].orderBy("chapter_no").first().markdown
    assert "<table>" in text and "t.html" not in text and "../images/pic.png" in text
    assert out["books"].first().cover_image == "pic.png" and out["books"].first().title == "One" and out["errors"].count() == 0
    done = S.write_books(out["entries"], str(tmp_path)).first()
    again = (tmp_path / "d1.epub").read_bytes()
    assert done.error is None and S.write_books(out["entries"], str(tmp_path)).first().bytes == len(again) and (tmp_path / "d1.epub").read_bytes() == again
    names = zipfile.ZipFile(io.BytesIO(again)).infolist()
    assert names[0].filename == "mimetype" and names[0].compress_type == zipfile.ZIP_STORED
    assert [n.filename for n in names][-1] == "OEBPS/images/pic.png"
    without = convert.recognised(jobs(spark, json.dumps(PAYLOAD)), convert.Options(include_images=False))
    assert "images" not in without["chapters"].first().markdown and without["books"].first().cover_image == "pic.png"


def test_a_bad_document_is_an_error_of_its_own(spark):
    bad = json.loads(json.dumps(PAYLOAD))
    bad["pages"][1]["images"][0]["image_base64"] = "!"
    both = jobs(spark, json.dumps(bad), "bad").unionByName(jobs(spark, json.dumps(PAYLOAD), "good")).unionByName(jobs(spark, '{"pages": []}', "empty"))
    out = convert.recognised(both)
    assert {(r.doc_id, r.message) for r in out["errors"].collect()} == {("bad", "image is not base64"), ("empty", "no readable content")}
    assert {r.doc_id for r in out["books"].collect()} == {"good"}


def test_payloads_and_caches(spark, tmp_path):
    parse = lambda s: spark.createDataFrame([(s,)], "j string").select(Y.parsed("j").alias("p")).first().p
    assert parse("{broken") is None and parse('{"pages": [{"markdown": "x"}]}') is None and parse('{"pages": [{"index": 0, "images": [{"image_base64": "x"}]}]}') is None
    assert parse('{"pages": [{"index": 0}]}').pages[0]["index"] == 0
    (tmp_path / "k1.ocr.json").write_text(json.dumps(PAYLOAD, indent=1))
    (tmp_path / "k2.ocr.json").write_text("{")
    got = {r.cache_key: r.payload for r in Y.read_cache(spark, str(tmp_path)).collect()}
    assert got["k1"].model == "m" and got["k2"] is None
    wanted = spark.createDataFrame([("k1",), ("k2",), ("k3",)], "cache_key string")
    cache = Y.read_cache(spark, str(tmp_path))
    assert {r.cache_key: r.cache_hit for r in B.cached(wanted, cache).collect()} == {"k1": True, "k2": False, "k3": False}
    assert {r.cache_key for r in B.to_recognise(wanted, cache).collect()} == {"k2", "k3"}


def test_retries():
    waits, calls = [], []

    def call():
        calls.append(1)
        if len(calls) < 4:
            raise V.ProviderError("busy", 429 if len(calls) == 1 else None)
        return "done"

    assert V.with_retries(call, waits.append) == "done" and waits == [0.8, 1.6, 3.2]
    with pytest.raises(V.ProviderError):
        V.with_retries(lambda: (_ for _ in ()).throw(V.ProviderError("no", 400)), waits.append)
    assert len(waits) == 3 and V.is_retryable(503) and not V.is_retryable(404)


def test_provider(spark):
    x = spark.createDataFrame([("k", b"# A\fb"), ("k", b"# A\fb")], "cache_key string, content binary")
    r = V.recognised(x, V.fake).collect()
    assert len(r) == 1 and [p["markdown"] for p in json.loads(r[0].json)["pages"]] == ["# A", "b"]


def test_publish(tmp_path):
    place = tmp_path / "out.epub"
    place.write_text("old")
    write = lambda p: open(p, "w").write("new")
    assert S.publish(str(place), write, lambda _: "invalid") == "invalid" and place.read_text() == "old"
    link = tmp_path / "link.epub"
    link.symlink_to(place)
    assert S.publish(str(link), write, source=str(place)) and place.read_text() == "old"
    assert S.publish(str(place), write) is None and place.read_text() == "new" and sorted(p.name for p in tmp_path.iterdir()) == ["link.epub", "out.epub"]


def test_a_program_checks_packages(tmp_path):
    def program(text, code):
        place = tmp_path / f"check-{code}-{len(text)}"
        place.write_text(f"#!/bin/sh\necho '{text}'\necho \"$1\" >&2\nexit {code}\n")
        place.chmod(0o755)
        return str(place)

    assert S.checker(program("fine", 0))("x") is None
    assert S.checker(program("WARNING a", 0))("x") is None
    assert S.checker(program("WARNING a", 0), fail_on_warnings=True)("x").startswith("0 errors, 1 warnings\nWARNING a")
    assert S.checker(program("ERROR a ERROR b", 1))("the.epub") == "2 errors, 0 warnings\nERROR a ERROR b\n\nthe.epub\n"
    assert "can't be run" in S.checker(str(tmp_path / "none"))("x")


def test_output_paths(spark):
    x = spark.createDataFrame([(1, "a/Book.pdf"), (2, "a/book.CBZ"), (3, "a/book-2.pdf"), (4, "b/book"), (5, "a/BOOK.pdf")], "input_order int, path string")
    got = {r.input_order: r.output_path for r in B.unique_paths(x).collect()}
    assert got == {1: "a/Book.epub", 2: "a/book-2.epub", 3: "a/book-2-2.epub", 4: "b/book.epub", 5: "a/BOOK-3.epub"}


@pytest.mark.parametrize(("a", "b", "newer"), [("v1.2.0", "1.1.9", True), ("1.2", "1.2.0", False), ("1.10", "1.9", True), ("1.2.0-beta", "1.2.0", False), ("x", "0.0.1", False)])
def test_versions(spark, a, b, newer):
    assert spark.range(1).select(P.is_newer(F.lit(a), F.lit(b))).first()[0] is newer


def test_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.pdf").write_bytes(b"%PDF-1.4")
    (tmp_path / "in/b.txt").write_bytes(b"x")
    run = lambda: ingest.each_batch(ingest.books(spark, str(tmp_path / "in")), lambda b: K.detected(b).select("path", "format"), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination(120)
    run()
    (tmp_path / "in/c.pdf").write_bytes(b"%PDF-1.5")
    run()
    rows = spark.read.parquet(str(tmp_path / "out")).collect()
    assert sorted((r.path.rpartition("/")[2], r.format) for r in rows) == [("a.pdf", "pdf"), ("c.pdf", "pdf")]


def test_stage_stream(spark, tmp_path):
    (tmp_path / "e.json").write_text("\n".join(json.dumps({"doc": d, "stage": s, "seq": q}) for d, s, q in ((1, "a", 1), (1, "b", 2), (2, "a", 1))))
    x = ingest.latest(ingest.payloads(spark, str(tmp_path), "doc long, stage string, seq long"))
    q = x.writeStream.outputMode("complete").format("memory").queryName("stages").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert {(r.doc, r.stage) for r in spark.table("stages").collect()} == {(1, "b"), (2, "a")}
