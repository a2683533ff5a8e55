"""A folder of books from scan to files."""

import json
import zipfile

from quire.__main__ import resolve_key
from quire.operators import batch as B
from quire.plans import folder as D
from quire.plans.convert import Options, recognised
from quire.plans.samples import comic, png
from quire.sources import payloads as Y

def test_folder(spark, tmp_path):
    def provider(content: bytes, options: dict) -> str:
        from quire.sources.providers import ProviderError

        text = content.decode()
        if "bad" in text:
            raise ProviderError("refused", 400)
        return json.dumps({"pages": [{"index": 0, "markdown": f"# Title\n{text}"}, {"index": 1, "markdown": "# Next\nmore"}]})

    src, out, cache = tmp_path / "in", tmp_path / "out", tmp_path / "cache"
    (src / "sub").mkdir(parents=True)
    (src / "a.pdf").write_bytes(b"%PDF-1.4 /Author (Jo Doe)")
    (src / "bad.pdf").write_bytes(b"%PDF-1.4 bad")
    (src / "c.cbz").write_bytes(comic())
    (src / "a.cbz").write_bytes(comic(1))
    (src / "junk.cbz").write_bytes(b"PK\x03\x04 none")
    (src / "fake.pdf").write_bytes(b"text")
    (src / "sub/e.cbz").write_bytes(comic(2))
    rows = {r.path: r for r in D.convert_folder(spark, str(src), str(out), str(cache), provider, D.Settings(recursive=True)).collect()}
    assert {p: (r.status, r.kind, r.exit_code) for p, r in rows.items()} == {"a.pdf": ("done", None, 0), "bad.pdf": ("error", "Api", 3), "c.cbz": ("done", None, 0), "a.cbz": ("done", None, 0), "junk.cbz": ("error", "BadArgs", 2), "fake.pdf": ("error", "BadArgs", 2), "sub/e.cbz": ("done", None, 0)}
    assert rows["a.cbz"].output_path == "a.epub" and rows["a.pdf"].output_path == "a-2.epub" and (out / "sub/e.epub").exists()
    assert (rows["a.pdf"].pages, rows["a.pdf"].chapters, rows["c.cbz"].images, rows["a.pdf"].cache_hit) == (2, 2, 2, False)
    assert "Jo Doe" in zipfile.ZipFile(out / "a-2.epub").read("OEBPS/content.opf").decode()
    again = {r.path: r for r in D.convert_folder(spark, str(src), str(out), str(cache), None, D.Settings(recursive=True, delete_sources=True, debug=str(tmp_path / "debug"))).collect()}
    assert (tmp_path / "debug/a.pdf/normalized_chapters.md").read_text().startswith("# Title\n") and json.loads((tmp_path / "debug/a.pdf/ocr_payload.json").read_text())["pages"]
    assert again["a.pdf"].cache_hit and again["a.pdf"].status == "done" and not (src / "a.pdf").exists() and (src / "bad.pdf").exists()


def test_caches_of_other_programs_and_a_model(spark, tmp_path):
    import hashlib

    src, out, cache = tmp_path / "in", tmp_path / "out", tmp_path / "cache"
    src.mkdir()
    cache.mkdir()
    (src / "B.pDf").write_bytes(b"%PDF-1.4")
    (src / "c.CBz").write_bytes(comic())
    key = hashlib.sha256(b"%PDF-1.4" + b"defaulthtml11" + b"1" + D.VERSION.encode()).hexdigest()
    (cache / f"{key}.ocr.json").write_text(json.dumps({"pages": [{"index": 0, "markdown": "# Kept\ntext"}]}))
    (cache / "broken.ocr.json").write_text("{")
    asked = []

    def model(content: bytes, options: dict) -> str:
        return json.dumps({"publisher": "House", "subjects": ["s"]})

    rows = {r.path: r for r in D.convert_folder(spark, str(src), str(out), str(cache), None, D.Settings(), model=model).collect()}
    assert {p: (r.status, r.cache_hit) for p, r in rows.items()} == {"B.pDf": ("done", True), "c.CBz": ("done", False)}
    assert "<dc:publisher>House</dc:publisher>" in zipfile.ZipFile(out / "B.epub").read("OEBPS/content.opf").decode()
    again = D.convert_folder(spark, str(src), str(tmp_path / "again"), str(cache), None, D.Settings(), model=lambda *_: asked.append(1) or "{}").collect()
    assert len(again) == 2 and "House" in zipfile.ZipFile(tmp_path / "again/B.epub").read("OEBPS/content.opf").decode()


def test_broken_comic_info_fails_the_book(spark, tmp_path):
    import io

    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        z.writestr("1.png", png())
        z.writestr("ComicInfo.xml", "<ComicInfo><Title>x")
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.cbz").write_bytes(data.getvalue())
    (tmp_path / "in/b.cbz").write_bytes(comic())
    (tmp_path / "in/c.cbz").write_bytes(comic(info='<ComicInfo><Pages><Page Image="0" Type="Deleted"/><Page Image="1" Type="Deleted"/><Page Image="2" Type="Deleted"/></Pages></ComicInfo>'))
    rows = {r.path: r for r in D.convert_folder(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "cache"), settings=D.Settings(check_packages=True)).collect()}
    assert (rows["a.cbz"].status, rows["a.cbz"].kind, rows["b.cbz"].status) == ("error", "BadArgs", "done") and not (tmp_path / "out/a.epub").exists()
    assert (rows["c.cbz"].kind, rows["c.cbz"].message) == ("BadArgs", "the comic info marks every page as deleted")


def test_every_file_of_a_package_is_in_its_manifest(spark):
    import base64
    import re

    payload = {"pages": [{"index": 0, "markdown": "# One\n![x](i.png)", "images": [{"id": "i.png", "image_base64": base64.b64encode(png()).decode()}]}, {"index": 1, "markdown": "# Two"}]}
    x = spark.createDataFrame([("d", "in/b.pdf", "00", json.dumps(payload), None, None, None, None)], "doc_id string, path string, source_hash string, json string, title string, author string, publisher string, language string")
    for comic_mode in (False, True):
        out = recognised(x.withColumn("payload", Y.parsed("json")).drop("json"), Options(comic=comic_mode))
        files = {r.path: bytes(r.bytes) for r in out["entries"].collect()}
        opf = files["OEBPS/content.opf"].decode()
        hrefs = dict(re.findall(r'<item id="([^"]+)" href="([^"]+)"', opf))
        assert {f"OEBPS/{h}" for h in hrefs.values()} == set(files) - {"mimetype", "META-INF/container.xml", "OEBPS/content.opf"}
        refs = re.findall(r'<itemref idref="([^"]+)"', opf)
        assert set(refs) == {i for i, h in hrefs.items() if h.startswith("text/")} and (refs[0] == "cover") is not comic_mode
        assert ("rendition:spread" in opf and 'prefix="rendition:' in opf) is comic_mode


def test_comic_mode(spark):
    import base64

    payload = {"pages": [{"index": 0, "markdown": "![x](i.png)", "images": [{"id": "i.png", "image_base64": base64.b64encode(png()).decode()}]}, {"index": 1, "markdown": "no image"}]}
    x = spark.createDataFrame([("d", "in/b.pdf", "00", json.dumps(payload), None, None, None, None)], "doc_id string, path string, source_hash string, json string, title string, author string, publisher string, language string")
    out = recognised(x.withColumn("payload", Y.parsed("json")).drop("json"), Options(comic=True))
    assert [r.file_name for r in out["chapters"].collect()] == ["page-0001.xhtml"] and out["books"].first().title == "b"
    assert '<img src="../images/i.png"' in out["chapters"].first().xhtml


def test_generated(spark):
    jobs = spark.createDataFrame([("a", True), ("b", False)], "doc_id string, needs_generation boolean")
    pages = spark.createDataFrame([("a", 0, "text"), ("b", 0, "text")], "doc_id string, page_index long, markdown string")
    got = D.with_generated(jobs, pages, lambda content, _: json.dumps({"title": content.decode()[:4], "subjects": ["s"]})).collect()
    assert [(r.doc_id, r.title, r.subjects) for r in got] == [("a", "Page", ["s"])]


def test_progress_and_queue(spark):
    x = spark.createDataFrame([("a", "pdf"), ("b", "cbz")], "doc_id string, format string")
    got = B.progress_plan(x, validate=True).collect()
    assert {(r.doc_id, r.total_steps) for r in got} == {("a", 6), ("b", 5)} and max(r.step for r in got) == 6
    jobs = spark.createDataFrame([(0, "x/b10.pdf", "done"), (1, "B2.pdf", "pending"), (2, "a.pdf", "error")], "input_order int, path string, status string")
    order = lambda *a: [r.input_order for r in B.sorted_queue(jobs, *a).orderBy("place").collect()]
    assert order() == [2, 1, 0] and order("file", False) == [0, 1, 2] and order("status") == [1, 0, 2]
    outcomes = jobs.selectExpr("*", "1L AS pages", "2L AS chapters", "0L AS images", "true AS cache_hit")
    assert B.report(outcomes) == ["1 converted, 1 failed", "1 pages, 2 chapters, 0 images, 1 from cache"]


def test_key(monkeypatch):
    monkeypatch.setenv("OCR_API_KEY", " e ")
    assert resolve_key(None) == "e" and resolve_key("k") == "k" and resolve_key("") is None
