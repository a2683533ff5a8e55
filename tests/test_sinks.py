"""The sink of files by name: whole files or none, packages in one pass, caches as other programs read them."""

import io
import json
import os
import zipfile

import pytest
from pyspark.sql import functions as F

from quire.sinks import files as S
from quire.sources import archives as Z, payloads as Y


def below(folder):
    return sorted(os.path.relpath(os.path.join(d, n), folder) for d, _, names in os.walk(folder) for n in names)


def test_files(spark, tmp_path):
    rows = [(f"d{i % 3}/{i} ü.bin", bytes([i]) * i) for i in range(50)]
    S.write_files(spark.createDataFrame(rows, "name string, bytes binary").repartition(4), str(tmp_path))
    assert below(tmp_path) == sorted(n for n, _ in rows)
    assert all((tmp_path / n).read_bytes() == d for n, d in rows)
    S.write_files(spark.createDataFrame([("d0/0 ü.bin", b"new")], "name string, bytes binary"), f"file:{tmp_path}")
    assert (tmp_path / "d0/0 ü.bin").read_bytes() == b"new" and len(below(tmp_path)) == 50
    S.write_files(spark.createDataFrame([], "name string, bytes binary"), str(tmp_path))
    assert len(below(tmp_path)) == 50


def test_a_failed_job_leaves_no_file(spark, tmp_path):
    (tmp_path / "old").write_bytes(b"old")
    fails = F.when(F.col("id") == 37, F.raise_error(F.lit("broken"))).otherwise(F.col("id").cast("string"))
    rows = spark.range(0, 40, 1, 4).select(F.concat(F.lit("n"), F.col("id").cast("string")).alias("name"), fails.cast("binary").alias("bytes"))
    with pytest.raises(Exception, match="broken"):
        S.write_files(rows, str(tmp_path))
    assert below(tmp_path) == ["old"] and os.listdir(tmp_path) == ["old"]


@pytest.mark.parametrize("name", ["../x", "a/../../x", "", "/", ".staging-1/x"])
def test_names_stay_below_the_folder(name):
    with pytest.raises(ValueError):
        S._safe(name)
    assert S._safe("/a//./b") == "a/b"


def test_packages(spark, tmp_path):
    entries = [(f"b{b}.epub", n, p, m, d) for b in range(5) for n, p, m, d in ((0, "mimetype", "stored", b"application/epub+zip"), (1, "OEBPS/ü.xhtml", "deflated", b"<p/>" * 1000), (7, "OEBPS/images/1.png", "stored", os.urandom(200)), (8, "empty", "deflated", b""))]
    df = spark.createDataFrame(entries, "name string, entry_no long, path string, method string, bytes binary")
    S.write_packages(df.orderBy(F.rand(3)), str(tmp_path))
    assert below(tmp_path) == [f"b{b}.epub" for b in range(5)]
    first = {p: p.read_bytes() for p in tmp_path.iterdir()}
    for p, data in first.items():
        own = [e for e in entries if e[0] == p.name]
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            assert z.testzip() is None and [(x.filename, z.read(x)) for x in z.infolist()] == [(e[2], e[4]) for e in own]
            assert [x.compress_type == zipfile.ZIP_STORED for x in z.infolist()] == [e[3] == "stored" for e in own]
        assert data[30:38] == b"mimetype" and data[38:58] == b"application/epub+zip"
    S.write_packages(df, str(tmp_path))
    assert {p: p.read_bytes() for p in tmp_path.iterdir()} == first
    got = Z.read(spark, str(tmp_path), "content", extensions=".epub").select("path", "bytes", "error").collect()
    assert sorted(map(tuple, got)) == sorted((e[2], e[4], None) for e in entries)


def test_caches_are_files_that_others_read(spark, tmp_path):
    """Answers go to <key>.<kind>.json and come back; broken files count as none."""
    payload = {"model": "m", "pages": [{"index": 0, "markdown": "x"}]}
    Y.write_cache(spark.createDataFrame([("k1", json.dumps(payload)), ("k2", "{")], "cache_key string, json string"), str(tmp_path))
    Y.write_cache(spark.createDataFrame([("k1", json.dumps({"title": "Cached Title", "subjects": ["history"]}))], "cache_key string, json string"), str(tmp_path), "metadata")
    assert below(tmp_path) == ["k1.metadata.json", "k1.ocr.json", "k2.ocr.json"]
    assert json.loads((tmp_path / "k1.ocr.json").read_text()) == payload
    got = {r.cache_key: r.payload for r in Y.read_cache(spark, str(tmp_path)).collect()}
    assert got["k1"].pages[0].markdown == "x" and got["k2"] is None
    meta = Y.read_cache(spark, str(tmp_path), "metadata").first()
    assert (meta.cache_key, meta.payload.title, meta.payload.subjects) == ("k1", "Cached Title", ["history"])
