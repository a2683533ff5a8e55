"""Packages of archives: each archive is opened once, and staging changes no row."""

import os

import pytest
from pyspark.sql import functions as F

from quire import plans
from quire.plans import convert
from quire.plans.samples import comic
from quire.session import Staged
from quire.sources import books as K

DATA = os.environ.get("QUIRE_TESTDATA", "/root/testdata/sf0.001")


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")
def test_packages_come_from_a_small_plan(spark):
    plan = plans.QUERIES["comic_packages"](spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
    assert (plan.count("MapInPandas"), plan.count("MapInArrow"), plan.count("archives")) == (0, 0, 0)
    assert 0 < plan.count("Join ") < 12


def test_staged_comics_are_the_same(spark):
    books = spark.createDataFrame([(f"dir/{i}.cbz", comic(i)) for i in range(5)], "path string, content binary").withColumn("source_hash", F.sha2("content", 256))
    files = K.contents(books, K.entries(books))
    pages = K.probed(files).where("media_type is not null").select("archive", F.col("entry_index").alias("source_index"), F.col("path").alias("source_path"), "media_type", "extension", "width", "height", "bytes")
    own = books.select(F.col("path").alias("archive"), "source_hash")
    plain, staged = (convert.comics(own, pages, K.comic_info(files), staged=s) for s in (None, Staged(spark, "test")))
    for k in plain:
        got, want = (sorted(map(repr, x[k].select(sorted(plain[k].columns)).collect())) for x in (staged, plain))
        assert got == want and got
