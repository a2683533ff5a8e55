"""Upload, recognise, delete: whatever fails in between, no remote file is left."""

import json
import os
import random
import sys
import uuid

import pytest
from pyspark import cloudpickle

from quire.sources import remote as R
from quire.sources.providers import ProviderError


cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers don't find this module


class Fake:
    """A service whose files are files of a folder; it fails as the first bytes of a content tell it to."""

    def __init__(self, folder):
        self.folder = str(folder)

    def upload(self, content, name):
        if content.startswith(b"no-upload"):
            raise ProviderError("refused", 400)
        file_id = uuid.uuid4().hex
        with open(f"{self.folder}/{file_id}", "wb") as f:
            f.write(content)
        return file_id

    def recognise(self, file_id, options):
        with open(f"{self.folder}/{file_id}", "rb") as f:
            content = f.read()
        if content.startswith(b"refused"):
            raise ProviderError("bad file", 422)
        if content.startswith(b"busy") and not os.path.exists(f"{self.folder}/.{file_id}"):
            open(f"{self.folder}/.{file_id}", "w").close()
            raise ProviderError("busy", 503)
        if content.startswith(b"lost"):
            os._exit(1) if options.get("die") else None
            raise RuntimeError("the task is lost")
        return {b"empty": '{"pages": []}', b"words": "none"}.get(content[:5]) or json.dumps({"pages": [{"index": 0, "markdown": content.decode()}], "model": options.get("model")})

    def delete(self, file_id):
        try:
            with open(f"{self.folder}/{file_id}", "rb") as f:
                content = f.read()
        except FileNotFoundError:
            raise ProviderError("not found", 404) from None
        if content.startswith(b"stuck") and not os.path.exists(f"{self.folder}/.{file_id}"):
            open(f"{self.folder}/.{file_id}", "w").close()
            raise ProviderError("later", 500)
        os.unlink(f"{self.folder}/{file_id}")


@pytest.fixture
def service(tmp_path):
    (tmp_path / "remote").mkdir()
    return Fake(tmp_path / "remote")


def left(service):
    return [f for f in os.listdir(service.folder) if not f.startswith(".")]


def jobs(spark, contents):
    rows = [(f"k{i}", c) for i, c in enumerate(contents)]
    return spark.createDataFrame(rows + rows[:2], "cache_key string, content binary").repartition(3)


def test_nothing_is_left(spark, service, tmp_path):
    contents = [b"fine", b"no-upload", b"refused", b"busy", b"empty", b"words", b"stuck", *(b"page %d" % i for i in range(30))]
    journal = str(tmp_path / "journal")
    got = {r.cache_key: r for r in R.recognised(jobs(spark, contents), service, journal, {"model": "m"}, sleep=lambda _: None).collect()}
    assert len(got) == len(contents)
    assert {k: r.kind for k, r in got.items() if r.kind} == {"k1": "Api", "k2": "Api", "k4": "OcrSchema", "k5": "OcrSchema"}
    assert json.loads(got["k3"].json) == {"pages": [{"index": 0, "markdown": "busy"}], "model": "m"} and json.loads(got["k6"].json)["pages"]
    assert len(left(service)) == 1  # the one that could not be deleted
    assert [(r.cache_key, r.error) for r in R.swept(spark, service, journal).collect()] == [("k6", None)]
    assert left(service) == [] and os.listdir(journal) == [] and R.swept(spark, service, journal).count() == 0


def test_a_lost_task_leaves_files_to_the_journal(spark, service, tmp_path):
    journal = str(tmp_path / "journal")
    contents = [b"lost", *(b"page %d" % i for i in range(20))]
    random.Random(1).shuffle(contents)
    with pytest.raises(Exception, match="lost"):
        R.recognised(jobs(spark, contents), service, journal, sleep=lambda _: None).collect()
    known = {json.loads((tmp_path / "journal" / f).read_text())["file_id"] for f in os.listdir(journal)}
    assert set(left(service)) <= known and known
    assert all(r.error is None for r in R.swept(spark, service, journal).collect())
    assert left(service) == [] and os.listdir(journal) == []


def test_files_are_kept_if_asked(spark, service, tmp_path):
    assert R.recognised(jobs(spark, [b"a", b"b"]), service, str(tmp_path / "journal"), keep_remote=True).count() == 2
    assert len(left(service)) == 2 and os.listdir(tmp_path / "journal") == []
