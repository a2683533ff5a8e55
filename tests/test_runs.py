"""Runs that are cancelled and taken up again, and the command line."""

import os
import threading
import time

import pytest

from quire import __main__ as M
from quire.plans import folder as D
from quire.plans.runs import Run
from quire.plans.samples import comic


@pytest.fixture
def books(tmp_path):
    (tmp_path / "in").mkdir()
    for i in range(4):
        (tmp_path / f"in/{i}.cbz").write_bytes(comic(i))
    (tmp_path / "in/4.pdf").write_bytes(b"text")
    return tmp_path


def test_a_cancelled_run_is_taken_up_again(spark, books):
    run, out = Run(spark, str(books / "run")), str(books / "out")
    run.enqueue(str(books / "in"))
    stop = lambda: (time.sleep(1), run.cancel())  # noqa: E731  the first batch ends, no second one begins
    done = threading.Thread(target=stop)
    done.start()
    counts = run.convert(str(books / "in"), out, str(books / "cache"), batch=2)
    done.join()
    assert run.cancelled and counts == {"pending": 3, "done": 2, "error": 0} and sorted(os.listdir(out)) == ["0.epub", "1.epub"]
    first = {p: os.stat(f"{out}/{p}").st_mtime_ns for p in os.listdir(out)}
    again = Run(spark, str(books / "run"))
    assert again.convert(str(books / "in"), out, str(books / "cache"), batch=10) == {"pending": 0, "done": 4, "error": 1}
    assert {p: os.stat(f"{out}/{p}").st_mtime_ns for p in first} == first  # converted once
    assert [(r.path, r.kind, r.exit_code) for r in again.jobs().where("status = 'error'").collect()] == [("4.pdf", "BadArgs", 2)]
    assert Run(spark, str(books / "other")).outcomes().count() == 0


def test_an_interrupted_batch_stays_pending(spark, books, monkeypatch):
    run = Run(spark, str(books / "run"))

    def interrupted(*_):
        run.cancel(now=True)
        raise RuntimeError("interrupted")

    monkeypatch.setattr(D, "convert_jobs", interrupted)
    assert run.convert(str(books / "in"), str(books / "out"), str(books / "cache")) == {"pending": 5, "done": 0, "error": 0}
    monkeypatch.setattr(D, "convert_jobs", lambda *_: (_ for _ in ()).throw(RuntimeError("broken")))
    with pytest.raises(RuntimeError, match="broken"):
        run.convert(str(books / "in"), str(books / "out"), str(books / "cache"))


def test_one_book(spark, books, capsys):
    out = books / "made.epub"
    assert M.main(["convert", str(books / "in/1.cbz"), "-o", str(out), "--cache", str(books / "cache"), "--check-packages"]) == 0
    assert out.exists() and "1 converted, 0 failed" in capsys.readouterr().out
    assert M.main(["convert-pdf", str(books / "in/1.cbz"), "-o", str(books / "x.epub"), "--cache", str(books / "cache")]) == 2
    assert M.main(["convert", str(books / "in/1.cbz"), "-o", str(books / "x.epub"), "--comic", "--quiet"]) == 2
    assert M.main(["convert", str(books / "in/none.cbz"), "-o", str(books / "x.epub"), "--quiet"]) == 2
    assert not (books / "x.epub").exists()


def test_options():
    s = M.settings_of(M.parser().parse_args(["folder", "in", "-o", "out", "--no-extract-header", "--table-format", "MARKDOWN", "--model", "m"]))
    assert (s.extract_header, s.extract_footer, s.table_format, s.model, s.include_images) == (False, True, "markdown", "m", True)
    with pytest.raises(SystemExit):
        M.parser().parse_args(["folder", "in", "-o", "out", "--table-format", "csv"])
