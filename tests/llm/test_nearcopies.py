"""The pipeline's near-copy stage against brute force on 5-word shingles."""

import random

import corpus_pipeline as P
from quire.llm import nearcopies

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def shingles(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())


def kept(rows):
    """The smallest id of each component of the texts with a similarity of 0.8 or more."""
    sets = [(i, shingles(t)) for i, t in rows]
    low = {i: i for i, _ in sets}
    pairs = [(i, j) for i, a in sets for j, b in sets if i != j and (a == b or 5 * len(a & b) >= 4 * len(a | b))]
    for _ in range(len(rows)):
        was = dict(low)
        for i, j in pairs:
            low[i] = min(low[i], low[j])
        if low == was:
            return {i for i in low if low[i] == i}


def near_rows(seed=5):
    r = random.Random(seed)
    prose = lambda n: [f"{r.choice('abcdefgh')}{r.randrange(400)}" for _ in range(n)]
    rows, ident = [], iter(range(10_000))
    for n in (70, 110, 150, 250, 600):
        for changed in (1, 2, 3, 5, 8):
            base = prose(n)
            rows.append((next(ident), " ".join(base)))
            own = list(base)
            for at in r.sample(range(n), changed):
                own[at] = f"new{changed}"
            rows.append((next(ident), " ".join(own)))
    base = prose(120)
    for i in range(60):  # a large group
        own = list(base)
        own[i] = f"one{i}"
        rows.append((next(ident), " ".join(own)))
    return rows + [(next(ident), None), (next(ident), ""), (next(ident), "Two words"), (next(ident), "two  WORDS")]


def stage(spark, rows):
    docs = spark.createDataFrame([(i, t, "en", "a", n) for n, (i, t) in enumerate(rows)], DOCS)
    return P.drop_near_copies(spark, docs, "").collect()


def test_near_copies_of_changed_words(spark):
    rows = near_rows()
    want = kept(rows)
    assert {r.doc_id for r in stage(spark, rows)} == want
    assert sum(i % 2 == 1 and i < 50 for i in set(range(50)) - want) >= 10  # of the planted copies, this many must go


def test_near_copies_over_cells(spark, monkeypatch):
    monkeypatch.setattr(nearcopies, "CELL", 1500)
    rows = near_rows(6)
    assert {r.doc_id for r in stage(spark, rows)} == kept(rows)


def test_near_copies_with_null_and_repeated_ids(spark):
    rows = near_rows(7)[:20]
    base, other = rows[0][1], rows[6][1]
    rows += [(None, base), (None, "no copy of this one here at all"), (0, base), (500, base), (500, "five hundred has another text too"), (None, other), (None, "twice without an id, once kept"), (None, "twice without an id, once kept")]
    got = stage(spark, rows)
    assert sorted(r.text for r in got if r.doc_id is None) == ["no copy of this one here at all", "twice without an id, once kept"]
    assert [r.text for r in got if r.doc_id == 500] == ["five hundred has another text too"]
    assert sum(r.text == base for r in got) == 1 and sum(r.doc_id == 0 for r in got) == 1
