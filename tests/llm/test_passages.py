"""op12 against windows counted one by one."""

import hashlib
import itertools
import random
from collections import Counter

import numpy as np
import pytest

from quire.llm import passages as P


def plain(docs, width):
    split = [(i, (t or "").encode().split()) for i, t in docs]
    seen = Counter(tuple(w[s : s + width]) for _, w in split for s in range(len(w) - width + 1))
    out = []
    for i, w in split:
        gone = {x for s in range(len(w) - width + 1) if seen[tuple(w[s : s + width])] > 1 for x in range(s, s + width)}
        kept = b" ".join(x for j, x in enumerate(w) if j not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def shown(df):
    return sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in df.collect()), key=repr)


def made(seed, width, n=150):
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(3000)}"
    passages = [[word() for _ in range(m)] for m in (width - 1, width, width + 1, 2 * width, 3 * width)]
    docs = []
    for i in range(n):
        w = [word() for _ in range(rng.choice([0, 3, width - 1, width, 2 * width, 90]))]
        for _ in range(rng.randrange(3)):
            at = rng.randrange(len(w) + 1)
            p = rng.choice(passages)
            a = rng.randrange(max(1, len(p) // 2))
            w[at:at] = rng.choice([p, p[a:], p[: len(p) - a]])
        docs.append((i, rng.choice([" ", "\n", "  \t"]).join(w)))
    docs += [(n + i, docs[i % 4][1]) for i in range(n // 2)]  # a third of all rows are copies of a few
    near = docs[5][1].split() + [word() for _ in range(80)]
    docs += [(900 + j, " ".join([*near[:j], "changed", *near[j + 1 :]])) for j in range(0, len(near), 9)]
    docs += [(None, None), (None, ""), (7, docs[3][1]), (7, docs[3][1]), (800, "same " * (width + 5)), (801, "é " * width), (802, "a b " * width), (803, " ".join(word() for _ in range(5000)) + " " + " ".join(passages[3]))]
    rng.shuffle(docs)
    return docs


@pytest.mark.parametrize(("seed", "width", "held"), [(1, 35, P.HELD), (2, 35, 300), (3, 8, 100), (4, 20, 1000), (5, 1, 50), (6, 2, 50)])
def test_same_as_plain(spark, monkeypatch, seed, width, held):
    monkeypatch.setattr(P, "HELD", held)  # read when the job is made, as a global of its closure
    docs = made(seed, width)
    df = spark.createDataFrame([(*d, 1, "z") for d in docs], "doc_id long, text string, row int, PACKED string").repartition(3)
    assert shown(P.without_repeats(df, width)) == plain(docs, width)


def test_kept_texts(spark):
    docs = made(11, 10, 40)
    got = P.without_repeats(spark.createDataFrame(docs, "doc_id long, text string"), 10, texts=True).collect()
    assert len(got) == len(docs) and all(hashlib.sha256(r.kept_text.encode()).hexdigest() == r.kept_sha256 for r in got)
    assert shown(spark.createDataFrame(got)) == plain(docs, 10)


def test_covers():
    for p, cover in P.COVERS.items():
        assert {(a - b) % p for a, b in itertools.product(cover, cover)} == set(range(p))
    for width in range(1, 60):
        p = P.period(width)
        for i, j in ((0, 5), (3, 3), (7, 100)):
            x, y = P.anchors(i + width + 40, width, p), P.anchors(j + width + 40, width, p)
            assert any(i + t in x and j + t in y for t in range(p))


def test_windows_around_anchors():
    n, width, cover = 100, 35, 21
    for found in ([0], [64], [85], [30, 33, 60]):
        want = {s for p in found for s in range(max(0, p - cover + 1), p + 1) if s + width <= n}
        assert set(P.around(np.array(found), n, width, cover).tolist()) == want
    assert not len(P.around(np.array([], np.int64), n, width, cover))


def test_window_hashes_tell_windows_apart():
    words = [b"a", b"b", b"c", b"a", b"b", b"c", b"b", b"a"] * 20
    starts = np.arange(len(words) - 4)
    h0, h1 = P.Hasher().windows(words, starts, 5, 2)
    whole = [tuple(words[s : s + 5]) for s in starts]
    assert len(set(zip(whole, h0.tolist(), strict=True))) == len(set(whole)) == len(set(h0.tolist())) == len(set(h1.tolist()))


def test_empty(spark):
    assert P.without_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0
