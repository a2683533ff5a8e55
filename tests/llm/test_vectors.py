"""Top-k and near-duplicate vectors, and packing, against brute force."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from quire.llm import gridjoin, packing, topk
from quire.llm.tokens import WordTokens

PATH = public_tokenizers.path("word_bpe_49k.json")
VECTORS = "vec_id long, embedding array<float>, label int, score long"


def vectors(n=600, d=16, seed=0):
    r = np.random.default_rng(seed)
    out = []
    for i in range(n):
        if i % 3 and out:
            base = np.array(out[r.integers(len(out))][1])
            v = base + r.standard_normal(d) * r.choice([0, 0.02, 0.05])
        else:
            v = r.standard_normal(d)
        out.append((i, [float(x) for x in np.float32(v / np.linalg.norm(v))], int(r.integers(3))))
    nan, inf = float("nan"), float("inf")
    out += [(n, None, 1), (n + 1, [0.0] * d, 1), (n + 2, [nan] * d, 1), (n + 3, [1.0, None] * (d // 2), 1), (n + 4, out[0][1], None), (n + 5, [], 1), (n + 6, [inf] * d, 2)]
    return [*out, out[3], *[(n + 100 + i, out[5][1], 1) for i in range(50)]]


@pytest.mark.parametrize("blocks", [2048, 3])
def test_top_k(spark, monkeypatch, blocks):
    monkeypatch.setattr(topk, "QUERIES", blocks)
    monkeypatch.setattr(topk, "CANDIDATES", 97)
    rows = vectors()
    df = spark.createDataFrame([(*r, 1) for r in rows], VECTORS).repartition(3)
    got = topk.top_k(df, F.pmod("vec_id", F.lit(50)) == 0, 7).collect()
    sound = [(i, [int(np.floor(float(np.float32(x)) * 1024)) for x in v]) for i, v, _ in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    dot = lambda a, b: sum(x * y for x, y in zip(a, b, strict=False))
    want = []
    for q, v in {i: v for i, v in sound if i % 50 == 0}.items():
        scored = sorted((-dot(v, w), i) for i, w in sound if i != q)[:7]
        want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(scored)]
    assert sorted(map(tuple, got)) == sorted(want)


def test_top_k_of_few(spark):
    df = spark.createDataFrame([(0, [1.0, 0.5], 0, 0), (1, [0.5], 0, 0)], VECTORS)
    assert [tuple(r) for r in topk.top_k(df, F.col("vec_id") == 0).collect()] == [(0, 1, 1, 1024 * 512)]
    assert topk.top_k(df.where("false"), F.lit(True)).collect() == []
    assert topk.top_k(df, F.lit(False)).collect() == []


def test_top_k_of_large_components(spark, monkeypatch):
    """Scores beyond what doubles and 64-bit sums hold are exact, those beyond a long its largest or smallest."""
    monkeypatch.setattr(topk, "CANDIDATES", 16)
    r = np.random.default_rng(4)
    rows = [(i, (r.standard_normal(12) * 10.0 ** r.choice([0, 3, 5, 6, 8])).tolist()) for i in range(120)] + [(200, [1e17] * 12), (201, [-1e300] + [0.0] * 11), (202, [1e6, 2e6, 3e6])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    got = topk.top_k(df, F.pmod("vec_id", F.lit(10)) == 0, 5).collect()
    long = lambda x: max(-(1 << 63), min((1 << 63) - 1, x))
    sound = [(i, [long(int(np.floor(x * 1024))) for x in v]) for i, v in rows]
    dot = lambda a, b: long(sum(x * y for x, y in zip(a, b, strict=False)))
    want = []
    for q, v in sound:
        if q % 10 == 0:
            want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(sorted((-dot(v, w), i) for i, w in sound if i != q)[:5])]
    assert sorted(map(tuple, got)) == sorted(want)


@pytest.mark.parametrize(("block", "leaf"), [(512, 64), (16, 4)])
def test_near_vectors(spark, monkeypatch, block, leaf):
    monkeypatch.setattr(gridjoin, "BLOCK", block)
    monkeypatch.setattr(gridjoin, "LEAF", leaf)
    rows = vectors()
    df = spark.createDataFrame([(*r, 1) for r in rows], VECTORS)
    got = gridjoin.vector_components(df).collect()
    assert len(got) == len(rows)
    fit = lambda v, lab: lab is not None and v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(v)
    ids = [i for i, v, lab in rows if fit(v, lab)]
    u = np.array([np.float32(v).astype(float) for _, v, lab in rows if fit(v, lab)])
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    labels = np.array([lab for _, v, lab in rows if fit(v, lab)])
    near = (u @ u.T >= 0.98) & (labels[:, None] == labels[None])
    np.fill_diagonal(near, False)
    low = np.array(ids)
    for _ in range(len(ids)):
        new = np.minimum(low, np.where(near, low[None], 1 << 60).min(1))
        if (new == low).all():
            break
        low = new
    want = sorted((i, int(n), int(c), i == c) for i, n, c in zip(ids, near.sum(1), low, strict=True))
    want += [(i, 0, i, True) for i, v, lab in rows if not fit(v, lab)]
    assert sorted(map(tuple, got)) == sorted(want)


@pytest.mark.parametrize("kind", ["string", "long"])
def test_labels_of_other_types(spark, kind):
    rows = [(i, [1.0, 0.001 * i], 10**12 + i % 2) for i in range(8)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label long").withColumn("label", F.col("label").cast(kind))
    assert {r.vec_id: r.component_id for r in gridjoin.vector_components(df).collect()} == {i: i % 2 for i in range(8)}


def test_near_vectors_of_none(spark):
    none = spark.createDataFrame([], VECTORS)
    assert gridjoin.vector_components(none).collect() == []
    bad = spark.createDataFrame([(1, None, 1, 1), (2, [0.0], 1, 1)], VECTORS)
    assert sorted(map(tuple, gridjoin.vector_components(bad).collect())) == [(1, 0, 1, True), (2, 0, 2, True)]


@pytest.fixture(scope="module")
def texts():
    r = random.Random(0)
    word = lambda: "".join(r.choice(["ba", "ko", "ti", "re", "Lu", "é", "x"]) for _ in range(r.randrange(1, 5)))
    out = [(i, " ".join(word() for _ in range(r.randrange(1, 900)))) for i in range(150)]
    out += [(200, None), (201, ""), (202, " \n "), (203, "word " * 20_000), (204, "x" * 5000), (205, "a <|endoftext|> b"), (None, "no id"), out[3], out[3]]
    return out + [(300 + i, out[7][1]) for i in range(40)]


@pytest.mark.parametrize("shard", [4_000_000, 9000])
def test_packing(spark, texts, monkeypatch, shard):
    monkeypatch.setattr(packing, "SHARD_TOKENS", shard)
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in texts], "doc_id long, text string, ids string, length long")
    got = packing.pack(docs, PATH, 256, with_ids=True).collect()
    tok = WordTokens(PATH).tok
    want = sorted((str(i), tuple([*tok.encode(t or "", add_special_tokens=False).ids, 2])) for i, t in texts)
    by, spots = {}, {}
    for p in got:
        assert p.length == len(p.ids) and p.ids_crc32 == zlib.crc32(np.array(p.ids, "<u4").tobytes())
        by.setdefault((str(p.doc_id), p.doc_tokens), []).append(p)
        spots.setdefault(p.sequence_id, []).append((p.offset, p.length))
    back = []
    for (i, n), own in by.items():
        starts = {}
        for p in own:
            starts.setdefault(p.start, []).append(p)
        copies = len(starts[0])
        assert sum(p.length for p in own) == n * copies
        if copies == 1:
            back.append((i, tuple(x for p in sorted(own, key=lambda p: p.start) for x in p.ids)))
    assert back and all(b in want for b in back) and sum(len(w[1]) for w in want) == sum(p.length for p in got)
    for own in spots.values():
        at = 0
        for offset, n in sorted(own):
            assert offset == at
            at += n
        assert at <= 256
    shards = {s >> 32 for s in spots}
    assert sum(sum(n for _, n in own) < 256 for own in spots.values()) <= len(shards)


def test_neighbours_go_together(spark):
    r = random.Random(1)
    topics = [[f"{a}{b}{c}" for b in "bcdf" for c in "aeiou"] for a in ("zu", "ky", "wo")]
    rows = [(i, " ".join(r.choice(topics[i % 3]) for _ in range(40))) for i in range(90)]
    got = packing.pack(spark.createDataFrame(rows, "doc_id long, text string"), PATH, 512).collect()
    by = {}
    for p in got:
        by.setdefault(p.sequence_id, []).append(p.doc_id % 3)
    same = sum(x == own[0] for own in by.values() for x in own)
    assert same / len(got) > 0.75
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string"), PATH).collect() == []


def test_tokens_are_the_tokenizers_own():
    r, words = random.Random(1), WordTokens(PATH)
    pool = [*"abzABZ019 \n\t.,;:!?'\"<|>%*$-_()[]{}~`^@#&+=/\\éÉßÿÖ×÷ñªºµ́ ΣςσİıЖж日本🙂\x1c\x85\xad", "<|endoftext|>", "'s", "'LL", "word", "Straße"]
    for _ in range(4000):
        text = "".join(r.choice(pool) for _ in range(r.randrange(40)))
        assert np.frombuffer(words.encode(text), "<u2").tolist() == words.tok.encode(text, add_special_tokens=False).ids
