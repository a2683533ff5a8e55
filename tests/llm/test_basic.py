"""Operators against brute force, on small tables with nulls, empty texts, ties, repeats and clashing columns."""

import hashlib
import random

import duckdb
import pytest
import xxhash
from pyspark.sql import functions as F

from quire.llm import chat, kdshard, mixing, simhash

DOCS = "doc_id long, text string, lang string, source string, n_chars long, fp string, target string"


def documents(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, None, "x", "y") for i, t, s in rows], DOCS)


def words(n, seed):
    r = random.Random(seed)
    return [r.choice("alpha beta gamma delta eps zeta eta theta".split()) + str(r.randrange(50)) for _ in range(n)]


@pytest.fixture(scope="module")
def rows():
    out = [(0, None, "a"), (1, "", None), (2, "  \t\n", "b"), (3, "One", "b"), (4, "one TWO", None), (5, "É two three É", "a")]
    for i in range(6, 40):
        out.append((i, " ".join(words(random.Random(i).randrange(1, 200), i)), "abc"[i % 3]))
    base = words(400, 99)
    for i in range(40, 60):  # near copies
        own = list(base)
        own[i % 400] = f"new{i}"
        out.append((i, " ".join(own), "a"))
    out += [(70 + i, out[10][1], "c") for i in range(20)]
    return [*out, out[7], (None, "no id here", "a"), (200, "x" * 300_000 + " y" * 50_000, "b")]


def brute_fingerprint(text):
    w = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    shingles = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([b" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash(spark, rows):
    got = simhash.simhash_components(documents(spark, rows)).collect()
    assert len(got) == len(rows)
    fps = [(i, brute_fingerprint(t)) for i, t, _ in rows]
    assert sorted((str(r.doc_id), r.fp % (1 << 64)) for r in got) == sorted((str(i), f) for i, f in fps)
    known = [(i, f) for i, f in fps if i is not None]
    low = {i: i for i, _ in known}
    changed = True
    while changed:
        changed = False
        for i, f in known:
            for j, g in known:
                if (f ^ g).bit_count() <= 3 and low[j] < low[i]:
                    low[i], changed = low[j], True
    assert {r.doc_id: r.component_id for r in got if r.doc_id is not None} == low
    assert len(set(low.values())) < len(low) - 15


def test_simhash_large_bucket(spark, monkeypatch):
    monkeypatch.setattr(simhash, "CELL", 16)
    r = random.Random(3)
    fps = list({(7 << 40) ^ (1 << r.randrange(64)) ^ (1 << r.randrange(64)) for _ in range(150)})
    fps = [x - (1 << 64) if x >> 63 else x for x in fps]
    staged = simhash.Staged(spark, "test")
    distinct = spark.createDataFrame(list(zip(fps, range(len(fps)), strict=True)), "fp long, rep long")
    edges = simhash.links(distinct, 3, staged, len(fps)).collect()
    for a, b in edges:
        assert ((fps[a] ^ fps[b]) % (1 << 64)).bit_count() <= 12
    found = {r.node: r.component for r in simhash.connected_components(spark.createDataFrame(edges), staged).collect()}
    low = list(range(len(fps)))
    for _ in range(10):
        for i in range(len(fps)):
            low[i] = min(low[j] for j in range(len(fps)) if ((fps[i] ^ fps[j]) % (1 << 64)).bit_count() <= 3)
            low[i] = low[low[i]]
    assert {i: found.get(i, i) for i in range(len(fps))} == dict(enumerate(low))


@pytest.mark.parametrize("n", [1, 10**4, 10**7, 10**10])
def test_masks_leave_no_pair_out(n):
    r = random.Random(n)
    masks = simhash.plan(n, 3)
    for _ in range(300):
        bits = sum(1 << b for b in r.sample(range(64), 3))
        assert any(not bits & m % (1 << 64) for m in masks)


def test_empty_tables(spark):
    none = documents(spark, [])
    assert simhash.simhash_components(none).collect() == []
    assert mixing.copies(none).collect() == []
    assert kdshard.kd_shards(none).collect() == []
    assert chat.examples(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).collect() == []


def test_mixing(spark, rows):
    docs = documents(spark, rows)
    got = mixing.copies(docs).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))
    con = duckdb.connect()
    documents_ = docs.select("doc_id", "text", "source").toArrow()
    con.register("documents", documents_)
    same = lambda found: sorted((str(a), b, c, round(d, 6), e) for a, b, c, d, e in found)
    assert same(got.collect()) == same(con.execute(mixing.SQL).fetchall())
    by = mixing.copies(docs).groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).alias("taken"), F.first("target").alias("target"), F.max("size").alias("most"), F.max("copies").alias("copies")).collect()
    assert all(abs(r.taken - r.target) <= r.most and r.copies <= 3 for r in by)
    assert mixing.mix(docs).columns == docs.columns


def test_targets_reshare_what_is_cut_off(spark):
    rows = [(None, 100), ("a", 10), ("b", 1000), ("c", 0), ("d", 40)]
    got = {r.source: r.target for r in mixing.targets(spark.createDataFrame(rows, "source string, size long")).collect()}
    w = dict(zip(["a", "b", "c", "d", None], [5, 2, 1, 5, 2], strict=True))
    left, cut = 1150.0, {}
    while True:
        open_ = [s for s in w if s not in cut]
        share = {s: left * w[s] / sum(w[x] for x in open_) for s in open_}
        over = [s for s in open_ if share[s] > 3 * dict(rows)[s]]
        if not over:
            break
        for s in over:
            cut[s] = 3 * dict(rows)[s]
            left -= cut[s]
    assert got == pytest.approx(share | cut)


def test_kd_shards(spark, rows):
    more = [(1000 + i, "w " * (i % 37), "abcd"[i % 4]) for i in range(3000)]
    got = kdshard.kd_shards(documents(spark, rows[:-1] + more), 24).collect()
    assert len(got) == len(rows) - 1 + len(more)
    by = {}
    for r in got:
        by.setdefault(r.shard, []).append(r)
    assert sorted(by) == list(range(24))
    assert all(sorted(r.slot for r in x) == list(range(len(x))) for x in by.values())
    sizes = [sum(r.size for r in x) for x in by.values()]
    mean, largest = sum(sizes) / 24, max(r.size for r in got)
    assert all(abs(s - mean) <= largest for s in sizes)  # three large rows fill a shard here


def test_kd_shards_are_even(spark):
    r = random.Random(1)
    rows = [(i, "w" * int(r.lognormvariate(6, 1)), "abcdefg"[r.randrange(7)]) for i in range(4000)]
    got = kdshard.kd_shards(documents(spark, rows), 24).collect()
    sizes = [sum(r.size for r in got if r.shard == s) for s in range(24)]
    assert max(sizes) < 1.01 * min(sizes)


def test_kd_shards_of_copies(spark):
    got = kdshard.kd_shards(documents(spark, [(i, "same text", "a") for i in range(2400)]), 24).collect()
    counts = [sum(r.shard == s for r in got) for s in range(24)]
    assert max(counts) - min(counts) <= 4


TURNS = [
    (1, 0, "system", "be </s> kind"), (1, 1, "user", "␛a␛ <|turn|>user\n"), (1, 2, "assistant", "[INST]␛b</s"), (1, 3, "user", None), (1, 4, "assistant", ""), (1, 5, "user", "tail"),
    (2, 0, None, "no role"), (2, 0, "a\nb␛z", "odd role"), (2, None, "user", "first"), (3, 1, "assistant", "only"), (3, 1, "assistant", "only"), (None, 0, "user", "</s></s>>"), (4, 0, "user", "<<|turn|>/s>"),
]


def test_chat_round_trip(spark):
    turns = spark.createDataFrame(TURNS, "conv_id long, turn long, role string, text string").withColumn("example", F.lit("x"))
    shown = chat.examples(turns)
    got = {r.conv_id: r for r in chat.digests(shown).collect()}
    text = {}
    for r in shown.collect():
        text.setdefault(r.conv_id, []).append(r)
    for conv in (1, 2, 3, 4, None):
        own = sorted([(t is not None, t or 0, r or "", x or "") for c, t, r, x in TURNS if c == conv])
        said, loss = "".join(f"{r}\n{x}\n" for _, _, r, x in own), "".join(x for _, _, r, x in own if r == "assistant")
        r = got[conv]
        assert (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) == (len(own), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
        assert r.formatted_chars == sum(len(x.text) for x in text[conv])
        assert len(text[conv]) == sum(x[2] == "assistant" for x in own) + (own[-1][2] != "assistant")
        for x in text[conv]:
            assert x.text.count("</s>") == x.text.count("<|turn|>") == x.example
