"""A shard's scores are those of BM25 over all terms, and its windows are filled greedily by them."""

import math
from collections import Counter

import numpy as np
import pytest
import public_tokenizers

from quire.llm import packing


def corpus(seed, n, vocabulary=400, longest=120):
    r = np.random.default_rng(seed)
    rank = r.zipf(1.3, 200_000) % vocabulary
    ids, at = [], 0
    for _ in range(n):
        k = int(r.integers(1, longest))
        ids.append(np.append(rank[at : at + k] + 10, 2).astype("<u2"))
        at += k
    return ids


def stats(ids):
    df = np.zeros(packing.VOCABULARY, np.int64)
    for x in ids:
        df[np.unique(x)] += 1
    return df, len(ids), sum(map(len, ids)) / len(ids)


def brute(ids, seed, df, n_docs, mean):
    """BM25 of every document for all terms of the seed."""
    out = []
    for x in ids:
        tf, total = Counter(x.tolist()), 0.0
        for t in set(ids[seed].tolist()):
            if tf[t]:
                idf = math.log(1 + (n_docs - df[t] + 0.5) / (df[t] + 0.5))
                total += idf * tf[t] * (packing.K1 + 1) / (tf[t] + packing.K1 * (1 - packing.B + packing.B * len(x) / mean))
        out.append(total)
    return np.array(out)


@pytest.mark.parametrize("n", [1, 30, 150, 600])
@pytest.mark.parametrize("table", [0, 3000, 16_000_000])
def test_scores_are_bm25(monkeypatch, n, table):
    monkeypatch.setattr(packing, "TABLE", table)
    monkeypatch.setattr(packing, "POSTINGS", 500)
    ids = corpus(n, n)
    df, n_docs, mean = stats(ids)
    shard = packing.Shard(ids, df, n_docs, mean)
    seeds = np.unique(np.linspace(0, n - 1, 12).astype(int))
    recall = []
    for seed, scores in zip(seeds.tolist(), shard.scores(seeds), strict=True):
        want = brute(ids, seed, df, n_docs, mean)
        assert scores == pytest.approx(want, rel=1e-4)
        near = [x for x in np.lexsort((np.arange(n), -want)).tolist() if x != seed and want[x] > 0][:10]
        scores[seed] = 0
        got = set(packing.best_of(scores, 10).tolist())
        recall.append(sum(x in got for x in near) / max(1, len(near)))
    assert np.mean(recall) >= 0.99 or n == 1
    kept = np.flatnonzero(np.arange(n) % 3 != 1)
    shard.keep(kept)
    again = shard.scores(np.array([0]))[0]
    assert again == pytest.approx(brute(ids, int(kept[0]), df, n_docs, mean)[kept], rel=1e-4)


def test_windows_take_the_best_unused_neighbours():
    ids = corpus(5, 200)
    df, n_docs, mean = stats(ids)
    out = packing.windows(ids, df, n_docs, mean, 300)
    first = [doc for doc, _, _, window, _ in out if window == 0]
    scores = brute(ids, 0, df, n_docs, mean)
    scores[0] = np.inf
    assert first == np.lexsort((np.arange(200), -scores)).tolist()[: len(first)]
    last = max(w for *_, w, _ in out)
    for w in range(last + 1):
        own = sorted((o, n) for _, _, n, x, o in out if x == w)
        assert [o for o, _ in own] == np.cumsum([0, *[n for _, n in own]]).tolist()[:-1]
        assert w == last or sum(n for _, n in own) == 300
    pieces = {}
    for doc, start, n, _, _ in out:
        pieces.setdefault(doc, []).append((start, n))
    assert sorted(pieces) == list(range(200))
    for doc, own in pieces.items():
        assert [s for s, _ in sorted(own)] == np.cumsum([0, *[n for _, n in sorted(own)]]).tolist()[:-1] and sum(n for _, n in own) == len(ids[doc])


def test_no_text_twice_in_a_window_while_another_is_left():
    ids = corpus(6, 90, longest=30)
    copies = [x for x in ids for _ in range(3)]
    df, n_docs, mean = stats(copies)
    out = packing.windows(copies, df, n_docs, mean, 128)
    by = {}
    for doc, *_, window, _ in out:
        by.setdefault(window, set()).add(doc)
    twice = [w for w, own in by.items() if len({copies[d].tobytes() for d in own}) < len(own)]
    assert all(w > 0.9 * max(by) for w in twice)
    same = [np.array([7, 8, 2], "<u2")] * 500
    out = packing.windows(same, *stats(same), 64)
    assert sorted(d for d, s, *_ in out if s == 0) == list(range(500)) and max(w for *_, w, _ in out) == 1500 // 64


def test_rows_of_one_id_are_spread(spark, monkeypatch):
    monkeypatch.setattr(packing, "SHARD_TOKENS", 500)
    rows = [(7, "the very same text of one doc_id")] * 600 + [(None, "another text without any id")] * 600
    out = packing.pack(spark.createDataFrame(rows, "doc_id long, text string"), public_tokenizers.path("word_bpe_49k.json"), 128).collect()
    assert sum(p.start == 0 for p in out) == 1200
    tokens = Counter()
    for p in out:
        tokens[p.sequence_id >> 32] += p.length
    assert max(tokens.values()) < 1000 and len(tokens) >= 12
