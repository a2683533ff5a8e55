"""k-d shards: the tree against a plain version, and equal texts together."""

import random
from collections import defaultdict

from pyspark.sql import functions as F

from quire.llm import kdshard

DOCS = "doc_id long, text string, lang string, source string, shard int, parted string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, lang, s, 1, "x") for i, t, lang, s in rows], DOCS).repartition(3)


def corpus(n, seed=1):
    r = random.Random(seed)
    return [(i if i % 17 else None, f"{i} " + "w" * int(r.lognormvariate(5, 1)), r.choice(["en", "de", None]), r.choice("aaaaabc")) for i in range(n)]


def plain(units, shards):
    """The same rule in lists: unit -> shard. units: (tie, size, dimensions)."""
    out = {}

    def split(own, first, n):
        if n == 1 or not own:
            out.update({u[0]: first for u in own})
            return
        width = {d: max(u[2][d] for u in own) - min(u[2][d] for u in own) for d in kdshard.DIMENSIONS}
        dim = max(kdshard.DIMENSIONS, key=lambda d: width[d])
        key = lambda u: u[2][dim] * kdshard._TIES + u[0]
        want = sum(u[1] for u in own) * (n // 2) / n
        lo = min(u[2][dim] for u in own) * kdshard._TIES
        hi = (max(u[2][dim] for u in own) + 1) * kdshard._TIES
        while True:
            step = max(1, -(-(hi - lo) // kdshard.BINS))
            bins = defaultdict(list)
            for u in own:
                if lo <= key(u) < hi:
                    bins[(key(u) - lo) // step].append(u)
            order = sorted(bins)
            at = sum(u[1] for u in own if key(u) < lo)
            j = 0
            while at + sum(u[1] for u in bins[order[j]]) < want:
                at += sum(u[1] for u in bins[order[j]])
                j += 1
            if len(bins[order[j]]) <= kdshard.FEW or step == 1:
                break
            lo, hi = lo + order[j] * step, lo + (order[j] + 1) * step
        i, k, back = j, j + 1, True
        for _ in range(2 * kdshard.FEW):
            held = sum(len(bins[order[x]]) for x in range(i, k))
            if back and i > 0 and held + len(bins[order[i - 1]]) <= kdshard.FEW:
                i -= 1
            elif not back and k < len(order) and held + len(bins[order[k]]) <= kdshard.FEW:
                k += 1
            back = not back
        some = [u for x in range(i, k) for u in bins[order[x]]]
        edge = lo + order[i] * step
        left = [u for u in own if key(u) < edge]
        want -= sum(u[1] for u in left)
        rest = []
        for u in sorted(some, key=lambda u: (u[1], key(u)), reverse=True):
            if u[1] <= want:
                left.append(u)
                want -= u[1]
            else:
                rest.append(u)
        if rest and rest[-1][1] - want < want:
            left.append(rest[-1])
        chosen = {u[0] for u in left}
        split([u for u in own if u[0] in chosen], first, n // 2)
        split([u for u in own if u[0] not in chosen], first + n // 2, n - n // 2)

    split(units, 0, shards)
    return out


def test_against_a_plain_tree(spark, monkeypatch):
    monkeypatch.setattr(kdshard, "FEW", 12)
    monkeypatch.setattr(kdshard, "BINS", 64)
    rows = corpus(700) + [(5000 + i, "the same text" * (1 + i % 3), "en", "b") for i in range(60)]
    staged = kdshard.Staged(spark, "test")
    made = staged.put(kdshard.units(staged.put(kdshard.metadata(frame(spark, rows))), 7, staged))
    of = staged.put(made.groupBy("tie", *kdshard.DIMENSIONS).agg(F.sum("size").alias("size")))
    got = {r.tie: r.shard for r in of.withColumn("shard", kdshard._place(kdshard.grow(of, 7))).collect()}
    units = [(r.tie, r["size"], {d: r[d] for d in kdshard.DIMENSIONS}) for r in of.collect()]
    assert len(got) == len(units) and got == plain(units, 7)


def test_equal_texts_lie_together(spark):
    r = random.Random(4)
    rows = corpus(1500) + [(9000 + i, f"copy {i % 40} " + "c" * (20 * (i % 40)), r.choice(["en", "de"]), r.choice("abc")) for i in range(400)]
    rows += [(20_000 + i % 2, "hot", "en", "a") for i in range(3000)] + [(None, None, None, None), (None, "", None, None), rows[3], rows[3]]
    got = kdshard.kd_shards(frame(spark, rows), 12).collect()
    assert len(got) == len(rows)
    shards, sizes = defaultdict(set), defaultdict(int)
    for x in got:
        sizes[x.shard] += x["size"]
        if not x.parted:
            shards[x.text_crc32, x["size"]].add(x.shard)
    assert all(len(s) == 1 for s in shards.values())
    assert {x.text_crc32 for x in got if x.parted} == {x.text_crc32 for x in got if x["size"] == 11}  # only the hot text
    assert max(sizes.values()) < 1.02 * min(sizes.values())
