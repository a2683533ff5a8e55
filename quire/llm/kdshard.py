"""Sharding by a k-d tree over the documents' metadata.

A node of the tree covers a run of shards. It is split along its widest dimension, at the weighted
median (for an odd number of shards, the matching fraction) of its bytes, until each leaf is one shard.
What is split are units: all rows of a text, or, where these are more than PART of a shard's bytes, each row. Medians
come from histograms of a fixed number of bins that all nodes of a level fill in one pass and
that are refined around the cut until a bin there holds at most FEW units. These, and as many next to them, are dealt to
the two sides, largest first, to where they fit: a cut is as near to its mark as they allow, at every size of
the table alike. No rows are sorted, and texts are read once and never moved.
"""

from __future__ import annotations

import itertools
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F

from .util import Staged, rank_within, running_sums

#: Bins of a histogram, for each node of a level; units around a cut that are dealt one by one; the share of a shard's bytes that a group of equal texts may have to stay together.
BINS, FEW, PART = 4096, 64, 0.5
#: Dimensions in order of preference, as numbers from 0: sources and languages, by code point, lie where the bytes of those before them end, and ids where they lie between the least and the largest. Ties within one go by a hash. Size is none: a shard of large documents alone could not be filled evenly.
DIMENSIONS = ("d_source", "d_lang", "d_id")
_STEPS, _TIES = 1 << 20, 1 << 32


@dataclass
class Node:
    first: int
    n: int
    depth: int = 0
    dim: str | None = None
    cut: int = 0
    also: list = field(default_factory=list)
    below: list = field(default_factory=list)


def _place(node: Node) -> Column:
    """The leaf, by its first shard, in which a row falls."""
    if not node.below:
        return F.lit(node.first)
    left = _key(node.dim) < F.lit(node.cut)
    left = left | _key(node.dim).isin(node.also) if node.also else left
    return F.when(left, _place(node.below[0])).otherwise(_place(node.below[1]))


def _key(dim: str) -> Column:
    return F.col(dim) * F.lit(_TIES) + F.col("tie")


def metadata(docs: DataFrame) -> DataFrame:
    """(doc_id, row, size, text_crc32, same, source, lang); the only step that reads texts. same is equal where texts are."""
    binary = F.col("text").cast("binary")
    size = (F.coalesce(F.octet_length(binary), F.lit(0)) + 8).cast("long")
    crc, same = F.crc32(F.coalesce(binary, F.lit(b""))), F.xxhash64(F.col("text").isNull(), binary)
    value = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    return docs.select("doc_id", F.monotonically_increasing_id().alias("row"), size.alias("size"), crc.alias("text_crc32"), same.alias("same"), value("source"), value("lang"))


def _ranks(meta: DataFrame, name: str, total: int, staged: Staged) -> DataFrame:
    """(_name, d_name): where the bytes of the values before each one end, as a share of all. A table of one row for each value, dealt by ranges of it."""
    by = meta.groupBy(F.col(name).alias(f"_{name}")).agg(F.sum("size").alias("n"))
    by = running_sums(by, [F.col(f"_{name}").asc()], {"_before_": F.col("n")}, staged)
    return by.select(f"_{name}", F.floor(F.col("_before_") / F.lit(max(total, 1)) * (_STEPS - 1)).cast("long").alias(f"d_{name}"))


def units(meta: DataFrame, shards: int, staged: Staged) -> DataFrame:
    """`meta` with each row's unit (tie), whether its text's rows were too many to stay together (parted), and the dimensions, which a unit's rows share."""
    low, high, total = meta.agg(F.min("doc_id"), F.max("doc_id"), F.sum("size")).first()
    low, span = low or 0, max(1, (high or 0) - (low or 0))
    group = ["same", "size", "text_crc32"]
    groups = meta.groupBy(*group).agg(F.count(F.lit(1)).alias("n"), F.min("source").alias("_s"), F.min("lang").alias("_l"), F.min("doc_id").alias("_i")).where("n > 1")
    groups = groups.select(*[F.col(c).alias(f"_{c}") for c in group], "_s", "_l", "_i", (F.col("n") * F.col("size") > PART * (total or 0) / shards).alias("parted"))
    met = meta.join(groups, (F.col("same") == F.col("_same")) & (F.col("size") == F.col("_size")) & (F.col("text_crc32") == F.col("_text_crc32")), "left")
    met = met.withColumn("alone", F.col("parted").isNull() | F.col("parted"))
    own = lambda c, of: F.when(F.col("alone"), F.col(c)).otherwise(F.col(of))
    tie = F.when(F.col("alone"), F.xxhash64("doc_id", "row")).otherwise(F.xxhash64("same"))
    met = met.select("doc_id", "row", "size", "text_crc32", F.coalesce("parted", F.lit(False)).alias("parted"), own("source", "_s").alias("source"), own("lang", "_l").alias("lang"), own("doc_id", "_i").alias("id"), F.pmod(tie, F.lit(_TIES)).alias("tie"))
    for name in ("source", "lang"):
        ranks = _ranks(meta, name, total or 0, staged)
        met = met.join(ranks, F.col(name) == F.col(f"_{name}"), "left")
    where = ((F.col("id") - F.lit(low)) / F.lit(float(span)) * (_STEPS - 1)).cast("long")
    return met.select("doc_id", "row", "size", "text_crc32", "parted", "tie", F.coalesce("d_source", F.lit(0)).alias("d_source"), F.coalesce("d_lang", F.lit(0)).alias("d_lang"), F.coalesce(where, F.lit(0)).alias("d_id"))


def _cuts(rows: DataFrame, active: list[Node], total: dict) -> None:
    """Finds each node's cut: the key below which its first shards' share of bytes lies, and what is dealt around it."""
    state, ends = {}, {}
    for a in active:
        want = total[a.first][0] * (a.n // 2) / a.n
        lo, hi = total[a.first][1][a.dim]
        state[a.first] = {"lo": lo * _TIES, "hi": (hi + 1) * _TIES, "before": 0, "want": want, "node": a}
    while state:
        bins = None
        for first, s in state.items():
            s["step"] = max(1, -(-(s["hi"] - s["lo"]) // BINS))
            k = _key(s["node"].dim)
            own = (F.col("node") == first) & (k >= F.lit(s["lo"])) & (k < F.lit(s["hi"]))
            off = k - F.lit(s["lo"])
            value = (off - F.pmod(off, F.lit(s["step"]))) / F.lit(s["step"])
            bins = F.when(own, value.cast("int")) if bins is None else bins.when(own, value.cast("int"))
        found: dict = {}
        for node, b, size, n in rows.withColumn("bin", bins).where("bin is not null").groupBy("node", "bin").agg(F.sum("size"), F.count(F.lit(1))).collect():
            found.setdefault(node, []).append((b, size, n))
        for first, s in list(state.items()):
            at, filled = s["before"], sorted(found.get(first, []))
            s["node"].cut = s["hi"]
            j = next((j for j, reached in enumerate(itertools.accumulate((x for _, x, _ in filled), initial=at)) if j and reached >= s["want"]), 0) - 1
            if j < 0:  # an empty node
                del state[first]
                continue
            at += sum(x for _, x, _ in filled[:j])
            b, size, n = filled[j]
            left, right = s["lo"] + b * s["step"], s["lo"] + (b + 1) * s["step"]
            if n > FEW and s["step"] > 1:
                s |= {"lo": left, "hi": right, "before": at}
                continue
            i, k = j, j + 1  # bins before and after too, in turn, as long as the units stay few
            for back in (True, False) * FEW:
                if back and i > 0 and n + filled[i - 1][2] <= FEW:
                    i -= 1
                    n, at = n + filled[i][2], at - filled[i][1]
                elif not back and k < len(filled) and n + filled[k][2] <= FEW:
                    n, k = n + filled[k][2], k + 1
            left, right = s["lo"] + filled[i][0] * s["step"], s["lo"] + (filled[k - 1][0] + 1) * s["step"]
            s["node"].cut, ends[first] = left, (left, right, s["want"] - at, s["node"])
            del state[first]
    if not ends:
        return
    within = None
    for first, (left, right, _, node) in ends.items():
        own = (F.col("node") == first) & (_key(node.dim) >= F.lit(left)) & (_key(node.dim) < F.lit(right))
        within = F.when(own, _key(node.dim)) if within is None else within.when(own, _key(node.dim))
    dealt: dict = {}
    for node, key, size in rows.withColumn("key", within).where("key is not null").groupBy("node", "key").agg(F.sum("size")).collect():
        dealt.setdefault(node, []).append((size, key))  # units whose keys are the same go together
    for first, (_, _, want, node) in ends.items():
        left = []
        for size, key in sorted(dealt[first], reverse=True):
            if size <= want:
                node.also.append(key)
                want -= size
            else:
                left.append((size, key))
        if left and left[-1][0] - want < want:  # to go over by this is less than what is missing
            node.also.append(left[-1][1])


def grow(of: DataFrame, shards: int) -> Node:
    """The tree over units (size, tie, the dimensions)."""
    root = Node(0, shards)
    leaves = [root]
    while active := [x for x in leaves if x.n > 1]:
        rows = of.withColumn("node", _place(root))
        spans = [f(d) for d in DIMENSIONS for f in (F.min, F.max)]
        total = {r[0]: (r[1] or 0, {d: (r[2 + 2 * i] or 0, r[3 + 2 * i] or 0) for i, d in enumerate(DIMENSIONS)}) for r in rows.groupBy("node").agg(F.sum("size"), *spans).collect()}
        for a in active:
            total.setdefault(a.first, (0, dict.fromkeys(DIMENSIONS, (0, 0))))
            widths = {d: hi - lo for d, (lo, hi) in total[a.first][1].items()}
            a.dim = max(DIMENSIONS, key=lambda d, w=widths: w[d])
        _cuts(rows, active, total)
        for a in active:
            a.below = [Node(a.first, a.n // 2), Node(a.first + a.n // 2, a.n - a.n // 2)]
        leaves = [b for x in leaves for b in (x.below or [x])]
    return root


def kd_shards(docs: DataFrame, shards: int = 24) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot, parted) for every row of `docs` (doc_id, text, source, lang).

    Shards hold near equal bytes (UTF-8 bytes of the text, none if null, plus 8): each cut is as near to its mark as the FEW units
    around it allow, a document's size at most. Rows of equal texts lie in one shard, unless their bytes are more than PART of a
    shard's: then `parted` is true, and each row is placed by its own metadata and a hash, so that no group of copies outgrows a
    shard; a single document may. slot counts a shard's rows from 0 without gaps, by doc_id. Texts of any length are read once. Rows that repeat a
    doc_id, and rows without one, are rows of their own. Null sources and langs count as empty. An empty table gives an empty result. Other columns are ignored, whatever their names.
    """
    staged = Staged(docs.sparkSession, "kdshard")
    meta = staged.put(metadata(docs))
    rows = staged.put(units(meta, shards, staged))
    of = staged.put(rows.groupBy("tie", *DIMENSIONS).agg(F.sum("size").alias("size")))
    placed = rows.withColumn("shard", _place(grow(of, shards)).cast("int")).select("doc_id", "size", "text_crc32", "shard", "parted", "row")
    return rank_within(placed, ["shard"], ["doc_id", "text_crc32", "size", "row"], "slot", staged).drop("row")
