"""SimHash near-duplicates by pigeonhole blocks.

Fingerprints are made from word shingles in Arrow batches. Equal fingerprints are merged first; the
distinct ones are cut into blocks such that two within the distance agree on some choice of blocks,
joined on those, and verified. A bucket with more fingerprints than CELL is dealt over pairs of cells,
and a cell returns a spanning forest of its links, never its pairs.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from .util import Staged, connected_components, parts

#: Fingerprints of one bucket that are compared in one task; more are dealt over pairs of cells.
CELL = 2048
#: Shingles whose bits are counted at a time.
CHUNK = 1 << 16
_BITS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)
_PLACES = (np.arange(8) * 256)[None, :]


def _hashed(text: bytes | None, width: int, seed: int) -> Iterator[np.ndarray]:
    """The hashes of a text's shingles in order, CHUNK at a time; a text of fewer words is one shingle, one without words has none."""
    words = text.lower().split() if text else []
    if not words:
        return
    if len(words) < width:
        words, width = [b" ".join(words)], 1
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = len(words) - width + 1
    for at in range(0, n, CHUNK):
        to = min(n, at + CHUNK)
        yield np.array([digest(joined[a:b], seed) for a, b in zip(starts[at:to].tolist(), ends[at + width - 1 : to + width - 1].tolist(), strict=True)], np.uint64)


def shingle_hashes(text: bytes | None, width: int, seed: int = 42) -> np.ndarray:
    return np.concatenate([np.zeros(0, np.uint64), *_hashed(text, width, seed)])


def fingerprint(text: bytes | None, width: int = 3, seed: int = 42) -> int:
    """The fingerprint, as a signed 64-bit integer, of one text in UTF-8."""
    return fingerprint_of(_hashed(text, width, seed))


def fingerprint_of(hashes: Iterable[np.ndarray]) -> int:
    """The same from the shingles' hashes, which come some at a time."""
    n, counts = 0, np.zeros(64, np.int64)
    for h in hashes:
        places = h.view(np.uint8).reshape(-1, 8) + _PLACES
        counts += (np.bincount(places.ravel(), minlength=2048).reshape(8, 256) @ _BITS).ravel()
        n += len(h)
    value = sum(1 << i for i in np.flatnonzero(2 * counts > n).tolist())
    return value - (1 << 64) if value >> 63 else value


def fingerprints(docs: DataFrame, width: int = 3) -> DataFrame:
    """(doc_id, fp) for every row; a null or empty text has fingerprint 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = pa.array([fingerprint(x, width) for x in b.column(1).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), fps], ["doc_id", "fp"])

    return docs.select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(run, "doc_id long, fp long")


def plan(n: int, distance: int) -> list[int]:
    """Masks of which some one agrees for any two fingerprints within `distance`.

    64 bits are cut into m blocks; at least m - distance of them agree, and each choice of so many is
    a mask. More blocks give more masks, each with more bits: of the plans up to 8 blocks, the one
    with the fewest rows and expected chance pairs for n fingerprints is taken. Every plan is exact.
    """
    best = None
    for m in range(distance + 1, 9):
        edges = [64 * i // m for i in range(m + 1)]
        blocks = [((1 << (b - a)) - 1) << a for a, b in itertools.pairwise(edges)]
        masks = [sum(x) for x in itertools.combinations(blocks, m - distance)]
        cost = sum(4 * n + n * n / 2 / 2 ** mask.bit_count() for mask in masks)
        if best is None or cost < best[0]:
            best = cost, masks
    return [x - (1 << 64) if x >> 63 else x for x in best[1]]


def forest(fp: np.ndarray, rep: np.ndarray, side: np.ndarray | None, distance: int) -> list[tuple[int, int]]:
    """Links within a cell as stars around each component's smallest id. side: 0 or 1; only links across sides count."""
    if side is None:
        near = np.bitwise_count(fp[:, None] ^ fp[None, :]) <= distance
    else:
        near = np.zeros((len(fp), len(fp)), bool)
        a, b = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        cross = np.bitwise_count(fp[a][:, None] ^ fp[b][None, :]) <= distance
        near[np.ix_(a, b)], near[np.ix_(b, a)] = cross, cross.T
    np.fill_diagonal(near, False)
    left, out = near.any(1), []
    for i in np.flatnonzero(left).tolist():
        if not left[i]:
            continue
        seen = np.zeros(len(fp), bool)
        seen[i] = True
        front = np.array([i])
        while len(front):
            new = near[front].any(0) & ~seen
            seen |= new
            front = np.flatnonzero(new)
        left &= ~seen
        ids = rep[seen]
        low = ids.min()
        out += [(int(low), int(x)) for x in ids.tolist() if x != low]
    return out


def links(distinct: DataFrame, distance: int, staged: Staged, n: int) -> DataFrame:
    """Edges (a, b) that connect just the fingerprints linked within the distance; distinct: (fp, rep)."""
    keys = distinct.select("fp", "rep", F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.col("fp").bitwiseAND(F.lit(m)).alias("k")) for i, m in enumerate(plan(n, distance))])).alias("key")).select("key.i", "key.k", "fp", "rep")
    shared = keys.groupBy("i", "k").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    met = keys.join(shared, ["i", "k"]).withColumn("s", F.ceil(F.col("n") / CELL).cast("int"))
    met = met.withColumn("own", F.pmod(F.xxhash64("fp", F.lit(7)), F.col("s")).cast("int"))
    met = met.withColumn("y", F.explode(F.sequence(F.lit(0), F.col("s") - 1)))
    met = met.select("i", "k", F.least("own", "y").alias("x"), F.greatest("own", "y").alias("y"), F.when(F.col("own") <= F.col("y"), 0).otherwise(1).alias("side"), "fp", "rep")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def cell(rows: list[np.ndarray]) -> list[tuple[int, int]]:
            _, _, x, y, side, fp, rep = rows
            return forest(fp.view(np.uint64), rep, side if x[0] != y[0] else None, distance)

        kept = None
        for b in batches:
            now = [c.to_numpy(zero_copy_only=False) for c in b.columns]
            rows = now if kept is None else [np.concatenate(x) for x in zip(kept, now, strict=True)]
            new = np.any([c[1:] != c[:-1] for c in rows[:4]], axis=0)
            cuts = [0, *(np.flatnonzero(new) + 1).tolist()]
            out = [e for a, z in itertools.pairwise(cuts) if z - a > 1 for e in cell([c[a:z] for c in rows])]
            kept = [c[cuts[-1] :].copy() for c in rows]
            yield pa.RecordBatch.from_arrays([pa.array([e[i] for e in out], pa.int64()) for i in (0, 1)], ["a", "b"])
        if kept is not None and len(kept[0]) > 1:
            out = cell(kept)
            yield pa.RecordBatch.from_arrays([pa.array([e[i] for e in out], pa.int64()) for i in (0, 1)], ["a", "b"])

    spread = met.repartition(parts(distinct.sparkSession), "i", "k", "x", "y").sortWithinPartitions("i", "k", "x", "y")
    return spread.mapInArrow(run, "a long, b long")


def simhash_components(docs: DataFrame, distance: int = 3, width: int = 3) -> DataFrame:
    """(doc_id, fp, component_id) for every row of `docs` (doc_id long, text string, any others).

    Null and empty texts have fingerprint 0 and are linked like any other; texts of any length are read whole. Rows that repeat a
    doc_id come out once each, in the same component if their texts are alike. A row without doc_id links what is near
    its fingerprint like any other, and gets the smallest doc_id of its component, null if that has none.
    An empty table gives an empty result. Other columns are ignored, whatever their names.
    """
    staged = Staged(docs.sparkSession, "simhash")
    fps = staged.put(fingerprints(docs, width))
    distinct = staged.put(fps.groupBy("fp").agg(F.min("doc_id").alias("low")))
    edges = links(distinct.select("fp", F.col("fp").alias("rep")), distance, staged, distinct.count())
    found = connected_components(edges, staged)
    joined = staged.put(distinct.join(found, distinct["fp"] == found["node"], "left").select("fp", "low", F.coalesce("component", "fp").alias("class")))
    least = joined.groupBy("class").agg(F.min("low").alias("component_id"))
    classes = staged.put(joined.join(least, "class").select("fp", "component_id"))
    return fps.join(classes, "fp").select("doc_id", "fp", "component_id")
