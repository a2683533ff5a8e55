"""Near copies by the Jaccard similarity of word shingles.

Every row gets a key of its own. Equal shingle sets are merged first. Fingerprints within DISTANCE bits, joined on pigeonhole
blocks, and MinHash bands find families of candidates, and within a family the sets themselves are compared, so no link is
a guess. Fingerprints alone can't do it: at a similarity of 0.8 two differ in 10 of 64 bits, and blocks
for twice that, which would be needed to miss nothing, have 3 bits, on which most pairs of a corpus agree. A family
with more shingles than CELL is dealt over pairs of cells, and a cell returns a spanning forest, never its pairs.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import simhash
from .util import Staged, columns, connected_components, parts, unused

#: Words of a shingle, and the similarity from which two texts are near copies.
WIDTH, SIMILARITY = 5, 0.8
#: Bands and the minima of each: at a similarity of 0.8 the chance that no band agrees is (1 - 0.8^4)^32 = 5e-8, and less above.
BANDS, ROWS = 32, 4
#: Shingles of a family that are compared in one task; more are dealt over pairs of cells.
CELL = 4_000_000
#: Bits in which the fingerprints of candidates differ at most.
DISTANCE = 3
#: Shingles whose minima are taken at a time.
CHUNK = 2048
_ODD = np.random.default_rng(20).integers(0, 1 << 63, BANDS * ROWS, np.uint64) * np.uint64(2) + np.uint64(1)
_MIX = np.random.default_rng(21).integers(0, 1 << 63, (BANDS, ROWS), np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_set(text: bytes | None, width: int = WIDTH) -> np.ndarray:
    """The distinct shingles of a text in UTF-8, as sorted hashes; a shorter text is one shingle, one without words has none."""
    return np.unique(simhash.shingle_hashes(text, width))


def bands(own: np.ndarray) -> np.ndarray:
    """A key for each band of minima; texts without words have none."""
    if not len(own):
        return np.zeros(0, np.int64)
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(own), CHUNK):
        np.minimum(least, (_ODD[:, None] * own[None, at : at + CHUNK]).min(1), out=least)
    mixed = (least.reshape(BANDS, ROWS) ^ least.reshape(BANDS, ROWS) >> np.uint64(29)) * _MIX
    return mixed.sum(1, dtype=np.uint64).view(np.int64)


def forest(sets: list[np.ndarray], keys: np.ndarray, side: np.ndarray | None, similarity: float) -> list[tuple[int, int]]:
    """Links of a spanning forest. side: 0 or 1; only links across sides count.

    A text that is reached no longer takes part, and each reached text is held against those not reached yet.
    """
    sizes = np.array([len(x) for x in sets], np.int64)
    tokens, at = np.unique(np.concatenate(sets), return_inverse=True)
    starts = np.concatenate(([0], np.cumsum(sizes)))
    own = [at[a:b] for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True)]
    mark, out = np.zeros(len(tokens), np.int64), []
    left, held = np.arange(len(sets)), at
    front: list[int] = []
    while len(left):
        if not front:
            front, left, held = [int(left[0])], left[1:], held[sizes[left[0]] :]
            continue
        i = front.pop()
        mark[own[i]] = 1
        edges = np.concatenate(([0], np.cumsum(sizes[left])))
        common = np.add.reduceat(mark[held], edges[:-1])
        mark[own[i]] = 0
        near = common >= similarity * (sizes[i] + sizes[left] - common) - 1e-9
        if side is not None:
            near &= side[left] != side[i]
        if near.any():
            found = left[near]
            out += [(int(keys[i]), int(keys[j])) for j in found.tolist()]
            front += found.tolist()
            held = held[np.repeat(~near, sizes[left])]
            left = left[~near]
    return out


def sketches(keyed: DataFrame, width: int) -> DataFrame:
    """(row_key, doc_id, text_hash, same, n, fp, bands) of every row of `keyed` (row_key, doc_id, text); same is equal where the shingle sets are."""
    kinds = (pa.binary(), pa.int64(), pa.int64(), pa.list_(pa.int64()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for at in range(0, big.num_rows, 1024):
                b = big.slice(at, 1024)
                made = []
                for text in b.column(3).to_pylist():
                    hashes = simhash.shingle_hashes(text, width)
                    own = np.unique(hashes)
                    made.append((hashlib.blake2b(own.tobytes(), digest_size=16).digest(), len(own), simhash.fingerprint_of([hashes]), bands(own)))
                yield pa.RecordBatch.from_arrays([*b.columns[:3], *[pa.array([m[i] for m in made], k) for i, k in enumerate(kinds)]], ["row_key", "doc_id", "text_hash", "same", "n", "fp", "bands"])

    rows = keyed.select("row_key", "doc_id", F.xxhash64("text").alias("text_hash"), F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(run, "row_key long, doc_id long, text_hash long, same binary, n long, fp long, bands array<long>")


def links(keyed: DataFrame, distinct: DataFrame, width: int, similarity: float, staged: Staged) -> DataFrame:
    """Edges (a, b) that connect just the rows whose sets are linked by the similarity; distinct: (rep, n, fp, bands)."""
    keys = distinct.select("rep", F.explode("bands").alias("k"))
    met = keys.groupBy("k").agg(F.min("rep").alias("low"), F.count(F.lit(1)).alias("met")).where("met > 1")
    alike = keys.join(met, "k").where("rep <> low").select(F.col("low").alias("a"), F.col("rep").alias("b"))
    near = simhash.links(distinct.where("n > 0").select("fp", "rep"), DISTANCE, staged, distinct.count())
    family = staged.put(connected_components(alike.unionAll(near), staged))
    members = family.join(distinct.select("rep", "n"), F.col("node") == F.col("rep")).select("node", "component", "n")
    cells = members.groupBy("component").agg(F.ceil(F.sum("n") / CELL).cast("int").alias("s"))
    dealt = members.join(cells, "component").withColumn("own", F.pmod(F.xxhash64("node"), F.col("s")).cast("int"))
    dealt = dealt.withColumn("y", F.explode(F.sequence(F.lit(0), F.col("s") - 1)))
    dealt = dealt.select("component", F.least("own", "y").alias("x"), F.greatest("own", "y").alias("y"), F.when(F.col("own") <= F.col("y"), 0).otherwise(1).alias("side"), "node")
    texts = dealt.join(keyed.select("row_key", F.col("text").cast("binary").alias("text")), F.col("node") == F.col("row_key")).select("component", "x", "y", "side", "node", "text")

    def run(key: tuple, group: pa.Table) -> pa.Table:
        group = group.sort_by("node")
        sets = [shingle_set(x, width) for x in group.column("text").to_pylist()]
        side = group.column("side").to_numpy() if key[1].as_py() != key[2].as_py() else None
        out = forest(sets, group.column("node").to_numpy(), side, similarity)
        return pa.table([pa.array([e[i] for e in out], pa.int64()) for i in (0, 1)], names=["a", "b"])

    return texts.repartition(parts(keyed.sparkSession), "component", "x", "y").groupBy("component", "x", "y").applyInArrow(run, "a long, b long")


def drop_near_copies(docs: DataFrame, width: int = WIDTH, similarity: float = SIMILARITY) -> DataFrame:
    """`docs` (doc_id, text, any others) with one row of each group of near copies: that of the smallest doc_id, null last, ties by a hash of the text.

    Groups are the connected components of the texts that are similar; texts are read whole. Texts without words are alike. Rows
    that repeat a doc_id, and rows without one, are documents of their own. An empty table gives an empty result. Other columns come along, whatever their names.
    """
    staged, key = Staged(docs.sparkSession, "nearcopies"), unused(docs.columns, "_row_key")
    whole = staged.put(docs.withColumn(key, F.monotonically_increasing_id()))
    keyed = whole.select(F.col(key).alias("row_key"), "doc_id", "text")
    made = staged.put(sketches(keyed, width))
    distinct = staged.put(made.groupBy("same").agg(F.min("row_key").alias("rep"), F.first("n").alias("n"), F.first("fp").alias("fp"), F.first("bands").alias("bands")))
    found = connected_components(links(keyed, distinct, width, similarity, staged), staged)
    classes = distinct.join(found, distinct["rep"] == found["node"], "left").select("same", F.coalesce("component", "rep").alias("component"))
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "text_hash", "row_key").alias("first"))
    kept = made.join(classes, "same").groupBy("component").agg(first.alias("first")).select(F.col("first.row_key").alias(key))
    return whole.join(kept, key, "left_semi").select(*columns(docs.columns))
