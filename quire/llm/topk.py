"""Exact top-k by inner product with a three-phase uniform threshold.

A vector's dimensions are cut into blocks; for a query, each block of each partition of candidates is a list of
partial scores, and a score is the sum of its blocks. Phase 1 gathers each list's first entries with
their full scores: the k-th best of them is a cutoff that no result can be below. Phase 2 sends the
cutoffs out: an entry whose score reaches a query's cutoff reaches the cutoff's uniform share in some block, so
entries with such a block suffice. Phase 3 completes just their scores, and the best k of these
are the result. Queries go in blocks of QUERIES; candidates are never moved. Vectors whose products might not be summed exactly
in double precision are scored in integers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from .util import Staged

#: Queries sent out at a time, blocks of dimensions, and candidates scored at a time.
QUERIES, BLOCKS, CANDIDATES = 2048, 4, 8192
#: Sums of products below the first are exact in double precision, below the second in 64-bit integers. Scores beyond those are the largest or smallest of them.
EXACT, LARGEST = 1 << 53, (1 << 63) - 1


def integers(vectors: DataFrame, scale: int = 1024) -> DataFrame:
    """(vec_id, v array<long>) of the vectors that take part: not null, and no component null or not finite. floor(scale * x), x as double; the nearest 64-bit number where that is beyond."""
    x = F.transform("embedding", lambda c: c.cast("double"))
    sound = F.col("embedding").isNotNull() & F.col("vec_id").isNotNull() & ~F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    return vectors.where(sound).select("vec_id", F.transform(x, lambda c: F.floor(c * float(scale))).alias("v"))


def _matrix(b: pa.RecordBatch, d: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and vectors of one batch; shorter vectors end in zeros, which change no product."""
    ids, v = b.column(0).to_numpy(zero_copy_only=False), b.column(1)
    lengths = np.diff(v.offsets.to_numpy())
    flat = v.flatten().to_numpy(zero_copy_only=False)
    out = np.zeros((len(ids), d), np.int64)
    out[np.repeat(np.arange(len(ids)), lengths), np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = flat
    return ids, out


def _exact(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Inner products of integer vectors, whatever their size."""
    bound = float(np.abs(q.astype(float)).max(initial=0)) * float(np.abs(c.astype(float)).max(initial=0)) * q.shape[1]
    if bound < EXACT:
        return (q.astype(float) @ c.T.astype(float)).astype(np.int64)
    if bound < LARGEST / 2:
        return q @ c.T
    return np.clip(q.astype(object) @ c.T.astype(object), -LARGEST - 1, LARGEST).astype(np.int64)


def _best(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best by score, ties to the smaller id."""
    if len(scores) > 4 * k:
        floor = np.partition(scores, len(scores) - k)[len(scores) - k]
        some = np.flatnonzero(scores >= floor)
    else:
        some = np.arange(len(scores))
    return some[np.lexsort((ids[some], ~scores[some]))[:k]]  # ~ turns the order of integers round, the smallest too


def _phase(candidates: DataFrame, queries: tuple[np.ndarray, np.ndarray], cutoff: np.ndarray | None, k: int) -> DataFrame:
    """(query_id, vec_id, score): each partition's best by query. Without cutoffs, of the entries that lead some block's list; with them, of those that reach the cutoff."""
    d = queries[1].shape[1]
    edges = [d * i // BLOCKS for i in range(BLOCKS + 1)]
    shared = candidates.sparkSession.sparkContext.broadcast((queries, cutoff))  # QUERIES rows at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (qids, whole), least = shared.value
        q = whole.astype(np.float64)
        far = np.abs(q).max(1, initial=0) * d
        held: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in qids]

        def take(at: int, ids: np.ndarray, score: np.ndarray) -> None:
            own = ids != qids[at]
            if least is not None:
                own &= score >= least[at]
            if own.any():
                x, s = np.concatenate([held[at][0], ids[own]]), np.concatenate([held[at][1], score[own]])
                keep = _best(x, s, k)
                held[at] = x[keep], s[keep]

        for big in batches:
            for start in range(0, big.num_rows, CANDIDATES):
                ids, rows = _matrix(big.slice(start, CANDIDATES), d)
                c = rows.astype(np.float64)
                size = np.abs(c).max(1, initial=0)
                for lo in range(0, len(qids), 256):
                    plain = size * far[lo : lo + 256].max(initial=0) < EXACT
                    if not plain.all():
                        for i, score in enumerate(_exact(whole[lo : lo + 256], rows[~plain])):
                            take(lo + i, ids[~plain], score)
                    pids, pc = (ids, c) if plain.all() else (ids[plain], c[plain])
                    if not len(pids):
                        continue
                    parts = [q[lo : lo + 256, a:z] @ pc[:, a:z].T for a, z in zip(edges, edges[1:], strict=False)]
                    for i in range(parts[0].shape[0]):
                        if least is None:
                            n = min(k + 1, len(pids))
                            some = np.unique(np.concatenate([np.argpartition(p[i], len(pids) - n)[-n:] for p in parts]))
                        else:
                            some = np.flatnonzero(np.any([p[i] >= least[lo + i] / BLOCKS for p in parts], axis=0))
                        if len(some):
                            take(lo + i, pids[some], np.sum([p[i, some] for p in parts], axis=0).astype(np.int64))
        sizes = [len(x) for x, _ in held]
        cols = [np.repeat(qids, sizes), np.concatenate([x for x, _ in held]), np.concatenate([s for _, s in held])]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["query_id", "vec_id", "score"])

    return candidates.mapInArrow(run, "query_id long, vec_id long, score long")


def top_k(vectors: DataFrame, is_query, k: int = 10, scale: int = 1024) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row of `vectors` (vec_id, embedding) that meets `is_query`, the k others of highest score.

    Ties go to the smaller vec_id, ranks start at 1; fewer candidates give fewer rows. A candidate of the
    query's own vec_id doesn't count; a vec_id that repeats among candidates is listed as often, one that repeats among
    queries is one query, by the smallest of its vectors. Vectors may differ in length: missing components are 0; very long ones
    are held whole, CANDIDATES of them at a time. Components of any size are scored exactly, up to the range of a long.
    Rows without vec_id, whose entries could not be named, are neither queries nor candidates. An empty table, or one without queries, gives an empty result. Other columns are ignored, whatever their names.
    """
    spark = vectors.sparkSession
    staged = Staged(spark, "topk")
    sound = staged.put(integers(vectors, scale))
    d = sound.agg(F.max(F.size("v"))).first()[0] or 0
    queries = sound.where(is_query).groupBy("vec_id").agg(F.min("v").alias("v"))
    n = queries.count()
    blocks = max(1, -(-n // QUERIES))
    queries = staged.put(queries.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(2 * blocks)).cast("int")))
    sizes = {r.block: r["count"] for r in queries.groupBy("block").count().collect()}
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    groups: list[list[int]] = []
    for b in sorted(sizes):
        if groups and sum(sizes[x] for x in groups[-1]) + sizes[b] <= QUERIES:
            groups[-1].append(b)
        else:
            groups.append([b])
    schema, path = "query_id long, rank int, vec_id long, score long", f"{staged.root}/best"
    if not groups:
        return spark.createDataFrame([], schema)
    for own in groups:
        rows = queries.where(F.col("block").isin(own)).orderBy("vec_id").collect()
        q = np.zeros((len(rows), d), np.int64)
        for i, r in enumerate(rows):
            q[i, : len(r.v)] = r.v
        qids = np.array([r.vec_id for r in rows], np.int64)
        seen = _phase(sound, (qids, q), None, k).withColumn("rank", F.row_number().over(order)).where(f"rank = {k}").select("query_id", "score").collect()
        found = dict(map(tuple, seen))
        cutoff = np.array([found.get(x, -LARGEST - 1) for x in qids.tolist()], np.int64)
        best = _phase(sound, (qids, q), cutoff, k).withColumn("rank", F.row_number().over(order)).where(f"rank <= {k}").select("query_id", "rank", "vec_id", "score")
        if len(groups) == 1:
            return best
        best.write.mode("append").parquet(path)  # one table, however many blocks of queries
    return spark.read.schema(schema).parquet(path)
