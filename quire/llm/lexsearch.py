"""Ranked lexical search with a two-level quantised index.

Documents are indexed in blocks of rows. The first level holds, for each term of a block, where it occurs and its
impact there in one byte, rounded up; the second holds the exact counts. A search reads the first level, where bytes give every document's
score an upper and a lower bound; each query's k-th best lower bound over all blocks is its cutoff. Then both levels are read, and every document
whose upper bound reaches the cutoff is scored anew in integers. Documents never move, and queries go out in blocks.
"""

from __future__ import annotations

import itertools
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from .util import Staged

#: Documents and term occurrences of a block, and what a byte stands for: impacts are below 1,000,000.
BLOCK, WORDS, STEP = 4096, 1 << 21, 3922
#: Queries, and terms of queries, sent out at a time; queries scored at a time; terms that an index can be limited to.
QUERIES, ENTRIES, SLICE, VOCABULARY = 1024, 1 << 19, 128, 1 << 20

_KEPT = {*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)}
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c in _KEPT else 32 for c in range(256))
_RAW = "n_docs long, n_terms long, ids array<long>, lengths array<long>, terms array<binary>, starts array<int>, places binary, tfs binary"
_INDEX = "ids array<long>, sizes array<long>, terms array<binary>, starts array<int>, places binary, impacts binary, tfs binary"


def terms_of(text: bytes | None) -> list[bytes]:
    """Terms of a text in UTF-8: runs of letters and digits of ASCII, A-Z lower-cased, and of all characters beyond it."""
    return text.translate(_FOLD).split() if text else []


def _blocks(docs: DataFrame, vocabulary: set[bytes] | None) -> DataFrame:
    """Blocks with exact counts, of the terms in `vocabulary` alone if there is one; lengths count all terms."""
    known = None if vocabulary is None else docs.sparkSession.sparkContext.broadcast(sorted(vocabulary))  # VOCABULARY terms at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = None if known is None else known.value
        fixed = None if names is None else {t: i for i, t in enumerate(names)}

        def block(ids: list, lengths: list[int], found: list[np.ndarray], numbers: dict | None) -> pa.RecordBatch:
            place = np.repeat(np.arange(len(found)), [len(f) for f in found])
            flat = np.concatenate([np.zeros(0, np.int64), *found])
            keys, tfs = np.unique((flat[flat >= 0] << 16) | place[flat >= 0], return_counts=True)
            term, first = np.unique(keys >> 16, return_index=True)
            shown = names if numbers is None else list(numbers)
            columns = [[sum(n > 0 for n in lengths)], [sum(lengths)], [ids], [lengths], [[shown[t] for t in term.tolist()]], [[*first.tolist(), len(keys)]], [(keys & 0xFFFF).astype("<u2").tobytes()], [tfs.astype("<u4").tobytes()]]
            kinds = [pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.binary()), pa.list_(pa.int32()), pa.binary(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], [c.split()[0] for c in _RAW.split(", ")])

        def fresh() -> tuple[list, list[int], list[np.ndarray], dict | None]:
            return [], [], [], None if fixed is not None else defaultdict(itertools.count().__next__)

        now, n = fresh(), 0
        for b in batches:
            for i, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                words = terms_of(text.as_py())
                got = map(fixed.get, words, itertools.repeat(-1)) if fixed is not None else map(now[3].__getitem__, words)
                now[0].append(i)
                now[1].append(len(words))
                now[2].append(np.fromiter(got, np.int64, len(words)))
                n += len(words)
                if len(now[0]) == BLOCK or n >= WORDS:
                    yield block(*now)
                    now, n = fresh(), 0
        if now[0]:
            yield block(*now)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary").alias("text")).mapInArrow(run, _RAW)


def _sizes(lengths: np.ndarray, n: int, total: int) -> np.ndarray:
    """How much a document's length counts against it."""
    if 25 * int(lengths.max(initial=0)) * n < 1 << 62:
        return 75 + 25 * lengths * n // max(total, 1)
    return np.array([75 + 25 * x * n // total for x in lengths.tolist()], np.int64)


def _impacts(tfs: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    return 1_000_000_000 * tfs // (1000 * tfs + 12 * sizes)


class Index:
    """What index() made: `blocks` with both levels, `frequencies` (term, df), and the numbers of documents and terms."""

    def __init__(self, staged: Staged, blocks: DataFrame, frequencies: DataFrame, n: int, total: int):
        self.staged, self.blocks, self.frequencies, self.n, self.total = staged, blocks, frequencies, n, total


def index(docs: DataFrame, vocabulary: set[bytes] | None = None) -> Index:
    """The index of `docs` (doc_id, text, any others), every row of it; with a vocabulary, postings of its terms alone."""
    staged = Staged(docs.sparkSession, "lexsearch")
    raw = staged.put(_blocks(docs, vocabulary))
    n, total = (int(x or 0) for x in raw.agg(F.sum("n_docs"), F.sum("n_terms")).first())

    def quantised(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                ids, lengths, terms, starts, places, tfs = (b.column(c).slice(i, 1) for c in ("ids", "lengths", "terms", "starts", "places", "tfs"))
                sizes = _sizes(lengths.flatten().to_numpy(), n, total)
                exact = _impacts(np.frombuffer(tfs[0].as_py(), "<u4").astype(np.int64), sizes[np.frombuffer(places[0].as_py(), "<u2")])
                rounded = pa.array([(-(-exact // STEP)).astype(np.uint8).tobytes()], pa.binary())
                yield pa.RecordBatch.from_arrays([ids, pa.array([sizes.tolist()], pa.list_(pa.int64())), terms, starts, places, rounded, tfs], [c.split()[0] for c in _INDEX.split(", ")])

    blocks = staged.put(raw.select("ids", "lengths", "terms", "starts", "places", "tfs").mapInArrow(quantised, _INDEX))
    staged.drop(raw)
    each = blocks.select(F.posexplode("terms").alias("i", "term"), "starts").select("term", (F.get("starts", F.col("i") + 1) - F.get("starts", F.col("i"))).alias("n"))
    return Index(staged, blocks, each.groupBy("term").agg(F.sum("n").alias("df")), n, total)


def query_terms(items: DataFrame) -> DataFrame:
    """(q, item_id, term, times): q tells rows of `items` (item_id, text, any others) apart, also where they repeat an id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for q, item, text in zip(*(b.column(i) for i in range(3)), strict=True):
                times: dict[bytes, int] = {}
                for t in terms_of(text.as_py()):
                    times[t] = times.get(t, 0) + 1
                if times:
                    columns = [[q.as_py()] * len(times), [item.as_py()] * len(times), list(times), list(times.values())]
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int64(), pa.binary(), pa.int64()), strict=True)], ["q", "item_id", "term", "times"])

    rows = items.select(F.monotonically_increasing_id().alias("q"), F.col("item_id").cast("long"), F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(run, "q long, item_id long, term binary, times long")


class _Queries:
    """Some queries' weights by term."""

    def __init__(self, rows: list):
        self.q = np.array(sorted({r.q for r in rows}), np.int64)
        at = {q: i for i, q in enumerate(self.q.tolist())}
        self.by: list[dict[bytes, list[tuple[int, int]]]] = [{} for _ in range(0, len(at), SLICE)]
        for r in rows:
            i = at[r.q]
            self.by[i // SLICE].setdefault(bytes(r.term), []).append((i % SLICE, r.weight))

    def slices(self, terms: list[bytes]) -> Iterator[tuple[int, int, list[tuple[int, int, int]]]]:
        """(first query, number of queries, (place of the term in `terms`, query, weight)...) for those that some term meets."""
        for s, own in enumerate(self.by):
            met = [(i, q, w) for i, t in enumerate(terms) if t in own for q, w in own[t]]
            if met:
                yield s * SLICE, min(SLICE, len(self.q) - s * SLICE), met


def _best(score: np.ndarray, ids: np.ndarray, none: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best by score, ties to the smaller id, those without one last."""
    some = np.arange(len(score))
    if len(score) > 4 * k:
        some = np.flatnonzero(score >= np.partition(score, len(score) - k)[len(score) - k])
    return some[np.lexsort((ids[some], none[some], -score[some]))[:k]]


def _bounds(met: list[tuple[int, int, int]], queries: int, docs: int, starts: np.ndarray, places: np.ndarray, impacts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bounds of scores, by query and document: a byte stands for STEP impacts up to its own."""
    high, weights = np.zeros((queries, docs), np.int64), np.zeros((queries, docs), np.int64)
    for t, q, w in met:
        a, z = starts[t], starts[t + 1]
        high[q, places[a:z]] += w * STEP * impacts[a:z]
        weights[q, places[a:z]] += w
    return high - (STEP - 1) * weights, high


def search(found: Index, items: DataFrame, k: int = 20) -> DataFrame:
    """(item_id, rank, doc_id, score): for each row of `items` (item_id, text, any others) the k documents of highest score above 0, all if there are fewer.

    Equal scores go by doc_id, null last; rows that repeat a doc_id count as documents of their own, and rows that repeat an item_id as items
    of their own, each with its ranks. Null and empty texts, on either side, have no terms: such documents are never found, and such items find none.
    Very long texts are read whole. An empty table gives an empty result. Other columns are ignored, whatever their names.
    """
    spark, staged = items.sparkSession, found.staged
    own = staged.put(query_terms(items))
    weight = F.floor(F.lit(1000.0) * F.log(F.lit(2.0 * found.n + 2) / (F.lit(2.0) * F.col("df") + F.lit(1.0))))
    terms = own.select("term").distinct()
    frequencies = found.frequencies.join(terms, "term", "left_semi")
    weighted = staged.put(own.join(frequencies, "term").select("q", "item_id", "term", (weight * F.col("times")).alias("weight")).where("weight > 0"))
    schema, path = "item_id long, rank int, doc_id long, score long", f"{staged.root}/best-{staged.n}"
    n, entries = weighted.agg(F.count_distinct("q"), F.count(F.lit(1))).first()
    if not n:
        return spark.createDataFrame([], schema)
    buckets = 2 * max(-(-n // QUERIES), -(-entries // ENTRIES)) if n > QUERIES or entries > ENTRIES else 1
    weighted = weighted.withColumn("bucket", F.pmod(F.xxhash64("q"), F.lit(buckets)).cast("int"))
    sizes = {r.bucket: (r.n, r.entries) for r in weighted.groupBy("bucket").agg(F.count_distinct("q").alias("n"), F.count(F.lit(1)).alias("entries")).collect()}
    groups: list[list[int]] = []
    for b in sorted(sizes):
        if groups and all(sum(sizes[x][i] for x in groups[-1]) + sizes[b][i] <= most for i, most in enumerate((QUERIES, ENTRIES))):
            groups[-1].append(b)
        else:
            groups.append([b])
    for group in groups:
        best = _searched(found, weighted.where(F.col("bucket").isin(group)), k)
        if len(groups) == 1:
            return best
        best.write.mode("append").parquet(path)  # one table, however many blocks of queries
    return spark.read.schema(schema).parquet(path)


def _searched(found: Index, weighted: DataFrame, k: int) -> DataFrame:
    """search() for one block of queries."""
    queries = _Queries(weighted.select("q", "term", "weight").collect())
    shared = weighted.sparkSession.sparkContext.broadcast(queries)  # QUERIES queries and ENTRIES terms at most, or one query

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries = shared.value
        held: dict[int, np.ndarray] = {}
        for b in batches:
            for r in b.to_pylist():
                starts, places, impacts = np.array(r["starts"]), np.frombuffer(r["places"], "<u2"), np.frombuffer(r["impacts"], np.uint8).astype(np.int64)
                for at, number, met in queries.slices(r["terms"]):
                    low, _ = _bounds(met, number, r["n"], starts, places, impacts)
                    for q in {q for _, q, _ in met}:
                        x = low[q][low[q] > 0]
                        x = np.concatenate([held.get(at + q, x[:0]), np.partition(x, len(x) - k)[-k:] if len(x) > k else x])
                        held[at + q] = np.partition(x, len(x) - k)[-k:] if len(x) > k else x
        rows = [np.repeat(queries.q[list(held)], [len(x) for x in held.values()]), np.concatenate([np.zeros(0, np.int64), *held.values()])] if held else [np.zeros(0, np.int64)] * 2
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in rows], ["q", "low"])

    coarse = found.blocks.select(F.size("ids").alias("n"), "terms", "starts", "places", "impacts")
    ranked = coarse.mapInArrow(first, "q long, low long").withColumn("rank", F.row_number().over(W.partitionBy("q").orderBy(F.desc("low"))))
    cutoffs = {r.q: r.low for r in ranked.where(f"rank = {k}").select("q", "low").collect()}
    least = weighted.sparkSession.sparkContext.broadcast(np.array([cutoffs.get(q, 1) for q in queries.q.tolist()], np.int64))

    def second(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries, cutoff = shared.value, least.value
        held: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for b in batches:
            for r in b.to_pylist():
                starts, places, impacts, tfs = np.array(r["starts"]), np.frombuffer(r["places"], "<u2"), np.frombuffer(r["impacts"], np.uint8).astype(np.int64), np.frombuffer(r["tfs"], "<u4").astype(np.int64)
                none = np.array([x is None for x in r["ids"]])
                ids, sizes = np.array([0 if x is None else x for x in r["ids"]], np.int64), np.array(r["sizes"], np.int64)
                for at, number, met in queries.slices(r["terms"]):
                    _, high = _bounds(met, number, len(ids), starts, places, impacts)
                    reaches = high >= cutoff[at : at + number, None]
                    exact = np.zeros((number, len(ids)), np.int64)
                    for t, q, w in met:
                        a, z = starts[t], starts[t + 1]
                        some = np.flatnonzero(reaches[q, places[a:z]])
                        where = places[a:z][some]
                        exact[q, where] += w * _impacts(tfs[a:z][some], sizes[where])
                    for q in {q for _, q, _ in met}:
                        some = np.flatnonzero(exact[q] > 0)
                        if len(some):
                            old = held.get(at + q)
                            new = (exact[q, some], ids[some], none[some])
                            new = new if old is None else tuple(np.concatenate(x) for x in zip(old, new, strict=True))
                            keep = _best(*new, k)
                            held[at + q] = tuple(c[keep] for c in new)
        sizes = [len(x[0]) for x in held.values()]
        joined = [np.concatenate([x[i] for x in held.values()]) if held else np.zeros(0, np.int64) for i in range(3)]
        columns = [pa.array(np.repeat(queries.q[list(held)], sizes) if held else np.zeros(0, np.int64), pa.int64()), pa.array(joined[1], pa.int64(), mask=joined[2].astype(bool)), pa.array(joined[0], pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, ["q", "doc_id", "score"])

    order = W.partitionBy("q").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    best = found.blocks.mapInArrow(second, "q long, doc_id long, score long").withColumn("rank", F.row_number().over(order)).where(f"rank <= {k}")
    names = weighted.select("q", "item_id").distinct()
    return best.join(names, "q").select("item_id", "rank", "doc_id", "score")


def ranked(docs: DataFrame, items: DataFrame, k: int = 20) -> DataFrame:
    """search() in an index of `docs` that is limited to the items' terms, if they are few enough to be sent out."""
    words = query_terms(items).select("term").distinct()
    some = words.limit(VOCABULARY + 1).collect()
    return search(index(docs, None if len(some) > VOCABULARY else {bytes(r.term) for r in some}), items, k)


SQL = """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS t FROM documents WHERE text IS NOT NULL),
i AS (SELECT row_number() OVER () AS q, item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM benchmark WHERE text IS NOT NULL),
s AS (SELECT count(*) AS n, sum(len(t)) AS total FROM d WHERE len(t) > 0),
p AS (SELECT r, doc_id, len(t) AS size, term, count(*) AS tf FROM (SELECT r, doc_id, t, unnest(t) AS term FROM d) GROUP BY r, doc_id, t, term),
f AS (SELECT term, floor(1000 * ln((2.0::DOUBLE * (SELECT n FROM s) + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM p GROUP BY term),
m AS (SELECT r, doc_id, term, 1000000000 * tf // (1000 * tf + 12 * (75 + (25 * size * n) // total)) AS impact FROM p, s),
c AS (SELECT q, item_id, r, doc_id, sum(f.w * m.impact)::BIGINT AS score FROM i JOIN f USING (term) JOIN m USING (term) GROUP BY q, item_id, r, doc_id),
o AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM c WHERE score > 0)
SELECT item_id, rank::INT AS rank, doc_id, score FROM o WHERE rank <= 20
"""
