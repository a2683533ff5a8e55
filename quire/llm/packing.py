"""Packing into training sequences by lexical retrieval.

Documents are dealt to shards of bounded size by the tokens of least hash (likely the same for documents that
share many): shards are runs in the order of these, so where one token has too many documents the next parts
them, and after the last of them a hash of the token set. Only equal token sets are spread, by a key of each row. Each
shard has a BM25 inverted index of its distinct texts, with document frequencies of the whole corpus and all terms. A seed's unused
neighbours fill its window from the best score down; what doesn't fit is cut and opens the next window, which
that seed fills, of the next SEEDS ones, whose terms fit it best. So each window of a shard but its last is full. No window takes a text twice while another is left.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from .tokens import word_tokens
from .util import Staged, parts

END_ID = 2
VOCABULARY = 1 << 16
#: Tokens of a shard, about: this bounds the memory of a task.
SHARD_TOKENS = 2_000_000
#: Routing leaves out tokens that it makes no use of: short frequent merges, and those in more than this share of the documents.
FREQUENT_IDS, COMMON = 2048, 0.4
K1, B = 1.2, 0.75
#: Seeds whose neighbours are found at a time, at most, and neighbours that are taken from a seed's scores at a time.
SEEDS, NEIGHBOURS = 64, 64
#: Cells of the table that holds the most frequent terms, postings read at a time, and scores held at a time: they bound memory and change no score.
TABLE, POSTINGS, SCORES = 16_000_000, 2_000_000, 8_000_000
#: Tokens of least hash that are kept of a document, of which those that are not COMMON lead it to its shard, DEPTH of them at most.
LEAST, DEPTH = 64, 8
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def tokenised(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, n, least, same, ids): ids as 16-bit little-endian binary with END_ID at the end; same is a hash of the token set.

    Each partition ends with a row of n = -1, whose `least` is the terms it has met and `ids` in how many documents each, as 64-bit numbers.
    """
    end = np.array([END_ID], "<u2").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, met = word_tokens(path), np.zeros(VOCABULARY, "<i8")
        names = ["doc_id", "n", "least", "same", "ids"]
        for big in batches:
            encoded = tokens.encode_all(big.column(1))
            for at in range(0, big.num_rows, 512):
                b = big.slice(at, 512)
                ids = [x + end for x in encoded[at : at + 512]]
                n = pa.array([len(x) // 2 for x in ids], pa.int64())
                sets = [np.unique(np.frombuffer(x, "<u2")) for x in ids]
                for x in sets:
                    met[x] += 1
                least = pa.array([leasts(x) for x in sets], pa.list_(pa.int32()))
                same = pa.array([xxhash.xxh64_hexdigest(x.tobytes()) for x in sets], pa.string())
                yield pa.RecordBatch.from_arrays([b.column(0), n, least, same, pa.array(ids, pa.binary())], names)
        some = np.flatnonzero(met).astype(np.int32)
        last = [[None], [-1], [some], [None], [met[some].tobytes()]]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(last, (pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.string(), pa.binary()), strict=True)], names)

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n long, least array<int>, same string, ids binary")


def leasts(distinct: np.ndarray) -> np.ndarray:
    """The LEAST of a document's distinct tokens by hash: two documents agree on the first as often as their tokens overlap."""
    rare = distinct[distinct >= FREQUENT_IDS]
    own = (rare if len(rare) else distinct).astype(np.uint32)
    return own[np.argsort(own * np.uint32(2654435761))[:LEAST]].astype(np.int32)


def routed(made: DataFrame, common: list[int]) -> DataFrame:
    """Adds `route`: two hex digits for each of DEPTH tokens of least hash, COMMON ones left out, then those of the set's hash."""
    rare = F.filter("least", lambda t: ~t.isin(common)) if common else F.col("least")
    rare = F.when(F.size(rare) > 0, rare).otherwise(F.col("least"))
    digits = F.array_join(F.transform(F.slice(rare, 1, DEPTH), lambda t: F.lpad(F.lower(F.hex(F.pmod(F.xxhash64(t), F.lit(256)))), 2, "0")), "")
    return made.withColumn("route", F.concat(F.rpad(digits, 2 * DEPTH, "0"), "same"))


def ranges(routes: DataFrame) -> tuple[list[str], list[int], list[int]]:
    """Where each run of routes (route, n) begins, its first shard, and over how many it is spread: more than one only if it is a single route.

    A prefix with too many tokens for a shard is opened to its continuations, so that the driver sees at
    most 256 for each shard that its documents fill, level by level.
    """
    leaves, level, hot = [], 1, None
    while level == 1 or hot:
        own = routes.select(F.substring("route", 1, 2 * level).alias("p"), "n")
        if hot:
            opened = routes.sparkSession.createDataFrame([(x,) for x in hot], "_hot string")
            own = own.join(F.broadcast(opened), F.substring("p", 1, 2 * level - 2) == F.col("_hot"), "left_semi")
        found = own.groupBy("p").agg(F.sum("n")).collect()
        last = level == DEPTH + 8
        leaves += [(p, n) for p, n in found if n <= SHARD_TOKENS or last]
        hot, level = [p for p, n in found if n > SHARD_TOKENS and not last], level + 1
    starts, first, spread, shard, held = [], [], [], 0, 0
    for p, n in sorted(leaves):
        if not starts or held + n > SHARD_TOKENS:
            starts.append(p)
            first.append(shard)
            spread.append(-(-n // SHARD_TOKENS) or 1)
            shard, held = shard + spread[-1], 0
        held += n
    return starts, first, spread


def frequencies(made: DataFrame) -> np.ndarray:
    """In how many documents each token is, from the partitions' last rows: one number for each token of the vocabulary, whatever the corpus."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(VOCABULARY, np.int64)
        for b in batches:
            for terms, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                total[terms] += np.frombuffer(n, "<i8")
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(total[some], pa.int64())], ["term", "n"])

    out = np.zeros(VOCABULARY, np.int64)
    for term, n in made.where("n < 0").select("least", "ids").mapInArrow(run, "term int, n long").groupBy("term").agg(F.sum("n")).collect():
        out[term] = n
    return out


def _spans(starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """All places of the spans, one after the other."""
    n = ends - starts
    return np.arange(n.sum()) - np.repeat(np.cumsum(n) - n - starts, n)


class Shard:
    """A shard's index of distinct texts: BM25 weights by text and by term; terms that many texts have lie in a table instead of postings."""

    def __init__(self, ids: list[np.ndarray], df: np.ndarray, n_docs: int, mean: float):
        lengths = np.array([len(x) for x in ids], np.int64)
        doc, term = np.repeat(np.arange(len(ids)), lengths), np.concatenate([*ids, np.zeros(0, "<u2")]).astype(np.int64)
        key, tf = np.unique(doc << 16 | term, return_counts=True)
        doc, term = key >> 16, key & 0xFFFF
        idf = np.log1p((n_docs - df[term] + 0.5) / (df[term] + 0.5))
        self._arrange(doc, term, idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * lengths[doc] / max(mean, 1))), len(ids))

    def _arrange(self, doc: np.ndarray, term: np.ndarray, weight: np.ndarray, n: int) -> None:
        """doc, term and weight in order of doc, then term."""
        self.n, self.entries = n, (doc, term, weight)
        count = np.bincount(term, minlength=VOCABULARY)
        frequent = np.argsort(-count, kind="stable")[: TABLE // max(1, n)]
        frequent = frequent[count[frequent] > n // 64]
        place = np.full(VOCABULARY, -1)
        place[frequent] = np.arange(len(frequent))
        tabled = place[term] >= 0
        self.table = np.zeros((n, len(frequent)), np.float32)
        self.table[doc[tabled], place[term[tabled]]] = weight[tabled]
        doc, term, weight = doc[~tabled], term[~tabled], weight[~tabled]
        self.doc_terms, self.doc_start = term, np.searchsorted(doc, np.arange(n + 1))
        by_term = np.argsort(term, kind="stable")
        self.docs, self.weights = doc[by_term], weight[by_term]
        self.term_start = np.searchsorted(term[by_term], np.arange(VOCABULARY + 1))

    def keep(self, texts: np.ndarray) -> None:
        """Only `texts`, in order, stay, numbered anew."""
        doc, term, weight = self.entries
        new = np.full(self.n, -1)
        new[texts] = np.arange(len(texts))
        own = new[doc] >= 0
        self._arrange(new[doc[own]], term[own], weight[own], len(texts))

    def scores(self, seeds: np.ndarray) -> np.ndarray:
        """The BM25 score of every text for each seed's terms."""
        out = (self.table[seeds] > 0).astype(np.float32) @ self.table.T
        places = _spans(self.doc_start[seeds], self.doc_start[seeds + 1])
        terms, rows = self.doc_terms[places], np.repeat(np.arange(len(seeds)), self.doc_start[seeds + 1] - self.doc_start[seeds])
        starts, ends = self.term_start[terms], self.term_start[terms + 1]
        read = np.cumsum(ends - starts)
        at = 0
        while at < len(terms):
            to = max(at + 1, int(np.searchsorted(read, (read[at - 1] if at else 0) + POSTINGS, side="right")))
            own, low = _spans(starts[at:to], ends[at:to]), rows[at]
            flat = np.repeat(rows[at:to] - low, ends[at:to] - starts[at:to]) * self.n + self.docs[own]
            high = int(rows[to - 1]) + 1
            out[low:high] += np.bincount(flat, self.weights[own], (high - low) * self.n).reshape(-1, self.n)
            at = to
        return out


def best_of(scores: np.ndarray, n: int) -> np.ndarray:
    """The n texts of highest score above 0, ties to the smaller number."""
    if len(scores) > n:
        least = np.partition(scores, len(scores) - n)[len(scores) - n]
        some = np.flatnonzero(scores >= max(least, np.finfo(np.float32).tiny))
    else:
        some = np.flatnonzero(scores > 0)
    return some[np.lexsort((some, -scores[some]))][:n]


class _Windows:
    """Fills windows with documents, of which `members` lists those of each text."""

    def __init__(self, members: list[list[int]], lengths: list[int], size: int):
        self.members, self.lengths, self.size = [m[::-1] for m in members], lengths, size
        self.window = self.filled = 0
        self.inside: set[int] = set()
        self.out: list[tuple[int, int, int, int, int]] = []

    def put(self, text: int) -> bool:
        """Adds a document of the text; whether that filled the window."""
        doc, was = self.members[text].pop(), self.window
        start, left = 0, self.lengths[text]
        self.inside.add(text)
        while left:
            take = min(left, self.size - self.filled)
            self.out.append((doc, start, take, self.window, self.filled))
            start, left, self.filled = start + take, left - take, self.filled + take
            if self.filled == self.size:
                self.window, self.filled = self.window + 1, 0
                self.inside = {text} if left else set()
        return self.window > was


def windows(ids: list[np.ndarray], df: np.ndarray, n_docs: int, mean: float, size: int) -> list[tuple[int, int, int, int, int]]:
    """(document, start, length, window, offset) of each piece of a shard's documents, window by window."""
    texts: dict[bytes, int] = {}
    of = [texts.setdefault(x.tobytes(), len(texts)) for x in ids]
    members: list[list[int]] = [[] for _ in texts]
    for doc, text in enumerate(of):
        members[text].append(doc)
    distinct = [ids[m[0]] for m in members]
    shard, fill = Shard(distinct, df, n_docs, mean), _Windows(members, [len(x) for x in distinct], size)
    names = np.arange(len(distinct))  # the texts that the index still has
    live = np.ones(len(names), bool)
    while live.any():
        if 4 * live.sum() < 3 * len(names):
            shard.keep(np.flatnonzero(live))
            names, live = names[live], np.ones(int(live.sum()), bool)
        inside = np.isin(names, list(fill.inside))
        seeds = np.flatnonzero(live & ~inside)[: max(1, min(SEEDS, SCORES // len(names)))]
        if not len(seeds):  # only texts that the window has already
            at = int(np.flatnonzero(live)[0])
            own = fill.members[names[at]]
            while own and not fill.put(int(names[at])):
                pass
            live[at] = bool(own)
            continue
        scores, left = shard.scores(seeds), list(range(len(seeds)))
        while left:
            nxt = left.pop(_nearest(fill, names, scores[left]))
            if live[seeds[nxt]] and int(names[seeds[nxt]]) not in fill.inside:
                _fill(fill, names, live, int(seeds[nxt]), scores[nxt])
    return fill.out


def _nearest(fill: _Windows, names: np.ndarray, scores: np.ndarray) -> int:
    """The seed whose terms fit best what opens the window, the first if nothing does."""
    if len(fill.inside) != 1:
        return 0
    (text,) = fill.inside
    at = int(np.searchsorted(names, text))
    return int(scores[:, at].argmax()) if at < len(names) and names[at] == text else 0


def _fill(fill: _Windows, names: np.ndarray, live: np.ndarray, seed: int, scores: np.ndarray) -> None:
    """Puts the seed and its unused neighbours, best first, until the window is full or none is left."""
    full, queue, many = fill.put(int(names[seed])), [], NEIGHBOURS
    live[seed] = bool(fill.members[names[seed]])
    scores[~live] = 0
    while not full:
        for text in fill.inside:
            at = int(np.searchsorted(names, text))
            if at < len(names) and names[at] == text:
                scores[at] = 0
        queue, many = best_of(scores, many).tolist(), 4 * many
        if not queue:
            return
        for at in queue:
            full = fill.put(int(names[at]))
            live[at], scores[at] = bool(fill.members[names[at]]), 0
            if full:
                break


def pack(docs: DataFrame, path: str, size: int = 4096, with_ids: bool = False) -> DataFrame:
    """The pieces of all rows of `docs` (doc_id, text): where each lies in its document and its sequence, and a crc32.

    A null or empty text is END_ID alone. Rows that repeat a doc_id, and rows without one, are documents of
    their own. Texts of any length are cut into as many windows as they fill. Scores that tie go by doc_id, null first. An empty table
    gives an empty result. Other columns are ignored, whatever their names. with_ids adds the
    pieces' ids (array<int>). path: a tokenizer's file, there on every executor.
    """
    spark = docs.sparkSession
    staged = Staged(spark, "packing")
    whole = staged.put(tokenised(docs, path).withColumn("_row_key", F.monotonically_increasing_id()))
    made = whole.where("n >= 0")
    n_docs, total = made.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    df, mean = frequencies(whole), total / max(1, n_docs)
    made = routed(made, [x for x in np.flatnonzero(df > max(1, COMMON * n_docs)).tolist() if x >= FREQUENT_IDS])
    starts, first, spread = ranges(staged.put(made.groupBy("route").agg(F.sum("n").alias("n"))))

    @F.pandas_udf("struct<first int, spread int>")
    def place(route: pd.Series) -> pd.DataFrame:
        at = np.searchsorted(np.array(starts, object), route.to_numpy(object), side="right") - 1
        return pd.DataFrame({"first": np.array(first, np.int32)[at], "spread": np.array(spread, np.int32)[at]})

    dealt = made.withColumn("to", place("route")).select((F.col("to.first") + F.pmod(F.xxhash64("_row_key"), F.col("to.spread")).cast("int")).alias("shard"), "doc_id", "ids")

    def run(key: tuple, group: pa.Table) -> pa.Table:
        rows = sorted(zip(group.column("doc_id").to_pylist(), group.column("ids").to_pylist(), strict=True), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
        ids = [np.frombuffer(x, "<u2") for _, x in rows]
        out: list[tuple] = []
        for doc, start, n, window, offset in windows(ids, df, n_docs, mean, size):
            own = ids[doc][start : start + n].astype("<u4")
            out.append((rows[doc][0], start, n, zlib.crc32(own), len(ids[doc]), key[0].as_py() << 32 | window, offset, *([own] if with_ids else [])))
        cols = list(zip(*out, strict=True))
        kinds = [pa.int64()] * 7 + [pa.list_(pa.int32())] * with_ids
        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"] + ["ids"] * with_ids
        return pa.table([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=names)

    return dealt.repartition(parts(spark), "shard").groupBy("shard").applyInArrow(run, PIECES + ", ids array<int>" * with_ids)
