"""Removal of passages that repeat, found by difference-cover anchors.

A difference cover D modulo P has two members for every difference modulo P, so that two windows of `width` words that are equal, wherever they start, have
at one of the same P offsets a position that is in D modulo P in both documents. Hashing width - P + 1 words at
those positions alone finds every repeat: the anchors there are equal. Anchors that occur twice are extended to all whole windows around
them, and these are looked for by 128-bit hashes in the same way. What recurs among the rows a task holds is settled there, so that however
often a passage occurs, few of its rows travel; nothing is compared pair by pair. Of documents with the same words only one asks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, functions as F

from .util import Staged, parts

#: Perfect difference covers, by period.
COVERS = {1: (0,), 3: (0, 1), 7: (0, 1, 3), 13: (0, 1, 3, 9), 21: (0, 1, 4, 14, 16)}
#: Positions that a task holds before it settles what recurs among them, and words whose hashes it keeps.
HELD, KEPT = 1 << 19, 1 << 20
#: The windows' hash is a polynomial in these, modulo 2^64, of the words' hashes; one after the other.
_BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
_M = (1 << 64) - 1


def period(width: int) -> int:
    """The longest period of a cover that leaves anchors of two fifths of the width."""
    return max(p for p in COVERS if p == 1 or 5 * (width - p + 1) >= 2 * width)


def words_of(text: bytes | None) -> list[bytes]:
    return text.split() if text else []


class _Kept(dict):
    """Numbers of words, which say where a word's two hashes stand."""

    def __init__(self):
        super().__init__()
        self.hashes = np.zeros((1024, 2), np.uint64)

    def __missing__(self, word: bytes) -> int:
        n, h = len(self), xxhash.xxh3_128_intdigest(word)
        if n == len(self.hashes):
            self.hashes = np.concatenate([self.hashes, np.zeros_like(self.hashes)])
        self.hashes[n] = h & _M, h >> 64
        self[word] = n
        return n


class Hasher:
    """Hashes of windows of a document's words, in one or two lanes."""

    def __init__(self):
        self.kept = _Kept()
        self.powers = [(np.ones(1, np.uint64), np.ones(1, np.uint64)) for _ in _BASES]

    def _powers(self, lane: int, n: int) -> tuple[np.ndarray, np.ndarray]:
        up, down = self.powers[lane]
        while len(up) <= n:
            m = len(up)
            step, back = pow(_BASES[lane], m, 1 << 64), pow(_BASES[lane], -m, 1 << 64)
            up, down = np.concatenate([up, up * np.uint64(step)]), np.concatenate([down, down * np.uint64(back)])
        self.powers[lane] = up, down
        return up, down

    def windows(self, words: list[bytes], starts: np.ndarray, width: int, lanes: int) -> list[np.ndarray]:
        if len(self.kept) > KEPT:
            self.kept = _Kept()
        ids = np.fromiter(map(self.kept.__getitem__, words), np.int64, len(words))
        out = []
        for lane in range(lanes):
            up, down = self._powers(lane, len(words))
            sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(self.kept.hashes[ids, lane] * up[: len(words)], dtype=np.uint64)])
            h = (sums[starts + width] - sums[starts]) * down[starts]
            h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
            out.append((h ^ (h >> np.uint64(32))).view(np.int64))
        return out


def anchors(n: int, width: int, cover: int) -> np.ndarray:
    """Positions in the cover from which a document of n words has an anchor; none if it has no window."""
    if n < width:
        return np.zeros(0, np.int64)
    at = np.arange(n - (width - cover))
    return at[np.isin(at % cover, COVERS[cover])]


def around(found: np.ndarray, n: int, width: int, cover: int) -> np.ndarray:
    """Starts of the windows that hold one of the anchors at `found`."""
    marks = np.zeros(n + 1, np.int64)
    np.add.at(marks, np.maximum(found - cover + 1, 0), 1)
    np.add.at(marks, found + 1, -1)
    return np.flatnonzero(np.cumsum(marks)[: max(0, n - width + 1)])


def positions(at: pa.Scalar, every: pa.Scalar) -> np.ndarray:
    """What _repeated() found in a document."""
    return np.concatenate([np.array(at.as_py() or [], np.int64), *(np.frombuffer(x, "<i4") for x in every.as_py() or [])])


def pack(text: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=3).compress(text)


def unpack(packed: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(packed)


def _repeated(docs: DataFrame, starts: Callable[[np.ndarray, int], np.ndarray], width: int, lanes: int) -> DataFrame:
    """(row, at array<int>, every array<binary>): positions, `every` as 32-bit integers, of each of `docs` (row, packed, at, every, settled) whose window of `width` words occurs elsewhere among the positions that starts() gives.

    `settled` documents only tell others: all of theirs are known to recur. `at` comes from meeting others' windows, `every` from those in the same task
    (as bytes: rows with arrays are slow to hand over).
    """
    keys = [f"h{i}" for i in range(lanes)]
    names = [*keys, "row", "at", "known", "every"]

    def tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, held, n = Hasher(), [], 0

        def settled() -> pa.RecordBatch:
            """A row for each hash that these documents hold; one for each document that has some twice, with their positions."""
            h = [np.concatenate([x[2][i] for x in held]) for i in range(lanes)]
            doc = np.repeat(np.arange(len(held)), [len(x[1]) for x in held])
            at, known = np.concatenate([x[1] for x in held]), np.array([x[3] for x in held])[doc]
            order = np.lexsort(h[::-1])
            new = np.ones(len(order), bool)
            new[1:] = np.any([x[order][1:] != x[order][:-1] for x in h], axis=0)
            first = np.flatnonzero(new)
            size = np.diff([*first, len(order)])
            often = np.maximum.reduceat(known[order], first) | (size > 1)
            one = order[first]
            twice = np.zeros(len(order), bool)
            twice[order] = np.repeat(size > 1, size)
            twice &= ~known
            ids = np.array([x[0] for x in held], np.int64)
            own = [d for d in np.unique(doc[twice]).tolist()]
            by = np.split(at[twice], np.flatnonzero(np.diff(doc[twice])) + 1) if len(own) else []
            m = len(own)
            spread = [pa.array(np.concatenate([x[one], ids[own]])) for x in h]  # rows with positions go anywhere
            every = pa.array([*[None] * len(one), *[x.astype("<i4").tobytes() for x in by]], pa.binary())
            return pa.RecordBatch.from_arrays([*spread, pa.array(np.concatenate([ids[doc[one]], ids[own]])), pa.array(np.concatenate([at[one], np.full(m, -1)]).astype(np.int32)), pa.array(np.concatenate([often, np.ones(m, bool)])), every], names)

        for b in batches:
            for row, packed, at, every, known in zip(*(b.column(i) for i in range(5)), strict=True):
                words = words_of(unpack(packed.as_py()))
                where = starts(positions(at, every), len(words))
                if len(where):
                    held.append((row.as_py(), where, hasher.windows(words, where, width, lanes), known.as_py()))
                    n += len(where)
                if n >= HELD:
                    yield settled()
                    held, n = [], 0
        if held:
            yield settled()

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come in the order of their hashes: what equals its neighbour, or is known to recur, is answered."""
        last: tuple | None = None  # the hashes of the row before, its document and position, and whether it may still wait for an answer

        def answer(row: list, at: list, every: pa.Array | None = None) -> pa.RecordBatch:
            every = pa.nulls(len(row), pa.binary()) if every is None else every
            return pa.RecordBatch.from_arrays([pa.array(row, pa.int64()), pa.array(at, pa.int32()), every], ["row", "at", "every"])

        for b in batches:
            aside = b.filter(b.column("every").is_valid())
            if aside.num_rows:
                yield answer(aside.column("row"), [None] * aside.num_rows, aside.column("every"))
            b = b.filter(b.column("every").is_null())
            if not b.num_rows:
                continue
            h = np.array([b.column(k).to_numpy() for k in keys])
            row, at, known = b.column("row").to_numpy(), b.column("at").to_numpy(), b.column("known").to_numpy(zero_copy_only=False)
            same = np.all(h[:, 1:] == h[:, :-1], axis=0)
            before = last is not None and bool(np.all(h[:, 0] == last[0]))
            run = np.cumsum(np.concatenate([[0], ~same]))
            size = np.bincount(run)
            often = size > 1
            often |= np.bincount(run, weights=known) > 0
            if before:
                often[0] = True
            hit = often[run] & ~known
            if before and last[3]:
                yield answer([last[1]], [last[2]])
            wait = not hit[-1] and not known[-1]
            last = (h[:, -1].copy(), int(row[-1]), int(at[-1]), wait)
            yield answer(row[hit], at[hit])

    told = docs.select("row", "packed", "at", "every", "settled").mapInArrow(tell, ", ".join([*(f"{k} long" for k in keys), "row long", "at int", "known boolean", "every binary"]))
    met = told.repartition(parts(docs.sparkSession), *keys).sortWithinPartitions(*keys).mapInArrow(meet, "row long, at int, every binary")
    return met.groupBy("row").agg(F.collect_list("at").alias("at"), F.collect_list("every").alias("every"))


def _prepared(docs: DataFrame) -> DataFrame:
    """(row, doc_id, n_words, words_sha256, packed): every row with a number of its own; the digest is of all its words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 256):
                some = b.slice(at, 256)
                joined = [words_of(t.as_py()) for t in some.column(2)]
                n, whole = [len(w) for w in joined], [b" ".join(w) for w in joined]
                columns = [some.column(0), some.column(1), pa.array(n, pa.int64()), pa.array([hashlib.sha256(w).hexdigest() for w in whole]), pa.array([pack(w) for w in whole], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["row", "doc_id", "n_words", "words_sha256", "packed"])

    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long"), F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(run, "row long, doc_id long, n_words long, words_sha256 string, packed binary")


def _kept_words(words: list[bytes], found: np.ndarray, width: int) -> list[bytes]:
    marks = np.zeros(len(words) + 1, np.int64)
    np.add.at(marks, found, 1)
    np.add.at(marks, found + width, -1)
    gone = np.cumsum(marks)[:-1] > 0
    return [words[i] for i in np.flatnonzero(~gone).tolist()]


def without_repeats(docs: DataFrame, width: int = 35, texts: bool = False) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) for every row of `docs` (doc_id, text, any others), and `kept_text` if asked for.

    A word goes if it is in a window of `width` words whose words also start anywhere else, in the same document or
    another; windows are judged on the texts as they are. Words are what white space of ASCII parts, and are compared as they are.
    The kept words are joined by one space. Null and empty texts have no words; a text of fewer than `width` loses none.
    Rows that repeat a doc_id, or have none, are documents of their own, and rows with the same words are each other's repeats.
    Texts of any length are read whole, and one must fit in a task. An empty table gives an empty result. Other columns are ignored, whatever their names.
    Windows are compared by 128-bit hashes.
    """
    if width < 1:
        raise ValueError("a window has a word at least")
    staged, cover = Staged(docs.sparkSession, "passages"), period(width)
    whole = staged.put(_prepared(docs))
    rows = staged.put(whole.drop("packed"))
    long = F.col("n_words") >= width
    # documents with the same words: all of them go if they have a window, and one tells the others
    same = staged.put(rows.where(long).groupBy("words_sha256", "n_words").agg(F.min("row").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1"))  # a table, so that the join can split a large group
    copies = staged.put(rows.join(same, ["words_sha256", "n_words"]).select("row", (F.col("row") == F.col("first")).alias("tells")))
    none, nothing = F.array().cast("array<int>").alias("at"), F.array().cast("array<binary>").alias("every")
    near = _repeated(whole.where(long).select("row", "packed", none, nothing, F.lit(False).alias("settled")), lambda _, n: anchors(n, width, cover), width - cover + 1, 1)
    marked = near.select("row", "at", "every", F.lit(None).cast("boolean").alias("tells")).unionAll(copies.select("row", none, nothing, "tells"))
    marked = marked.groupBy("row").agg(F.flatten(F.collect_list("at")).alias("at"), F.flatten(F.collect_list("every")).alias("every"), F.max("tells").alias("tells"))
    asking = staged.put(whole.select("row", "packed").join(marked.where("tells IS NULL OR tells"), "row").select("row", "packed", "at", "every", F.coalesce("tells", F.lit(False)).alias("settled")))
    if not texts:
        staged.drop(whole)
    found = _repeated(asking, lambda found, n: around(found, n, width, cover), width, 2)
    own = asking.where("not settled").select("row", "packed").join(found, "row")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 256):
                some = b.slice(at, 256)
                before = [words_of(unpack(p.as_py())) for p in some.column(1)]
                after = [_kept_words(w, positions(x, y), width) for w, x, y in zip(before, some.column(2), some.column(3), strict=True)]
                kept = [b" ".join(w) for w in after]
                columns = [some.column(0), pa.array([len(x) - len(y) for x, y in zip(before, after, strict=True)], pa.int64()), pa.array([hashlib.sha256(k).hexdigest() for k in kept])]
                shown = [pa.array([k.decode() for k in kept], pa.string())] if texts else []
                yield pa.RecordBatch.from_arrays([*columns, *shown], ["row", "n_removed", "kept_sha256", *["kept_text"] * texts])

    changed = own.mapInArrow(cut, "row long, n_removed long, kept_sha256 string" + ", kept_text string" * texts)
    gone = copies.select("row", F.lit(True).alias("gone"))
    met = rows.join(changed, "row", "left").join(gone, "row", "left")
    all_gone = F.coalesce("gone", F.lit(False))
    out = met.select("row", "doc_id", "n_words", F.when(all_gone, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"), F.when(all_gone, F.sha2(F.lit(b""), 256)).otherwise(F.coalesce("kept_sha256", "words_sha256")).alias("kept_sha256"), *[F.when(all_gone, "").otherwise(F.col("kept_text")).alias("kept_text")] * texts)
    if not texts:
        return out.drop("row")

    def shown(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 256):
                some = b.slice(at, 256)
                text = [t.as_py() if t.is_valid else unpack(p.as_py()).decode() for t, p in zip(some.column(4), some.column(5), strict=True)]
                yield pa.RecordBatch.from_arrays([*(some.column(i) for i in range(4)), pa.array(text, pa.string())], ["doc_id", "n_words", "n_removed", "kept_sha256", "kept_text"])

    return out.join(whole.select("row", "packed"), "row").drop("row").mapInArrow(shown, "doc_id long, n_words long, n_removed long, kept_sha256 string, kept_text string")


SQL = """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT r, unnest(range(1, len(w) - 33)) AS s FROM d WHERE len(w) >= 35),
h AS (SELECT s.r, s.s, md5(array_to_string(d.w[s.s:s.s + 34], ' ')) AS h FROM s JOIN d USING (r)),
m AS (SELECT h.r, h.s FROM h JOIN (SELECT h FROM h GROUP BY h HAVING count(*) > 1) USING (h)),
g AS (SELECT DISTINCT r, s + j AS p FROM m, (SELECT unnest(range(0, 35)) AS j)),
k AS (SELECT r, list(p) AS gone FROM g GROUP BY r),
w AS (SELECT r, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM d),
c AS (SELECT w.r, string_agg(w.word, ' ' ORDER BY w.p) AS kept FROM w ANTI JOIN g ON g.r = w.r AND g.p = w.p GROUP BY w.r)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(len(k.gone), 0)::BIGINT AS n_removed, sha256(coalesce(c.kept, '')) AS kept_sha256
FROM d LEFT JOIN k USING (r) LEFT JOIN c USING (r)
"""
