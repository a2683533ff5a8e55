"""Toxicity by a weighted lexicon, matched by Aho-Corasick in folded text.

Folding undoes what hides a word: case, accents, look-alike letters of other scripts, digits and signs for
letters, invisible characters. The lexicon's entries (beginnings of words) and its exception phrases
(longer words or pairs that hold an entry harmlessly) are learned from labelled rows, as are the four coefficients that
turn a text's matches, by its length, into a score.
"""

from __future__ import annotations

import bisect
import itertools
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .util import Staged, columns

#: Labelled documents of each class that the lexicon is learned from at most (those of least hash of doc_id). Its size follows from them; an entry must be in two toxic ones and more often in these than in clean ones, whatever their number.
SAMPLE = 8000
#: Entries are beginnings of words, of these lengths, or whole words; log odds that an entry needs, and standard errors taken off them.
PREFIXES, LEAST_ODDS, CAUTION = range(4, 13), 1.5, 1.5
THRESHOLD = 0.3

# Letters of other scripts that look like Latin ones, and signs that stand for letters.
HOMOGLYPHS = {
    "а": "a", "в": "b", "с": "c", "е": "e", "ё": "e", "һ": "h", "і": "i", "ї": "i", "ј": "j", "к": "k", "ӏ": "l", "м": "m", "н": "h", "о": "o", "р": "p", "ѕ": "s", "т": "t", "у": "y", "х": "x", "ԁ": "d", "ԛ": "q", "ԝ": "w", "г": "r", "ѵ": "v",
    "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ω": "w", "ı": "i", "ɑ": "a", "ɡ": "g", "ſ": "s", "ⅼ": "l", "ø": "o", "đ": "d", "ł": "l", "ϲ": "c", "ϳ": "j",
    "Ꭺ": "a", "Ᏼ": "b", "Ꮯ": "c", "Ꭰ": "d", "Ꭼ": "e", "Ꮐ": "g", "Ꮋ": "h", "Ꭵ": "i", "Ꭻ": "j", "Ꮶ": "k", "Ꮮ": "l", "Ꮇ": "m", "Ꮲ": "p", "Ꭱ": "r", "Ꮪ": "s", "Ꭲ": "t", "Ꮩ": "v", "Ꮃ": "w", "Ꮍ": "y", "Ꮓ": "z",
    "ա": "w", "զ": "q", "հ": "h", "յ": "j", "ո": "n", "ս": "u", "ց": "g", "օ": "o", "ք": "f", "Ս": "u", "Տ": "s", "Օ": "o", "Լ": "l",
    "ᴀ": "a", "ʙ": "b", "ᴄ": "c", "ᴅ": "d", "ᴇ": "e", "ꜰ": "f", "ɢ": "g", "ʜ": "h", "ɪ": "i", "ᴊ": "j", "ᴋ": "k", "ʟ": "l", "ᴍ": "m", "ɴ": "n", "ᴏ": "o", "ᴘ": "p", "ʀ": "r", "ꜱ": "s", "ᴛ": "t", "ᴜ": "u", "ᴠ": "v", "ᴡ": "w", "ʏ": "y", "ᴢ": "z",
}
SUBSTITUTES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "|": "i", "!": "i"}


class _Folds(dict):
    """What each character of Unicode becomes, worked out when it is first met."""

    def __missing__(self, code: int) -> str:
        c = chr(code)
        if c in "'\u2019" or unicodedata.category(c) in ("Cf", "Mn", "Me"):  # apostrophes, what isn't seen, what stands on letters
            out = ""
        else:
            plain = "".join(HOMOGLYPHS.get(x, x) for x in unicodedata.normalize("NFKD", c)).lower()
            plain = "".join(HOMOGLYPHS.get(x, x) for x in plain if not unicodedata.combining(x))
            plain = "".join(SUBSTITUTES.get(x, x) for x in plain)
            plain = "".join(x if x.isalnum() else " " for x in plain if x != "'") or " "
            out = plain.replace("l", "i")  # 1, l and i are one letter
        self[code] = out
        return out


_FOLDS = _Folds()


#: Signs that stand for letters only before a letter or digit.
_SIGNS = re.compile(r"[@$!|]+(?!\w)")


def fold(text: str | None) -> str:
    """Words between single or more spaces, with one at either end."""
    if not text:
        return "  "
    if any(c in text for c in "@$!|"):
        text = _SIGNS.sub(" ", text)
    return f" {text.translate(_FOLDS)} "


def _features(folded: str) -> set[str]:
    """Beginnings of words, with the space before them, and whole words with both."""
    out = set()
    for w in set(folded.split()):
        out.add(f" {w} ")
        out.update(f" {w[:k]}" for k in PREFIXES if k <= len(w))
    return out


@dataclass
class Lexicon:
    entries: dict[str, float]
    exceptions: list[str]
    coefficients: np.ndarray

    def automaton(self) -> ahocorasick.Automaton | None:
        found = ahocorasick.Automaton()
        for x in self.exceptions:
            found.add_word(x, (len(x), 0.0))
        for x, w in self.entries.items():
            if x not in found:
                found.add_word(x, (len(x), w))
        if not len(found):
            return None
        found.make_automaton()
        return found

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(x @ self.coefficients, -30, 30)))


def evidence(found: ahocorasick.Automaton | None, folded: str) -> tuple[float, float, float, float]:
    """Constant, log of the summed weights, the same by length, and whether any entry was met outside all exceptions."""
    words = max(1, len(folded.split()))
    if found is None:
        return 1.0, 0.0, 0.0, 0.0
    hits, spared = [], []
    for end, (n, w) in found.iter(folded):
        (hits if w else spared).append((end - n + 1, end, w))
    spared.sort()
    starts, reach = [x for x, _, _ in spared], list(itertools.accumulate((y for _, y, _ in spared), max))
    best: dict[int, float] = {}
    for a, z, w in hits:  # within an exception if, of those that begin no later, one reaches as far
        before = bisect.bisect_right(starts, a)
        if not before or reach[before - 1] < z:
            best[a] = max(best.get(a, 0.0), w)
    total = sum(best.values())
    return 1.0, float(np.log1p(total)), float(np.log1p(100 * total / words)), float(total > 0)


def _sampled(docs: DataFrame, known: DataFrame) -> DataFrame:
    """(text, toxic) of at most SAMPLE documents of each class, chosen by labels alone; only they meet the texts. Of rows that share a doc_id one counts, the same on every run."""
    ids = None
    for label in (0, 1):
        own = known.where(F.col("toxic") == label).orderBy(F.xxhash64("_id"), "_id").limit(SAMPLE)
        ids = own if ids is None else ids.unionAll(own)
    met = docs.select("doc_id", "text").join(F.broadcast(ids), F.col("doc_id") == F.col("_id"))
    return met.groupBy("_id").agg(F.min_by("text", F.xxhash64("text")).alias("text"), F.first("toxic").alias("toxic")).select("text", "toxic")


def learn(docs: DataFrame, labels: DataFrame) -> Lexicon:
    """A lexicon from `docs` (doc_id, text) and `labels` (doc_id, toxic 0 or 1); rows without label or id don't count, a repeated label counts once, as toxic if any is.

    Beginnings of words are counted and weighed where the texts are; only those that tell of toxic texts come to the driver,
    and SAMPLE bounds them. An entry gives way to a shorter one that is as telling. Without rows of both classes the
    lexicon is empty and every text scores 0.
    """
    known = labels.where("toxic is not null and doc_id is not null").groupBy(F.col("doc_id").alias("_id")).agg(F.max("toxic").cast("int").alias("toxic"))
    share = {r.toxic: r.n for r in known.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    staged = Staged(docs.sparkSession, "toxicity")
    sample = staged.put(_sampled(docs, known))
    n = {r.toxic: r.n for r in sample.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not n.get(0) or not n.get(1):
        return Lexicon({}, [], np.array([-30.0, 0.0, 0.0, 0.0]))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = (Counter(), Counter())
        for b in batches:
            for text, toxic in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                seen[toxic].update(_features(fold(text)))
        keys = list(seen[0].keys() | seen[1].keys())
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), *[pa.array([c[k] for k in keys], pa.int64()) for c in seen]], ["feature", "clean", "toxic"])

    counted = sample.mapInArrow(count, "feature string, clean long, toxic long").groupBy("feature").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    # log odds less CAUTION standard errors: few sightings prove little
    t, c = F.col("toxic") + F.lit(0.5), F.col("clean") + F.lit(0.5)
    odds = F.log(t / F.lit(n[1] + 1.0)) - F.log(c / F.lit(n[0] + 1.0)) - F.lit(CAUTION) * F.sqrt(F.lit(1.0) / t + F.lit(1.0) / c)
    telling = counted.where((F.col("toxic") >= 2) & (F.col("toxic") > F.col("clean"))).select("feature", odds.alias("odds")).where(F.col("odds") >= LEAST_ODDS)
    rows = [(r.feature, r.odds) for r in telling.collect()]
    entries: dict[str, float] = {}
    for f, w in sorted(rows, key=lambda r: (len(r[0].rstrip()), r[0])):
        shorter = [entries[f[:k]] for k in range(2, len(f)) if f[:k] in entries]
        if not shorter or w > max(shorter) + 0.7:
            entries[f] = w
    held = Lexicon(entries, [], np.zeros(4))

    def spared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = held.automaton()
        seen = (Counter(), Counter())
        for b in batches:
            for text, toxic in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                folded = fold(text)
                seen[toxic].update({p for p in _phrases(found, folded)})
        keys = list(seen[0].keys() | seen[1].keys())
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), *[pa.array([c[k] for k in keys], pa.int64()) for c in seen]], ["feature", "clean", "toxic"])

    around = sample.mapInArrow(spared, "feature string, clean long, toxic long").groupBy("feature").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    clean = around.where((F.col("clean") >= 2) & (F.col("clean") > 2 * F.col("toxic"))).orderBy("feature").collect()
    held = Lexicon(entries, [r.feature for r in clean if r.feature not in entries], np.zeros(4))

    def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = held.automaton()
        for b in batches:
            x = [evidence(found, fold(t)) for t in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.list_(pa.float64())), b.column(1)], ["x", "toxic"])

    got = sample.mapInArrow(gathered, "x array<double>, toxic int").collect()
    x, y = np.array([r.x for r in got]), np.array([r.toxic for r in got], float)
    staged.drop(sample)
    order = np.lexsort((*x.T, y))
    weight = np.where(y == 1, share[1] / n[1], share[0] / n[0])
    return Lexicon(entries, held.exceptions, _logistic(x[order], y[order], weight[order]))


def _phrases(found: ahocorasick.Automaton | None, folded: str) -> Iterator[str]:
    """The whole word at each match, and it with the word before it."""
    for end, (n, _) in found.iter(folded) if found else ():
        a = end - n + 1
        z = folded.find(" ", a + 1)
        before = folded[: a + 1].rstrip(" ").rfind(" ") if a else -1
        yield folded[a : z + 1]
        if 0 <= before and a - before < 40:
            yield folded[before : z + 1]


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Newton's method with a little ridge."""
    beta, weight = np.zeros(x.shape[1]), weight / weight.sum()
    ridge = np.full(x.shape[1], 1e-3) / np.array([100, 1, 1, 1])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        step = np.linalg.solve((x * (weight * np.maximum(p * (1 - p), 1e-9))[:, None]).T @ x + np.diag(ridge), x.T @ (weight * (y - p)) - ridge * beta)
        beta = beta + np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return beta


def scored(docs: DataFrame, lexicon: Lexicon, keep: list[str] | None = None, name: str = "score") -> DataFrame:
    """(doc_id or the columns of `keep`, and the score under `name`) for every row of `docs` (doc_id, text).

    Null and empty texts are scored as texts without a match. Long texts are scored whole, in time that grows as their length times its logarithm;
    a run of spaces counts as one. Rows that repeat, and rows without doc_id, come out as often as they come in; equal texts have
    equal scores. An empty table gives an empty result. Other columns are ignored, whatever their names; `name` must be none of `keep`.
    """
    keep = keep or ["doc_id"]
    if name.lower() in {c.lower() for c in keep}:
        raise ValueError(f"{name} is a column of the documents: give the score another name")
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)  # bounded by SAMPLE

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        found = own.automaton()
        for b in batches:
            x = np.array([evidence(found, fold(t)) for t in b.column(0).to_pylist()]).reshape(-1, 4)
            yield pa.RecordBatch.from_arrays([*b.columns[1:], pa.array(own.score(x), pa.float64())], [*keep, name])

    made = StructType([*[docs.schema[c] for c in keep], StructField(name, DoubleType())])
    return docs.select("text", *columns(keep)).mapInArrow(run, made)
