"""Language identification, word first.

A known word counts by its log frequency in each language; an unseen one by the longest of its character
n-grams that are known, falling back to shorter ones place by place. The model is fitted on a bounded
sample of labelled rows (SAMPLE), with every word and n-gram seen twice in it, however long; every whole text is scored.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from .util import Staged, columns

#: Labelled rows that the model is fitted on at most, shared evenly by the languages but EACH at least for each (those of least hash), and the longest n-gram.
SAMPLE, EACH, LONGEST = 8000, 50, 5
#: Words whose scores a worker keeps; beyond that the memory starts anew. Longer words aren't kept; they count all the same.
KEPT, KEPT_LENGTH = 200_000, 40
#: Words after which more evidence no longer sharpens the score.
ENOUGH = 12
_EDGES = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum()) + "«»“”„‘’…–—¿¡"


def _word(raw: str) -> str:
    word = raw.strip(_EDGES)
    return word if any(map(str.isalpha, word)) else ""


@dataclass
class Model:
    """words and grams give the row of `rates` that holds a key's log frequency in each language, less their mean."""

    langs: list[str]
    words: dict[str, int]
    grams: dict[str, int]
    rates: np.ndarray
    kept: dict[str, int] = field(default_factory=dict)
    rows: np.ndarray | None = None

    def _vector(self, word: str) -> np.ndarray:
        known = self.words.get(word)
        if known is not None:
            return self.rates[known]
        padded, found = f" {word} ", []
        for i in range(len(padded)):
            for k in range(min(LONGEST, len(padded) - i), 0, -1):
                g = self.grams.get(padded[i : i + k])
                if g is not None:
                    found.append(g)
                    break
        return self.rates[found].mean(0) if found else np.zeros(len(self.langs))

    def _place(self, raw: str) -> int | None:
        """The row that is kept for a word, KEPT if it has no letter; None for one that isn't kept."""
        word = _word(raw)
        if word and (len(raw) > KEPT_LENGTH or len(self.kept) >= KEPT):
            return None
        at = len(self.kept) if word else KEPT
        if word:
            self.rows[at] = self._vector(word)
        if len(raw) <= KEPT_LENGTH and len(self.kept) < KEPT:
            self.kept[raw] = at
        return at

    def score(self, text: str | None) -> tuple[str, float]:
        """The language and its posterior; und and 0 without letters. Languages that score the same go by name."""
        if not text or not self.langs:
            return "und", 0.0
        if self.rows is None:
            self.rows = np.zeros((KEPT + 1, len(self.langs)))
        if len(self.kept) >= KEPT:
            self.kept.clear()
        raws = text.lower().split()
        places, n, total = list(map(self.kept.get, raws)), 0, np.zeros(len(self.langs))
        for i, at in enumerate(places):
            if at is None:
                at = places[i] = self.kept.get(raws[i])
                if at is None:
                    at = places[i] = self._place(raws[i])
                if at is None:
                    total, n, places[i] = total + self._vector(_word(raws[i])), n + 1, KEPT
        own = np.array(places, np.int64)
        n += int(np.count_nonzero(own != KEPT))
        if not n:
            return "und", 0.0
        for at in range(0, len(own), 1 << 16):
            total += self.rows[own[at : at + (1 << 16)]].sum(0)
        mean = total / n * min(n, ENOUGH)
        best = int(np.argmax(mean))
        return self.langs[best], float(1 / np.exp(mean - mean[best]).sum())


def _all_grams(padded: str) -> Iterator[str]:
    for k in range(1, LONGEST + 1):
        for i in range(len(padded) - k + 1):
            yield padded[i : i + k]


def _batches(seen: dict[str, Counter]) -> Iterator[pa.RecordBatch]:
    rows = [(lang, key, n) for lang, c in seen.items() for key, n in c.items()]
    yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate((pa.string(), pa.string(), pa.int64()))], ["lang", "key", "n"])


def word_counts(docs: DataFrame) -> DataFrame:
    """(lang, key, n): how often each word is in the texts of each language of `docs` (text, lang); partitions count their own first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, Counter] = defaultdict(Counter)
        for b in batches:
            for text, lang in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                for raw, n in Counter((text or "").lower().split()).items():
                    if word := _word(raw):
                        seen[lang][word] += n
        yield from _batches(seen)

    return docs.select("text", "lang").mapInArrow(run, "lang string, key string, n long").groupBy("lang", "key").agg(F.sum("n").alias("n"))


def gram_counts(words: DataFrame) -> DataFrame:
    """The same for the n-grams of `words`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, Counter] = defaultdict(Counter)
        for b in batches:
            for lang, word, n in zip(*[c.to_pylist() for c in b.columns], strict=True):
                own = seen[lang]
                for g in _all_grams(f" {word} "):
                    own[g] += n
        yield from _batches(seen)

    return words.select("lang", "key", "n").mapInArrow(run, "lang string, key string, n long").groupBy("lang", "key").agg(F.sum("n").alias("n"))


def _rates(counts: DataFrame, langs: list[str]) -> tuple[list[str], np.ndarray]:
    """The keys seen twice or more, in order, and for each its log frequency by language (half a count where it has none), less the mean over the languages."""
    at = {lang: i for i, lang in enumerate(langs)}
    sums, some = np.zeros(len(langs)), 0
    for lang, n in counts.groupBy("lang").agg(F.sum("n")).collect():
        sums[at[lang]] = n
    some = counts.select("key").distinct().count()
    by = counts.groupBy("key").agg(F.collect_list(F.struct("lang", "n")).alias("by")).where(F.aggregate("by", F.lit(0).cast("long"), lambda a, x: a + x["n"]) >= 2)
    rows = by.orderBy("key").toLocalIterator()
    keys, places, values = [], [[], []], []
    for key, own in rows:
        for lang, n in own:
            places[0].append(len(keys))
            places[1].append(at[lang])
            values.append(n)
        keys.append(key)
    out = np.zeros((len(keys), len(langs)), np.float32)
    out[places[0], places[1]] = values
    if not keys:
        return keys, out
    out = np.log(out + 0.5) - np.log(sums + 0.5 * some)
    return keys, (out - out.mean(1, keepdims=True)).astype(np.float32)


def sampled(labelled: DataFrame) -> DataFrame:
    """(text, lang) of the rows that a model is fitted on: in each language those of least hash of doc_id and text, of which equal ones count once."""
    own = labelled.where("lang is not null").select("text", "lang", F.xxhash64("doc_id", "text").alias("_h"))
    each = max(EACH, SAMPLE // max(1, own.select("lang").distinct().count()))
    order = W.partitionBy("lang").orderBy("_h")
    last = own.select("lang", "_h").distinct().withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= each).groupBy(F.col("lang").alias("_lang")).agg(F.max("_h").alias("_last"))
    return own.join(F.broadcast(last), (F.col("lang") == F.col("_lang")) & (F.col("_h") <= F.col("_last"))).groupBy("lang", "_h").agg(F.first("text").alias("text")).select("text", "lang")


def fit(labelled: DataFrame) -> Model:
    """A model from a bounded sample of `labelled` (doc_id, text, lang); rows without lang don't count.

    What comes to the driver is the counts of the sample's words and n-grams seen twice or more. Texts are counted whole.
    """
    staged = Staged(labelled.sparkSession, "langid")
    words = staged.put(word_counts(sampled(labelled)))
    grams = staged.put(gram_counts(words))
    langs = sorted(r.lang for r in words.select("lang").distinct().collect())
    own, rates = _rates(words, langs)
    parts, more = _rates(grams, langs)
    staged.drop(words)
    staged.drop(grams)
    return Model(langs, {w: i for i, w in enumerate(own)}, {g: len(own) + i for i, g in enumerate(parts)}, np.concatenate([rates, more]))


def identify(docs: DataFrame, model: Model, keep: list[str] | None = None, names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """(doc_id or the columns of `keep`, and two of `names`) for every row of `docs` (doc_id, text): the language and its posterior.

    A text that is null, empty or without a letter is `und` with score 0; so is every text if nothing was
    learned. Texts of any length are scored whole, a word at a time. Languages that score the same go by name. Repeated rows come
    out as often as they come in; an empty table gives an empty result. Other columns are ignored, whatever their names; of `keep` none may be in `names`.
    """
    keep = keep or ["doc_id"]
    if taken := {c.lower() for c in keep} & {c.lower() for c in names}:
        raise ValueError(f"columns in both keep and names: {sorted(taken)}")
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by SAMPLE

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            found = [m.score(x) for x in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[1:], pa.array([x for x, _ in found], pa.string()), pa.array([s for _, s in found], pa.float64())], [*keep, *names])

    made = StructType([*[docs.schema[c] for c in keep], StructField(names[0], StringType()), StructField(names[1], DoubleType())])
    return docs.select("text", *columns(keep)).mapInArrow(run, made)
