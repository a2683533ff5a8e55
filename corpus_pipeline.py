"""The corpus pipeline: what is toxic goes, near copies go, personal data is masked, sources are mixed, and the rest is packed.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; whoever runs them writes it as
Parquet and gives the next stage the table read again. All but the last return the columns of documents, and
others that a caller's table has, whatever their names. Rows that repeat a doc_id, or have none, are documents of their own in
every stage; null and empty texts are clean, alike, without personal data, of no words, and one token long. An empty table
gives an empty result. Texts are read whole, of any length.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from quire.llm import mixing, nearcopies, packing, pii, toxicity
from quire.llm.util import Staged, columns, crc32_text, table, unused


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score under the threshold. The labels are learned from as in op2_toxicity; without labels of both classes none is dropped."""
    lexicon = toxicity.learn(docs, table(spark, sf_dir, "labels").where(crc32_text("doc_id") % 4 != 2))
    name = unused(docs.columns, "_toxicity")
    return toxicity.scored(docs, lexicon, docs.columns, name).where(F.col(name) < toxicity.THRESHOLD).select(*columns(docs.columns))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (a Jaccard similarity of 0.8 or more of 5-word shingles), that of the smallest doc_id.

    Candidates come from op9's pigeonhole join of 5-word fingerprints and, since at that similarity most pairs differ in
    more bits than blocks can bear, from MinHash bands; each link is an exact comparison.
    """
    return nearcopies.drop_near_copies(docs)


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with a kind in brackets in place of each span that the patterns or the network find; no document is dropped. Where spans overlap, one kind stands for them."""
    return pii.redact(docs, pii.train(docs))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as op8 takes it: at most three times, or not at all where its source is larger than its target. Ties in size go by a hash of doc_id, then of the text."""
    return mixing.mix(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece lies in the training sequences; a document that is taken several times is packed as often, in windows of their own while other texts are left."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("toxicity", drop_toxic), ("simhash", drop_near_copies), ("pii", mask_personal_data), ("mixing", mix_sources), ("packing", pack)]

#: SQL can't express the learned stages; tests hold each stage against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    staged, docs = Staged(spark, "pipeline"), table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = staged.put(docs)
    return docs
