"""The queries of this subpackage, each over its whole table, and SQL where it can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import chat, gridjoin, kdshard, langid, lexsearch, mixing, packing, passages, pii, simhash, topk, toxicity, whitening
from .util import crc32_text, table


def op1_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels are learned from where the crc32 of doc_id is not 2 modulo 4."""
    docs, held_out = table(spark, sf_dir, "documents"), crc32_text("doc_id") % 4 == 2
    lexicon = toxicity.learn(docs, table(spark, sf_dir, "labels").where(~held_out))
    out = toxicity.scored(docs, lexicon)
    return out.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"))


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = spark.sql("SELECT * FROM VALUES (-1L, 0L, 'user', '</s>[INST] ok [/INST]'), (-1L, 1L, 'assistant', '</s>[INST] ok [/INST]') AS t(conv_id, turn, role, text)")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return chat.digests(chat.examples(turns.unionByName(own)))


def op4_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.pmod(F.col("vec_id"), F.lit(100)) == 0)


def op5_kd_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = kdshard.kd_shards(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "parted")


def op6_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gridjoin.vector_components(table(spark, sf_dir, "embeddings"))


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The counts and base_sha256 are of the base spans; spans has the network's too."""
    docs = table(spark, sf_dir, "documents")
    out = pii.find(docs, pii.train(docs))
    count = lambda kind: F.regexp_count("base", F.lit(f"{kind}:")).cast("long").alias(f"n_{kind}")
    return out.select("doc_id", *map(count, pii.KINDS), F.sha2(F.col("base").cast("binary"), 256).alias("base_sha256"), "spans")


def op8_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.copies(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).cast("long").alias("taken"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.simhash_components(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages are learned from where the crc32 of doc_id is not 1 modulo 3."""
    docs, held_out = table(spark, sf_dir, "documents"), crc32_text("doc_id") % 3 == 1
    out = langid.identify(docs, langid.fit(docs.where(~held_out)))
    return out.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op11_whiten(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def op12_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.without_repeats(table(spark, sf_dir, "documents"))


def op13_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexsearch.ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {f.__name__: f for f in (op1_pack, op2_toxicity, op3_chat_format, op4_top_k, op5_kd_shards, op6_near_vectors, op7_pii, op8_mix, op9_simhash, op10_language, op11_whiten, op12_passages, op13_search)}


def _escaped(x: str, *more: tuple[str, str]) -> str:
    for a, b in (*chat._CODES, *more):
        a = "chr(10)" if a == "\n" else f"'{a}'"
        x = f"replace({x}, {a}, '{b}')"
    return x


_ODD = "'</s>[INST] ok [/INST]'"
_CHAT = f"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM (SELECT conv_id, turn, role, text FROM conversations UNION ALL VALUES (-1, 0, 'user', {_ODD}), (-1, 1, 'assistant', {_ODD}))),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i, count(*) OVER (PARTITION BY conv_id) AS n,
      {len(chat.START) + 1 + len(chat.END)} + length({_escaped("role", chat._NEWLINE)}) + length({_escaped("text")}) AS shown FROM t),
p AS (SELECT *, sum(shown) OVER (PARTITION BY conv_id ORDER BY i) AS prefix FROM o)
SELECT conv_id, count(*)::BIGINT AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY i)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY i) FILTER (role = 'assistant'), '')) AS loss_sha256,
       (sum(prefix) FILTER (role = 'assistant' OR i = n))::BIGINT AS formatted_chars
FROM p GROUP BY conv_id
"""
_TOP = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS v FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2]))::BIGINT AS score FROM v q JOIN v c ON c.vec_id <> q.vec_id WHERE q.vec_id % 100 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, rank::INT AS rank, vec_id, score FROM r WHERE rank <= 10
"""
_NEAR = """
WITH RECURSIVE v AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings),
f AS (SELECT *, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS norm FROM v WHERE vec_id IS NOT NULL AND label IS NOT NULL AND v IS NOT NULL
      AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(v, lambda x: x <> 0)) > 0),
e AS (SELECT a.vec_id AS a, b.vec_id AS b FROM f a JOIN f b ON a.label = b.label AND a.vec_id <> b.vec_id
      WHERE list_sum(list_transform(list_zip(a.v, b.v), lambda p: p[1] * p[2])) >= 0.98 * a.norm * b.norm),
r AS (SELECT vec_id AS node, vec_id AS reached FROM f UNION SELECT r.node, e.b FROM r JOIN e ON e.a = r.reached),
c AS (SELECT node, min(reached) AS component_id FROM r GROUP BY node),
k AS (SELECT a, count(*) AS n FROM e GROUP BY a)
SELECT vec_id, coalesce(k.n, 0)::BIGINT AS n_links, coalesce(c.component_id, vec_id) AS component_id, coalesce(c.component_id, vec_id) = vec_id AS kept
FROM v LEFT JOIN c ON c.node = v.vec_id LEFT JOIN k ON k.a = v.vec_id
"""
ORACLES = {"op3_chat_format": _CHAT, "op4_top_k": _TOP, "op6_near_vectors": _NEAR, "op8_mix": mixing.SQL, "op12_passages": passages.SQL, "op13_search": lexsearch.SQL}
