"""The pipeline's stages one after the other, each held against what it was given."""

import random
import re

import pytest

import corpus_pipeline as P
from quire.llm import mixing, pii, simhash, toxicity

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    r = random.Random(7)
    words = [a + b for a in ("ta", "ko", "ri", "me", "su", "no") for b in ("n", "la", "der", "x", "ping", "o")]
    prose = lambda n: " ".join(r.choice(words) for _ in range(n))
    rows, labels = [], []
    for i in range(200):
        text = prose(r.randrange(30, 120))
        if i % 10 == 0:
            text = text.replace(" ", " moronface ", 5)
        if i % 9 == 4:
            text += f" write to person{i}@example.org or 10.0.{i}.1"
        rows.append((i, text, "en", "abc"[i % 3] if i % 20 else None, len(text)))
        labels.append((i, 1, int(i % 10 == 0)))
    rows += [(300 + i, rows[3][1], "en", "a", 1) for i in range(30)]  # exact copies
    rows += [(400, None, "en", "a", None), (401, "", None, "b", 0), (402, "lonely", "en", "b", 6)]
    d = tmp_path_factory.mktemp("tables")
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    return str(d)


def test_stages(spark, sf_dir, tmp_path):
    assert [n for n, _ in P.STAGES] == ["toxicity", "simhash", "pii", "mixing", "packing"]
    docs, seen = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for name, stage in P.STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{tmp_path}/{name}")
        out = spark.read.parquet(f"{tmp_path}/{name}")
        assert name == "packing" or out.columns == COLUMNS
        seen.append((docs.collect(), out.collect()))
        docs = out
    (before, after), (_, alone), (_, masked), (_, mixed), (given, packed) = seen
    toxic = {r.doc_id for r in before if r.text and "moronface" in r.text}
    assert {r.doc_id for r in before} - {r.doc_id for r in after} == toxic
    fps = {r.doc_id: simhash.fingerprint(r.text.encode() if r.text else None) % (1 << 64) for r in after}
    low = {i: i for i in fps}
    for _ in range(5):
        low = {i: min(low[j] for j, g in fps.items() if (f ^ g).bit_count() <= 3) for i, f in fps.items()}
    assert {r.doc_id for r in alone} == {i for i in low if low[i] == i} and 3 in {r.doc_id for r in alone}
    assert {r.doc_id for r in masked} == {r.doc_id for r in alone}
    assert not any(pii.base_spans(r.text) for r in masked if r.text)
    assert {r.doc_id: re.sub(r"\[(EMAIL|IP)\]", "", r.text or "") for r in masked if r.text and "[" in r.text}
    goals = {r.doc_id: r.copies for r in mixing.copies(spark.read.parquet(f"{tmp_path}/pii")).collect()}
    assert {i: n for i, n in goals.items() if n} == {i: sum(r.doc_id == i for r in mixed) for i in {r.doc_id for r in mixed}}
    assert sum(p.doc_tokens for p in packed if p.start == 0) == sum(p.length for p in packed) and sum(p.start == 0 for p in packed) == len(given)


def test_run(spark, sf_dir):
    out = P.run(spark, sf_dir)
    assert out.count() and {"doc_id", "sequence_id", "offset"} <= set(out.columns)


def test_empty_documents(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert P.run(spark, str(tmp_path)).collect() == []


def test_clean_documents_stay(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    lexicon = toxicity.learn(docs.where("false"), spark.read.parquet(f"{sf_dir}/labels.parquet").where("false"))
    assert toxicity.scored(docs, lexicon, docs.columns).where(f"score >= {toxicity.THRESHOLD}").count() == 0


def test_clashing_columns_and_ids(spark, sf_dir, tmp_path):
    """Columns named as the stages' own, null and repeated ids: no stage fails, and each row is judged by itself."""
    from pyspark.sql import functions as F

    more = {"score": "0.5D", "lang_pred": "'x'", "ids": "array(1)", "n": "1", "row_key": "7L", "_row_key": "'k'", "_copy": "1", "copies": "2", "component": "3", "_toxicity": "true"}
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    docs = docs.withColumn("doc_id", F.when(F.col("doc_id") % 7 == 1, None).when(F.col("doc_id") % 7 == 2, 2).otherwise(F.col("doc_id")))
    docs = docs.select("*", *[F.expr(v).alias(k) for k, v in more.items()])
    columns, n = docs.columns, []
    for name, stage in P.STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{tmp_path}/{name}")
        out = spark.read.parquet(f"{tmp_path}/{name}")
        assert name == "packing" or out.columns == columns
        n.append((docs.count(), out.count(), docs))
        docs = out
    (_, _, first), (_, alone, _), (_, masked, _), (_, _, _), (mixed, _, taken) = n
    texts = {r.text for r in first.collect()}
    assert alone == masked and len(texts) - 25 <= alone <= len(texts)  # exact copies, a few toxic, null and empty texts alike
    assert docs.where("start = 0").count() == mixed == taken.count()
