"""Edges that the operators' docstrings define: very long conversations, clashing names, rows without ids, rows alike in everything."""

import hashlib

from pyspark.sql import functions as F

from quire.llm import chat, topk, util
from quire.llm.util import Staged


def test_a_very_long_conversation_and_clashing_names(spark):
    turns = [(1, i, "user" if i % 2 == 0 else "assistant", ("word " * 3000 if i in (0, 7) else f"t{i}") + "</s>", 1, "x") for i in range(120)]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string, Example int, T string")
    made = chat.examples(df)
    assert made.columns == ["conv_id", "example", "text", "loss_start", "loss_length", "n_turns"] and made.count() == 60
    got = chat.digests(made).first()
    said = "".join(f"{r}\n{t}\n" for _, _, r, t, *_ in turns)
    loss = "".join(t for _, _, r, t, *_ in turns if r == "assistant")
    assert (got.n_turns, got.turns_sha256, got.loss_chars, got.loss_sha256) == (120, hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert chat.digests(chat.examples(df.limit(0))).count() == 0


def test_rows_without_vec_id_take_no_part(spark):
    rows = [(0, [1.0, 0.0]), (None, [9.0, 9.0]), (1, [0.5, 0.0]), (2, [0.25, 0.0])]
    got = topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), F.col("vec_id") == 0, k=5).collect()
    assert [(r.rank, r.vec_id) for r in sorted(got, key=lambda r: r.rank)] == [(1, 1), (2, 2)]


def test_ranks_of_rows_alike_in_everything(spark):
    df = spark.createDataFrame([("a", 1)] * 500 + [(None, 2)] * 300 + [("b", i) for i in range(50)], "g string, n int").repartition(5)
    got = util.rank_within(df, ["g"], ["n"], "rank", Staged(spark, "test")).collect()
    by = {}
    for r in got:
        by.setdefault(r.g, []).append(r.rank)
    assert {g: sorted(x) == list(range(len(x))) for g, x in by.items()} == {"a": True, None: True, "b": True}


def test_running_sums_by_ranges(spark):
    rows = [(i * 7 % 101, i % 5 + 1) for i in range(300)]
    df = spark.createDataFrame(rows, "k int, v int").repartition(6)
    got = util.running_sums(df.withColumn("i", F.monotonically_increasing_id()), [F.col("k").desc(), F.col("i").asc()], {"before": F.col("v"), "n": F.lit(1)}, Staged(spark, "test")).collect()
    assert sorted(r.n for r in got) == list(range(300))
    total = 0
    for r in sorted(got, key=lambda r: r.n):
        assert r.before == total
        total += r.v
    assert [r.k for r in sorted(got, key=lambda r: r.n)] == sorted((k for k, _ in rows), reverse=True)
    assert util.running_sums(df.limit(0), [F.col("k").asc()], {"before": F.col("v")}, Staged(spark, "test")).count() == 0
