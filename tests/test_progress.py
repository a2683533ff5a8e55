"""Progress as a stream with state, against the batch operator."""

import json
import random

from pyspark.sql import functions as F

from quire.operators import batch as B
from quire.streaming import ingest, progress as S


def test_same_as_batch_from_shuffled_and_repeated_events(spark, tmp_path):
    rng = random.Random(3)
    events = []
    for d in range(12):
        kind = "pdf" if d % 2 else "cbz"
        for seq, stage in enumerate(S.plan_of(kind)[: None if d % 3 else 2]):
            events.append({"doc": str(d), "format": kind, "stage": stage, "seq": seq, "ts": f"2024-01-01T00:{seq:02d}:{d:02d}"})
    shuffled = events * 2
    rng.shuffle(shuffled)
    (tmp_path / "in").mkdir()
    schema = "doc string, format string, stage string, seq long, ts timestamp"
    run = lambda: ingest.each_batch(S.followed(ingest.payloads(spark, str(tmp_path / "in"), schema, 1), silence=1200), lambda b: b, str(tmp_path / "out"), str(tmp_path / "state"), "update").awaitTermination(300)
    for i in range(2):
        (tmp_path / f"in/{i}.json").write_text("\n".join(map(json.dumps, shuffled[i::2])))
        run()
    rows = spark.read.parquet(str(tmp_path / "out")).where("status <> 'silent'").withColumn("batch", F.col("batch").cast("int")).collect()
    heard = {}
    for r in sorted(rows, key=lambda r: (r.batch, r.n_events)):
        before = heard.get(r.doc)
        assert before is None or r.seq >= before.seq and r.step >= before.step  # never falls
        heard[r.doc] = r
    want = {r.doc: r for r in B.progress(spark.createDataFrame(events)).collect()}
    assert {d: (r.stage, r.seq, r.n_events) for d, r in heard.items()} == {d: (r.stage, r.seq, r.n_events) for d, r in want.items()}
    plan = {(r.doc_id, r.stage): (r.step, r.total_steps) for r in B.progress_plan(spark.createDataFrame([(str(d), "pdf" if d % 2 else "cbz") for d in range(12)], "doc_id string, format string")).collect()}
    assert all((r.step, r.total_steps) == plan[d, r.stage] and (r.status == "complete") is (r.stage == "complete") for d, r in heard.items())
    # an hour later: what had not ended has fallen silent
    late = {"doc": "late", "format": "pdf", "stage": "ocr", "seq": 1, "ts": "2024-01-01T02:00:00"}
    for i in (2, 3):
        (tmp_path / f"in/{i}.json").write_text(json.dumps(late | {"seq": i, "ts": f"2024-01-01T02:{i:02d}:00"}))
        run()
    silent = {r.doc for r in spark.read.parquet(str(tmp_path / "out")).where("status = 'silent'").collect()}
    assert silent == {d for d, r in heard.items() if r.stage != "complete"}
