"""Progress of conversions as a stream with state: one place for each document that never falls, whatever order events come in.

    followed(events).writeStream ...        # events: doc, format, stage, seq, ts

State is kept by document in the state store; a timer in event time tells of documents that fell silent before they were complete.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from quire.operators.batch import STAGES
from quire.session import reachable

#: status: moving, complete, or silent (no event for as long as was asked for).
PROGRESS = "doc string, stage string, seq long, step int, total_steps int, n_events long, status string"


def plan_of(kind: str, validate: bool = False) -> list[str]:
    """The stages that a document of a format goes through, as operators.batch.progress_plan has them."""
    return [s for s in STAGES if (validate or s != "validate") and (kind == "pdf" or s != "ocr")]


class Place(StatefulProcessor):
    """A document's newest event by seq, the seqs seen, and when it was last heard of."""

    def __init__(self, silence_ms: int, validate: bool):
        self.silence, self.validate = silence_ms, validate

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "stage string, seq long, format string, heard long")
        self.seen = handle.getMapState("seen", "seq long", "seen boolean")

    def _row(self, key: tuple, last: tuple, status: str) -> Row:
        stages = plan_of(last[2], self.validate)
        step = stages.index(last[0]) + 1 if last[0] in stages else 0
        return Row(doc=key[0], stage=last[0], seq=last[1], step=step, total_steps=len(stages), n_events=sum(1 for _ in self.seen.keys()), status=status)

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        before = tuple(self.last.get()) if self.last.exists() else None
        last, new = before, False
        for r in rows:
            if not self.seen.containsKey((r.seq,)):
                self.seen.updateValue((r.seq,), (True,))
                new = True
            heard = max(int(r.ts.timestamp() * 1000), last[3] if last else 0)
            last = (r.stage, r.seq, r.format, heard) if last is None or r.seq > last[1] else (*last[:3], heard)
        if not new:
            return  # nothing but repeats
        self.last.update(last)
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        complete = last[0] == "complete"
        if not complete:
            self.handle.registerTimer(last[3] + self.silence)
        yield self._row(key, last, "complete" if complete else "moving")

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[Row]:
        if self.last.exists():
            yield self._row(key, tuple(self.last.get()), "silent")

    def close(self) -> None:
        pass


def followed(events: DataFrame, late: str = "10 minutes", silence: int = 600, validate: bool = False) -> DataFrame:
    """PROGRESS rows of a stream (doc, format, stage, seq, ts), for output mode update: one whenever a document's events say something new.

    Events may come in any order and more than once: the one of the largest seq is where a document is, n_events counts different seqs. A document that has not
    been heard of for `silence` seconds of event time, and is not complete, has a row of status silent.
    """
    spark = reachable(events.sparkSession)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    marked = events.selectExpr("cast(doc as string) as doc", "format", "stage", "cast(seq as long) as seq", "ts").withWatermark("ts", late)
    return marked.groupBy("doc").transformWithState(Place(silence * 1000, validate), PROGRESS, "Update", "EventTime")
