"""Polling and snapshot caches over streams, with keyed state."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..operators.polling import MAX_POLLS

OUTCOMES = "run string, outcome string, polls int, event_id long"
#: Milliseconds for which state that nothing touches is kept.
KEEP = 7 * 24 * 3600 * 1000
SNAPSHOTS = "symbol string, event_id long, ts timestamp, snapshot string"


class FirstTerminal(StatefulProcessor):
    """Of each run the first poll with a verdict, among a bounded number; a run with as many polls and none times out. Polls of a batch go by ts and event_id.

    patience: milliseconds of event time after its first poll at which a run without a verdict times out and its state goes.
    keep: milliseconds after its last poll at which a run's state goes, without patience.
    """

    def __init__(self, limit: int = MAX_POLLS, patience: int | None = None, keep: int | None = KEEP):
        self.limit, self.patience, self.keep = limit, patience, keep

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("seen", "polls int, done boolean", None if self.patience else self.keep)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        new = not self.state.exists()
        polls, done = (0, False) if new else self.state.get()
        for r in sorted(rows, key=lambda r: (r.ts, r.event_id)):
            if new and self.patience:
                self.handle.registerTimer(int(r.ts.timestamp() * 1000) + self.patience)
                new = False
            if done:
                break
            polls += 1
            if r.verdict is not None or polls >= self.limit:
                done = True
                yield Row(run=key[0], outcome=r.verdict or "timeout", polls=polls, event_id=r.event_id if r.verdict else None)
        self.state.update((polls, done))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        polls, done = self.state.get() if self.state.exists() else (0, True)
        self.state.clear()
        if not done:
            yield Row(run=key[0], outcome="timeout", polls=polls, event_id=None)

    def close(self) -> None:
        pass


class LastNonEmpty(StatefulProcessor):
    """For each event its symbol's last snapshot of the day that holds anything; a new day begins without one."""

    def __init__(self, keep: int | None = KEEP):
        self.keep = keep

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("cache", "day string, snapshot string", self.keep)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        day, cached = self.state.get() if self.state.exists() else ("", None)
        for r in sorted(rows, key=lambda r: (r.ts, r.event_id)):
            today = str(r.ts.date())
            if today != day:
                day, cached = today, None
            cached = r.snapshot if r.snapshot is not None else cached
            yield Row(symbol=key[0], event_id=r.event_id, ts=r.ts, snapshot=cached)
        self.state.update((day, cached))

    def close(self) -> None:
        pass


def mode(keep: int | None) -> str:
    """The time mode for state that goes so long after it was touched. With None state stays; a stream that is to end when its input does (availableNow) needs that, as clock time never ends."""
    return "None" if keep is None else "ProcessingTime"


def first_terminal(polls: DataFrame, limit: int = MAX_POLLS, patience: int | None = None, late: str = "1 minute", keep: int | None = KEEP) -> DataFrame:
    """run, outcome, polls, event_id from a stream of run, ts, event_id, verdict. Needs the RocksDB state store.

    With patience (milliseconds) runs also time out by event time, the watermark being so much behind, and state goes then; without it, keep milliseconds after
    a run's last poll (see mode()).
    """
    rows = polls.select(F.col("run").cast("string").alias("run"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").cast("bigint").alias("event_id"), "verdict")
    if patience:
        return rows.withWatermark("ts", late).groupBy("run").transformWithState(FirstTerminal(limit, patience), OUTCOMES, "Append", "EventTime")
    return rows.groupBy("run").transformWithState(FirstTerminal(limit, keep=keep), OUTCOMES, "Append", mode(keep))


def last_non_empty(snapshots: DataFrame, keep: int | None = KEEP) -> DataFrame:
    """symbol, event_id, ts, snapshot from a stream of symbol, ts, event_id, snapshot (null: empty). Needs the RocksDB state store."""
    rows = snapshots.select(F.col("symbol").cast("string").alias("symbol"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").cast("bigint").alias("event_id"), "snapshot")
    return rows.groupBy("symbol").transformWithState(LastNonEmpty(keep), SNAPSHOTS, "Append", mode(keep))
