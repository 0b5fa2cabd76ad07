"""Scan jobs: started, filled with tiles, cancelled between them, uploaded; as a fold over batches and as a stateful stream."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.ranking import fold_state

#: A job's state and result. A cancel is noted while a job works and takes effect at its next tile or at its end.
STATES = (("ready", "none"), ("ready", "cancelled"), ("ready", "done"), ("working", "none"), ("cancelling", "none"), ("error", "failed"))
#: What each event makes of each of them: a start only counts when ready, a failed upload turns the whole job to error.
MOVES = {
    "start": (3, 3, 3, 3, 4, 5), "tile": (0, 1, 2, 3, 1, 5), "cancel": (0, 1, 2, 4, 4, 5), "uploaded": (0, 1, 2, 2, 1, 5),
    "upload_failed": (0, 1, 2, 5, 5, 5), "failed": (0, 1, 2, 5, 5, 5), "reset": (0, 0, 0, 0, 0, 0),
}
_SAME = tuple(range(len(STATES)))


def outcomes(events: DataFrame, key: str, ordinal: str, event: str) -> DataFrame:
    """(key, state, result, n): each job after its n events, in order; events of one job are spread over tasks."""
    folded = fold_state(events, key, ordinal, event, MOVES, tuple("/".join(s) for s in STATES))
    parts = F.split("state", "/")
    return folded.select(key, parts[0].alias("state"), parts[1].alias("result"), F.col("n").cast("long").alias("n"))


class ScanJob(StatefulProcessor):
    """One job's state, the tiles of its present scan, and a timer that fails a scan from which nothing more comes."""

    def __init__(self, timeout_ms: int):
        self.timeout_ms = timeout_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.job = handle.getValueState("job", "state int, events long")
        self.tiles = handle.getListState("tiles", "ordinal long")
        self.timer = handle.getValueState("timer", "at long")

    def _told(self, key: Any, state: int, events: int) -> Row:
        tiles = sum(1 for _ in self.tiles.get()) if self.tiles.exists() else 0
        return Row(job_id=key[0], state=STATES[state][0], result=STATES[state][1], tiles=tiles, n=events)

    def _timed(self, state: int, latest: int | None) -> None:
        """A timer runs while a job works, from its latest event on."""
        if self.timer.exists():
            self.handle.deleteTimer(self.timer.get()[0])
            self.timer.clear()
        if state in (3, 4) and latest is not None:
            self.handle.registerTimer(latest + self.timeout_ms)
            self.timer.update((latest + self.timeout_ms,))

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        state, events = self.job.get() if self.job.exists() else (0, 0)
        latest = None
        for r in sorted(rows, key=lambda r: r.ordinal):  # of one batch
            before, state = state, MOVES.get(r.event, _SAME)[state]
            events += 1
            latest = max(latest or 0, r.ms)
            if r.event == "reset" or before < 3 and state == 3:
                self.tiles.clear()
            elif r.event == "tile" and before in (3, 4):
                self.tiles.appendValue((r.ordinal,))
        self.job.update((state, events))
        self._timed(state, latest)
        yield self._told(key, state, events)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        state, events = self.job.get()
        self.timer.clear()
        if state in (3, 4):
            self.job.update((5, events))
            yield self._told(key, 5, events)


def stream(events: DataFrame, timeout_ms: int = 300_000, late: str = "0 seconds") -> DataFrame:
    """Streaming (job_id, state, result, tiles, n) of events (job_id, ordinal, event, ts): a row per job of each batch with
    events of it, and one when its timer has run out (event time, behind the watermark). Needs the RocksDB state store.

    Events of a job have to come in order from batch to batch; within one batch they are sorted.
    """
    timed = events.withWatermark("ts", late).select("job_id", "ordinal", "event", F.unix_millis("ts").alias("ms"), "ts")
    kind = timed.schema["job_id"].dataType.simpleString()
    return timed.groupBy("job_id").transformWithState(
        statefulProcessor=ScanJob(timeout_ms), outputStructType=f"job_id {kind}, state string, result string, tiles long, n long", outputMode="Update", timeMode="EventTime"
    )
