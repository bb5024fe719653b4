"""State of jobs from their events, kept by key with timers.

A job is queued when it is submitted, runs from its first progress report or start, pauses and resumes, and ends as done, failed or
cancelled; what has ended stays so, whatever comes after. Progress is written at most once a second of event time: a report
within a second of the last write waits, a later one takes its place, and a timer writes it when the second is over; the end of a job
writes at once. Each job keeps its last RECENT events, the oldest making room. After a restart, `recovered` queues again what was
queued or running."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

RECENT = 64
#: Milliseconds between two writes of a job's progress.
EVERY_MS = 1000
ENDED = ("done", "failed", "cancelled")
#: Status before (any of these), event, status after.
MOVES = [
    ((None,), "submit", "queued"), ((None, "queued"), "start", "running"), ((None, "queued"), "progress", "running"), (("running",), "pause", "paused"), (("paused",), "resume", "queued"),
    ((None, "queued", "running", "paused"), "cancel", "cancelled"), (("queued", "running"), "done", "done"), (("queued", "running"), "fail", "failed"),
]
AFTER = {(before, event): after for befores, event, after in MOVES for before in befores}
OUT = "job_id long, status string, progress double, writes long, dropped long, recent array<long>"
STATE = "status string, progress double, waiting double, due long, written long, writes long, dropped long"


class Jobs(StatefulProcessor):
    """Events (job_id, seq, at, event, value) by job. The state is one row, and the numbers of the last events in a list of its own."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", STATE)
        self.recent = handle.getListState("recent", "seq long")

    def _write(self, own: dict, now: int) -> None:
        own |= {"progress": own["waiting"], "waiting": None, "due": None, "written": now, "writes": own["writes"] + 1}

    def _out(self, key: tuple, own: dict, recent: list[int]) -> pd.DataFrame:
        return pd.DataFrame({"job_id": [key[0]], "status": [own["status"]], "progress": [own["progress"]], "writes": [own["writes"]], "dropped": [own["dropped"]], "recent": [recent]})

    def _load(self) -> tuple[dict, list[int]]:
        names = [c.split()[0] for c in STATE.split(", ")]
        row = self.state.get() if self.state.exists() else (None, None, None, None, None, 0, 0)
        return dict(zip(names, row, strict=True)), [r[0] for r in self.recent.get()] if self.recent.exists() else []

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        own, recent = self._load()
        due = own["due"]
        events = pd.concat(list(rows)).sort_values("seq")
        for seq, at, event, value in zip(events["seq"], events["at"], events["event"], events["value"], strict=True):
            if own["status"] in ENDED:
                break
            recent.append(int(seq))
            now = int(at.value // 1_000_000)
            if own["due"] is not None and now >= own["due"]:
                self._write(own, own["due"])
            own["status"] = AFTER.get((own["status"], event), own["status"])
            if event == "progress" and own["status"] == "running":
                own["waiting"] = float(value)
                if own["written"] is None or now >= own["written"] + EVERY_MS:
                    self._write(own, now)
                else:
                    own["due"] = own["written"] + EVERY_MS
            if own["status"] in ENDED and own["waiting"] is not None:
                self._write(own, now)
        own["dropped"] += max(0, len(recent) - RECENT)
        recent = recent[-RECENT:]
        self.state.update(tuple(own.values()))
        self.recent.put([(n,) for n in recent])
        if own["due"] is not None and own["due"] != due:
            self.handle.registerTimer(own["due"])
        yield self._out(key, own, recent)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        own, recent = self._load()
        if own["due"] is not None and own["due"] <= expiredTimerInfo.getExpiryTimeInMs():
            self._write(own, own["due"])
            self.state.update(tuple(own.values()))
            yield self._out(key, own, recent)

    def close(self) -> None:
        pass


def job_states(events: DataFrame, late: str = "0 seconds") -> DataFrame:
    """A row for each job whenever its state changes, from a stream of events (job_id, seq, at, event, value). Needs the RocksDB state store."""
    timed = events.withWatermark("at", late)
    return timed.groupBy("job_id").transformWithStateInPandas(statefulProcessor=Jobs(), outputStructType=OUT, outputMode="Update", timeMode="EventTime")


def recovered(status: Column) -> Column:
    """The status of a job after a restart: what was queued or running is queued again, paused and ended jobs stay."""
    return F.when(status.isin("queued", "running"), "queued").otherwise(status)
