"""Checkpoint writes as a stream: each is judged against the lock's token and the row that stands, kept as keyed state."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

#: Events of a job: its lock got a new token (stage_name null), or a checkpoint was written under one.
EVENTS = "job string, seq bigint, at bigint, token bigint, run_id string, stage_name string, status string, stored_value string"

VERDICTS = "job string, seq bigint, at bigint, token bigint, run_id string, stage_name string, status string, stored_value string, verdict string"

_KEY = "run_id string, stage_name string"
_COLUMNS = [x.split()[0] for x in EVENTS.split(", ")]


class CheckpointProcessor(StatefulProcessor):
    """Two states a job: the lock's token, and the highest token that wrote each (run, stage)."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.current = handle.getValueState("current", "token bigint")
        self.written = handle.getMapState("written", _KEY, "token bigint")

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: object) -> Iterator[Row]:
        current = self.current.get()[0] if self.current.exists() else None
        for r in sorted(rows, key=lambda r: (r["at"], r["seq"])):
            if r["stage_name"] is None:
                current = r["token"] if current is None else max(current, r["token"])
                continue
            at = (r["run_id"], r["stage_name"])
            stands = self.written.getValue(at)[0] if self.written.containsKey(at) else None
            verdict = "fenced" if current is not None and r["token"] != current else "kept" if stands is not None and stands > r["token"] else "stored"
            if verdict == "stored":
                self.written.updateValue(at, (r["token"],))
            yield Row(**{c: key[0] if c == "job" else r[c] for c in _COLUMNS}, verdict=verdict)
        if current is not None:
            self.current.update((current,))

    def close(self) -> None:
        pass


def upsert_stream(events: DataFrame) -> DataFrame:
    """events with the verdict on each write: 'stored', 'fenced' (not the lock's token), or 'kept' (a row with a higher token stands).

    A write is fenced only where a token of the lock is known. The events of a micro-batch are put in order of (at, seq) by
    job; bound it by the source's own limit (files or bytes a trigger), as a job's events of one micro-batch are in memory.
    Events without job, time or token are left out. Needs the RocksDB state store.
    """
    known = events.filter("job is not null and at is not null and token is not null")
    return known.groupBy("job").transformWithState(CheckpointProcessor(), VERDICTS, "Append", "None")
