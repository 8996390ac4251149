"""Replay of a command stream: the same transitions, with the lock as keyed state."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..operators.leases import Lock, transition
from ..operators.replay import OUTCOMES, command, outcome

_STATE = "status string, token bigint, holder string, run_id string, acquired_at bigint, expires_at bigint, present boolean"
_NAMES = [x.split()[0] for x in OUTCOMES.split(", ")]


class LockProcessor(StatefulProcessor):
    """Keeps one lock a job. Commands of a micro-batch are put in order of (at, seq); late ones are judged by their token."""

    def __init__(self, profile: str = "as_built") -> None:
        self.profile = profile

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.lock = handle.getValueState("lock", _STATE)

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: object) -> Iterator[Row]:
        lock = Lock(*self.lock.get()) if self.lock.exists() else Lock()
        for r in sorted(rows, key=lambda r: (r["at"], r["seq"])):
            cmd = command(r["at"], r["op"], r["pod"], r["ttl"], r["token"], r["stale"], r["candidate"])
            after, ok = transition(lock, cmd, self.profile)
            yield Row(**dict(zip(_NAMES, outcome(key[0], r["seq"], lock, after, cmd, ok))))
            lock = after
        self.lock.update(tuple(lock))

    def close(self) -> None:
        pass


def replay_stream(log: DataFrame, profile: str = "as_built") -> DataFrame:
    """Outcomes of a stream of commands (the columns of COMMANDS). Needs the RocksDB state store.

    Restarted from its checkpoint it goes on with the locks as they were. A job's commands of one micro-batch are in memory to be
    put in order; bound them by the source's own limit (files or bytes a trigger).
    """
    known = log.filter("job is not null and at is not null and op is not null")
    return known.groupBy("job").transformWithState(LockProcessor(profile), OUTCOMES, "Append", "None")


ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
