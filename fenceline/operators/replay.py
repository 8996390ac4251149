"""Replay of a command log into lock states, in batch."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .leases import Command, Lock, transition

#: Columns of a command log, in order.
COMMANDS = "job string, seq bigint, at bigint, op string, pod string, ttl bigint, token bigint, stale int, candidate string"

OUTCOMES = "job string, seq bigint, at bigint, op string, ok boolean, given bigint, token_before bigint, status_before string, expires_before bigint, status string, token bigint, holder string, run_id string, expires_at bigint"

_NAMES = [x.split()[0] for x in OUTCOMES.split(", ")]


def outcome(job: str, seq: int, before: Lock, after: Lock, cmd: Command, ok: bool) -> tuple:
    given = before.token - cmd.stale if cmd.token is None else cmd.token
    return job, seq, cmd.at, cmd.op, ok, given, before.token, before.status, before.expires_at, after.status, after.token, after.holder, after.run_id, after.expires_at


def command(at: int, op: str, pod: str | None, ttl: int | None, token: int | None, stale: int | None, candidate: str | None) -> Command:
    return Command(op, at, pod or "", 300_000_000 if ttl is None else ttl, token, stale or 0, candidate or "")


def replay(log: DataFrame, profile: str = "as_built") -> DataFrame:
    """The outcome of every command: log has the columns of COMMANDS, the result those of OUTCOMES.

    Commands of a job are applied in the order of (at, seq). Rows without job, time or command are left out; an empty log
    has no outcomes. A job's commands depend on each other, so they are one sequence, but it is streamed through its task:
    only the lock's state is held, not the job's rows.
    """
    types = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        job, lock = None, Lock()
        for batch in batches:
            out = []
            for name, seq, at, op, pod, ttl, token, stale, candidate in zip(*[c.to_pylist() for c in batch.columns]):
                if name != job:
                    job, lock = name, Lock()
                cmd = command(at, op, pod, ttl, token, stale, candidate)
                after, ok = transition(lock, cmd, profile)
                out.append(outcome(name, seq, lock, after, cmd, ok))
                lock = after
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], _NAMES)

    columns = [x.split()[0] for x in COMMANDS.split(", ")]
    known = log.select(*columns).filter("job is not null and at is not null and op is not null")
    return known.repartition("job").sortWithinPartitions("job", "at", "seq").mapInArrow(run, OUTCOMES)
