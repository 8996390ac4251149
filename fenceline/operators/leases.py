"""Lease rules as columns, and the lock's state machine as a transition function."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F

#: as_built keeps leases in whole seconds, as_built_ms to the millisecond, under the same rules.
PROFILES = ("as_built", "as_built_ms", "as_documented", "expiring")

#: Microseconds that the expiring profile keeps a lock's row beyond its lease.
GRACE = 5_000_000


def acquirable(now: Column, status: Column, expires_at: Column) -> Column:
    """Whether a lock can be taken: not paused, and free, orphaned or past its lease."""
    return (status != "PAUSED") & (status.isin("FREE", "ORPHANED") | (expires_at < now))


def renewable(now: Column, status: Column, expires_at: Column, token: Column, given: Column) -> Column:
    """Whether a lease can be renewed: held under the given token and not past. A lapsed lease isn't revived."""
    return (token == given) & (status == "HELD") & (expires_at >= now)


def releasable(status: Column, token: Column, given: Column) -> Column:
    return (token == given) & (status == "HELD")


def orphaned(as_of: Column, status: Column, expires_at: Column) -> Column:
    return (status == "ORPHANED") | ((status == "HELD") & (expires_at < as_of))


def next_run_id(now: Column, status: Column, expires_at: Column, run_id: Column, candidate: Column, profile: str = "as_built") -> Column:
    """The run id after an acquisition: a new one after a clean release (as_built: only while the lease still runs)."""
    free = status == "FREE"
    return F.when(free & (expires_at >= now) if profile.startswith("as_built") else free, candidate).otherwise(run_id)


def whole_seconds(ttl_ms: Column) -> Column:
    """A lease length as stores with second resolution keep it, in milliseconds."""
    return F.floor(ttl_ms / 1000) * 1000


class Lock(NamedTuple):
    """State of one job's lock; times in microseconds."""

    status: str = "FREE"
    token: int = 0
    holder: str = "init"
    run_id: str = "run-0"
    acquired_at: int | None = None
    expires_at: int = 0
    #: The expiring profile only: whether the lock's row is there.
    present: bool = False


class Command(NamedTuple):
    """One command to a lock. token None: the lock's own, less `stale`."""

    op: str
    at: int
    pod: str = ""
    ttl: int = 300_000_000
    token: int | None = None
    stale: int = 0
    candidate: str = ""


def transition(lock: Lock, cmd: Command, profile: str = "as_built") -> tuple[Lock, bool]:
    """The lock after a command, and whether the command took effect.

    Commands: ACQUIRE, RENEW, RELEASE, SAVE (a fenced write: allowed if the token is the lock's), PAUSE, RESUME, ORPHAN,
    CLEAR_LOCK (token back to 0) and NOOP. Where the store keeps whole seconds, the rest of a lease is cut off; stores refuse
    one of less than a second.
    """
    if cmd.op == "NOOP":
        return lock, True
    given = lock.token - cmd.stale if cmd.token is None else cmd.token
    ours = given == lock.token
    if profile == "expiring":
        return _expiring(lock, cmd, ours)
    live = lock.expires_at >= cmd.at
    ttl = cmd.ttl // 1_000_000 * 1_000_000 if profile == "as_built" else cmd.ttl
    match cmd.op:
        case "ACQUIRE":
            if lock.status == "PAUSED" or (lock.status == "HELD" and live):
                return lock, False
            fresh = lock.status == "FREE" and (live or profile == "as_documented")
            run_id = cmd.candidate if fresh else lock.run_id
            return Lock("HELD", lock.token + 1, cmd.pod, run_id, cmd.at, cmd.at + ttl, True), True
        case "RENEW":
            ok = ours and lock.status == "HELD" and live
            return (lock._replace(expires_at=cmd.at + ttl), True) if ok else (lock, False)
        case "RELEASE":
            ok = ours and lock.status == "HELD"
            return (lock._replace(status="FREE"), True) if ok else (lock, False)
        case "SAVE":
            return lock, ours
        case "PAUSE":
            return lock._replace(status="PAUSED"), True
        case "RESUME":
            return lock._replace(status="FREE"), True
        case "ORPHAN":
            return lock._replace(status="ORPHANED"), True
        case "CLEAR_LOCK":
            return lock._replace(status="FREE", holder="", run_id=cmd.candidate, token=0), True
    raise ValueError(f"unknown command {cmd.op!r}")


def _expiring(lock: Lock, cmd: Command, ours: bool) -> tuple[Lock, bool]:
    """A store that drops a lock's row after its lease and a grace: whole seconds, no paused or orphaned locks."""
    now, ttl = cmd.at // 1_000_000 * 1_000_000, cmd.ttl // 1_000_000 * 1_000_000
    there = lock.present and cmd.at <= lock.expires_at + GRACE
    match cmd.op:
        case "ACQUIRE":
            if there and lock.expires_at > now:
                return lock, False
            run_id = lock.run_id if there else cmd.candidate
            return Lock("HELD", lock.token + 1, cmd.pod, run_id, now, now + ttl, True), True
        case "RENEW":
            ok = there and ours and lock.expires_at >= now
            return (lock._replace(expires_at=now + ttl), True) if ok else (lock, False)
        case "RELEASE":
            ok = there and ours
            return (lock._replace(status="FREE", present=False), True) if ok else (lock, False)
        case "SAVE":
            return lock, there and ours
        case "CLEAR_LOCK":
            return lock._replace(status="FREE", holder="", run_id=cmd.candidate, token=0, present=False), True
    return lock, False
