"""Heartbeats, orderly stops, recoveries and ticks, as data."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.blocked import MOST_DAYS, blocked_lag, blocked_running
from ..functions.keys import block_of, micros, millis_between


def heartbeats(outcomes: DataFrame) -> DataFrame:
    """(job, token, renewed, refused, last_renewed_at, lost_at) of each token that a renewal was tried under.

    outcomes: of a replay. A refused renewal means the lock is lost: lost_at is the first. Times in microseconds.
    """
    ok, at = F.col("ok"), F.col("at")
    tried = outcomes.filter("op = 'RENEW'").groupBy("job", F.col("given").alias("token"))
    return tried.agg(
        F.count(F.when(ok, 1)).alias("renewed"),
        F.count(F.when(~ok, 1)).alias("refused"),
        F.max(F.when(ok, at)).alias("last_renewed_at"),
        F.min(F.when(~ok, at)).alias("lost_at"),
    )


def fencing_time(beats: DataFrame, entity: str, at: str, ttl_ms: int, block_days: float = MOST_DAYS) -> DataFrame:
    """(entity, last_ok_at, failed_since, fence_at): when a holder whose renewals fail must stop itself.

    beats: `ok` true for a renewal that went through, null for one that couldn't be tried. Failures are put up with until
    a lease has passed since the last success; fence_at is the first failure at which it has.
    """
    blocked = beats.withColumns({"_b": block_of(at, block_days), "_good": F.when(F.col("ok"), F.col(at))})
    # the latest success so far is the greatest time of one
    judged = blocked_running(blocked, [entity], "_b", [F.col(at)], {"last_ok_at": ("max", "_good")}).filter(F.col("ok").isNull() & F.col("last_ok_at").isNotNull())
    past = millis_between("last_ok_at", at) >= ttl_ms
    return judged.groupBy(entity, "last_ok_at").agg(F.min(at).alias("failed_since"), F.min(F.when(past, F.col(at))).alias("fence_at"))


def stop_commands(locks: DataFrame) -> DataFrame:
    """A RELEASE of every lock held, under its own token."""
    return locks.filter("status = 'HELD'").select(F.col("job_name").alias("job"), F.lit("RELEASE").alias("op"), "token")


def recovery_commands(orphans: DataFrame, registered: DataFrame, suspended: DataFrame) -> DataFrame:
    """An ACQUIRE for every orphan that is registered here and not suspended."""
    mine = orphans.join(registered.select("job_name").distinct(), "job_name", "left_semi").join(suspended.select("job_name"), "job_name", "left_anti")
    return mine.select(F.col("job_name").alias("job"), F.lit("ACQUIRE").alias("op"))


def fixed_rate_ticks(jobs: DataFrame) -> DataFrame:
    """(job_name, tick_at): starts at a rate from first_at to last_at. jobs: job_name, first_at, last_at, rate_ms above 0."""
    step = F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), (F.col("rate_ms") / 1000).cast("decimal(18,6)"))
    return jobs.filter("rate_ms > 0 and last_at >= first_at").select("job_name", F.explode(F.sequence("first_at", "last_at", step)).alias("tick_at"))


def start_delays(runs: DataFrame, tiebreak: str, pause_ms: int, block_days: float = MOST_DAYS) -> DataFrame:
    """runs with late_ms: how much later than a pause after the job's run before each one started; null for the first.

    A rate means run, then pause: ticks missed in the meantime aren't made up for. Runs without a start are left out.
    """
    blocked = runs.filter("started_at is not null").withColumn("_b", block_of("started_at", block_days))
    along = blocked_lag(blocked, ["job_name"], "_b", [F.col("started_at"), F.col(tiebreak)], {"_ended": "finished_at"})
    due = micros("_ended") + F.lit(pause_ms * 1000)
    return along.withColumn("late_ms", F.floor((micros("started_at") - due) / 1000)).drop("_b", "_ended")
