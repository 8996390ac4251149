"""Lease-length advice and self-fencing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.blocked import MOST_DAYS, blocked_lag, blocked_recent_max
from ..functions.keys import block_of, micros

#: So many of a job's last durations count for its peak.
RECENT = 10


def peak_of_recent(runs: DataFrame, at: str, tiebreak: str, duration: str, recent: int = RECENT, block_days: float = MOST_DAYS) -> DataFrame:
    """runs with `peak`, the longest of a job's last durations up to this run, in order of (at, tiebreak), inside blocks of time."""
    blocked = runs.withColumn("_b", block_of(at, block_days))
    return blocked_recent_max(blocked, ["job_name"], "_b", [F.col(at), F.col(tiebreak)], duration, "peak", recent).drop("_b")


def lease_advice(peaks: DataFrame, order: list[Column], ttl_seconds: Column) -> DataFrame:
    """The first run of each job at which its peak passes half the lease, with the lease recommended."""
    over = peaks.filter(F.col("peak") > ttl_seconds * 500)
    first = Window.partitionBy("job_name").orderBy(*order)
    advised = over.withColumn("_n", F.row_number().over(first)).filter("_n = 1").drop("_n")  # a group limit ahead of the shuffle
    return advised.withColumn("recommended_ttl_s", F.expr("peak * 2 div 1000 + 1"))


def heartbeat_interval(locks: DataFrame, least_ms: int = 1000, default_ms: int = 10_000) -> DataFrame:
    """One row: a third of the shortest lease, at least least_ms; default_ms without leases. locks: ttl_ms."""
    shortest = F.min(F.expr("ttl_ms div 3"))
    return locks.agg(F.greatest(F.lit(least_ms), F.coalesce(shortest, F.lit(default_ms))).cast("long").alias("interval_ms"))


def self_fenced(renewals: DataFrame, entity: str, at: str, tiebreak: str, ttl_ms: int, block_days: float = MOST_DAYS) -> DataFrame:
    """Renewals that come when the one before is at least a lease old: the holder had to stop itself in between."""
    blocked = renewals.filter(F.col(at).isNotNull()).withColumn("_b", block_of(at, block_days))
    along = blocked_lag(blocked, [entity], "_b", [F.col(at), F.col(tiebreak)], {"_before": at})
    gap = ((micros(at) - micros("_before")) / 1000).cast("long")
    return along.withColumn("gap_ms", gap).filter(F.col("gap_ms") >= ttl_ms).drop("_b", "_before")
