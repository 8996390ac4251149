"""Continuous periods and idle gaps of overlapping intervals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.blocked import blocked_lead
from ..functions.keys import block_of, micros
from ..session import written

#: Days in a block of start times; bounds what one task holds of one entity. See block_days_for.
BLOCK_DAYS = 7.0


def _sessions(df: DataFrame, *key: str) -> DataFrame:
    """Merge intervals (s, t) with n members by key, touching ones too: session windows as long as each row says."""
    length = F.make_interval(secs=(F.timestamp_diff("MICROSECOND", F.col("s"), F.col("t")) / F.lit(1_000_000)).cast("decimal(18,6)"))
    merged = df.groupBy(*key, F.session_window("s", length).alias("w")).agg(F.sum("n").alias("n"))
    return merged.select(*key, F.col("w.start").alias("s"), F.col("w.end").alias("t"), "n")


def merge_intervals(df: DataFrame, entity: str, start: str, end: str, block_days: float = BLOCK_DAYS) -> DataFrame:
    """Periods (entity, period_start, period_end, n_members) of intervals that overlap, nest or touch, directly or not.

    Intervals of any length merge exactly to the microsecond. Rows with a null entity, start or end, and those that don't
    end after their start, span no time and are left out; repeated rows count as members each. Other columns are
    ignored. An empty input gives an empty result.

    Session windows merge inside (entity, block of start), and the sessions are written. The latest end of the blocks
    before, by (entity, block), tells which sessions something from an earlier block reaches: those are one interval, as are the
    last sessions of blocks; only these, two a block at most, are merged again over the whole entity. So a hot entity is spread
    over its blocks.
    """
    rows = df.select(F.col(entity).alias("e"), F.col(start).alias("s"), F.col(end).alias("t"))
    rows = rows.filter(F.col("e").isNotNull() & (F.col("t") > F.col("s"))).withColumn("b", block_of("s", block_days))
    before = Window.partitionBy("e").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    sessions = written(_sessions(rows.withColumn("n", F.lit(1).cast("long")), "e", "b"), "sessions")
    reach = sessions.groupBy("e", "b").agg(F.max("t").alias("top")).withColumn("reach", F.max("top").over(before))
    local = sessions.join(reach, ["e", "b"])
    reached = F.coalesce(F.col("s") <= F.col("reach"), F.lit(False))
    local = local.withColumns({"head": reached, "edge": reached | (F.col("t") == F.col("top"))})
    edges = local.filter("edge").groupBy("e", "b", "head").agg(F.min("s").alias("s"), F.max("t").alias("t"), F.sum("n").alias("n"))
    whole = local.filter("not edge").select("e", "s", "t", "n").unionByName(_sessions(edges.select("e", "s", "t", "n"), "e"))
    return whole.select(F.col("e").alias(entity), F.col("s").alias("period_start"), F.col("t").alias("period_end"), F.col("n").alias("n_members"))


def with_next_period(periods: DataFrame, entity: str, block_days: float = BLOCK_DAYS) -> DataFrame:
    """Add next_start, the start of the entity's next period, null for the last; the gap lies between the two."""
    blocked = periods.withColumn("_b", block_of("period_start", block_days))
    return blocked_lead(blocked, [entity], "_b", [F.col("period_start")], {"next_start": "period_start"}).drop("_b")


def gap_micros() -> Column:
    """Length of the gap after a row of with_next_period."""
    return micros("next_start") - micros("period_end")


def periods_and_gaps(df: DataFrame, entity: str, start: str, end: str, block_days: float = BLOCK_DAYS) -> DataFrame:
    """One row for each period and for each gap between successive periods: (entity, span_kind, from_at, to_at, n_members).

    n_members is 0 for gaps. See merge_intervals for what counts.
    """
    spans = with_next_period(merge_intervals(df, entity, start, end, block_days), entity, block_days)
    period = F.struct(F.lit("period").alias("span_kind"), F.col("period_start").alias("from_at"), F.col("period_end").alias("to_at"), F.col("n_members"))
    gap = F.struct(F.lit("gap").alias("span_kind"), F.col("period_end").alias("from_at"), F.col("next_start").alias("to_at"), F.lit(0).cast("long").alias("n_members"))
    both = F.when(F.col("next_start").isNull(), F.array(period)).otherwise(F.array(period, gap))
    return spans.select(F.col(entity), F.inline(both))
