"""Audits of logs: side effects by two holders, writes out of order, recovery, invariants."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.blocked import blocked_running
from ..functions.keys import block_of, micros

#: Days of time in a block; see block_days_for.
BLOCK_DAYS = 7.0


def rival_effects(log: DataFrame, entity: str, actor: str, at: str, seconds: int, block_days: float = BLOCK_DAYS) -> DataFrame:
    """The rows of log that follow one of another actor on the same entity by less than so many seconds.

    Instead of joining the log with itself, the least and greatest actor of the seconds before are compared with the
    row's own. Rows at the same time don't follow each other. Windows stay inside (entity, block of time): a row near a
    block's end goes into the next block too, where it is only looked back at.
    """
    reach, length = seconds * 1_000_000 - 1, max(1, int(block_days * 86_400_000_000))
    own, last = (F.floor(us / F.lit(length)) for us in (F.col("_us"), F.col("_us") + reach))
    spread = log.filter(F.col(at).isNotNull()).withColumn("_us", micros(at)).withColumns({"_own": own, "_b": F.explode(F.sequence(own, last))})
    before = Window.partitionBy(entity, "_b").orderBy("_us").rangeBetween(-reach, -1)
    marked = spread.withColumns({"_low": F.min(actor).over(before), "_high": F.max(actor).over(before)}).filter("_b = _own")
    return marked.filter((F.col("_low") != F.col(actor)) | (F.col("_high") != F.col(actor))).drop("_us", "_own", "_b", "_low", "_high")


def out_of_order(log: DataFrame, entity: str, at: str, tiebreak: str, token: str, block_days: float = BLOCK_DAYS) -> DataFrame:
    """Writes with a lower token than one before them, with that highest token so far (run_max)."""
    blocked = log.withColumn("_b", block_of(at, block_days))
    order = [F.col(at), F.col(tiebreak)]
    run = blocked_running(blocked, [entity], "_b", order, {"run_max": ("max", token)}, include_current=False)
    return run.filter(F.col(token) < F.col("run_max")).drop("_b")


def guarded(log: DataFrame, entity: str, at: str, tiebreak: str, token: str, block_days: float = BLOCK_DAYS) -> DataFrame:
    """log with `accepted`: whether a ledger that refuses lower tokens than the one it has takes the write."""
    blocked = log.withColumn("_b", block_of(at, block_days))
    run = blocked_running(blocked, [entity], "_b", [F.col(at), F.col(tiebreak)], {"_held": ("max", token)}, include_current=False)
    return run.withColumn("accepted", F.coalesce(F.col(token) >= F.col("_held"), F.lit(True))).drop("_b", "_held")


def ledgers(log: DataFrame, entity: str, at: str, tiebreak: str, token: str, block_days: float = BLOCK_DAYS) -> DataFrame:
    """(entity, final, guarded_final, expected): the token that the last write leaves in a ledger that takes all, that a guarded
    one ends with, and the highest there was. Writes without a token or a time are left out."""
    known = log.filter(F.col(token).isNotNull() & F.col(at).isNotNull())
    last = F.struct(at, tiebreak)
    return guarded(known, entity, at, tiebreak, token, block_days).groupBy(entity).agg(
        F.max_by(token, last).alias("final"), F.max_by(token, F.when(F.col("accepted"), last)).alias("guarded_final"), F.max(token).alias("expected")
    )


def invariant_breaks(outcomes: DataFrame) -> DataFrame:
    """(rule, n): how often what must never be is in a log of outcomes (the columns of a replay), one row a rule.

    token_falls: a token lower after a command than before, but for a lock that was cleared. double_holding: a lock taken while
    another held it. two_holders: a token given to several. revived_leases: a renewal after the lease had passed.
    zombie_writes: a write under another token than the lock's. stolen_unmarked: a release under another token than the
    lock's. One pass over the log, pre-aggregated by (job, token).
    """
    taken = (F.col("op") == "ACQUIRE") & F.col("ok")
    other = F.col("ok") & (F.col("given") != F.col("token_before"))
    rules = {
        "token_falls": (F.col("token") < F.col("token_before")) & (F.col("op") != "CLEAR_LOCK"),
        "double_holding": taken & (F.col("status_before") == "HELD") & (F.col("expires_before") >= F.col("at")),
        "revived_leases": (F.col("op") == "RENEW") & F.col("ok") & (F.col("expires_before") < F.col("at")),
        "zombie_writes": (F.col("op") == "SAVE") & other,
        "stolen_unmarked": (F.col("op") == "RELEASE") & other,
    }
    holder = F.when(taken, F.col("holder"))
    per = outcomes.groupBy("job", "token").agg(*[F.count(F.when(c, 1)).alias(r) for r, c in rules.items()], F.min(holder).alias("low"), F.max(holder).alias("high"))
    whole = per.agg(*[F.coalesce(F.sum(r), F.lit(0)).alias(r) for r in rules], F.count(F.when(F.col("low") != F.col("high"), 1)).alias("two_holders"))
    return whole.select(F.inline(F.array(*[F.struct(F.lit(r).alias("rule"), F.col(r).alias("n")) for r in [*rules, "two_holders"]])))


def progress_findings(writes: DataFrame, job: str, key: list[str], item: str, at: str, tiebreak: str, block_days: float = BLOCK_DAYS) -> DataFrame:
    """(job, resets, repeats) of jobs: writes whose cursor is before one stored earlier under the key, and cursors stored again."""
    rows = writes.filter(F.col(item).isNotNull() & F.col(at).isNotNull()).withColumn("_b", block_of(at, block_days))
    run = blocked_running(rows, [job, *key], "_b", [F.col(at), F.col(tiebreak)], {"_top": ("max", item)}, include_current=False)
    resets = run.groupBy(job).agg(F.count(F.when(F.col(item) < F.col("_top"), 1)).alias("resets"))
    again = rows.groupBy(job, *key, item).agg(F.count(F.lit(1)).alias("n")).groupBy(job).agg(F.sum(F.col("n") - 1).alias("repeats"))
    return resets.join(again, job)


def running_count(log: DataFrame, entity: str, at: str, tiebreak: str, block_days: float = BLOCK_DAYS) -> DataFrame:
    """log with n_so_far, the rows of the entity up to this one."""
    blocked = log.withColumn("_b", block_of(at, block_days)).withColumn("_one", F.lit(1))
    return blocked_running(blocked, [entity], "_b", [F.col(at), F.col(tiebreak)], {"n_so_far": ("count", "_one")}).drop("_b", "_one")


def normalised(log: DataFrame, entity: str, at: str) -> DataFrame:
    """log with `position`, where between the entity's first and last row a row lies, from 0 to 1."""
    ends = log.groupBy(entity).agg(F.min(at).alias("_first"), F.max(at).alias("_last"))
    span = F.greatest(micros("_last") - micros("_first"), F.lit(1))
    place = (micros(at) - micros("_first")) / span
    return log.join(ends, entity).withColumn("position", F.greatest(F.lit(0.0), F.least(F.lit(1.0), place))).drop("_first", "_last")


def known_at(writes: DataFrame, timeline: DataFrame, entity: str, at: str, value: str, block_days: float = BLOCK_DAYS) -> DataFrame:
    """writes with the value that the timeline (entity, at, value) had last at or before each write; null before its first.

    An as-of join: both are put in one order, and the last value known is carried along, inside blocks of time first.
    """
    order = [F.col("_at"), F.col("_side")]
    left = writes.withColumns({"_at": F.col(at), "_side": F.lit(1), "_value": F.lit(None).cast(timeline.schema[value].dataType)})
    right = timeline.select(F.col(entity), F.col(at).alias("_at"), F.lit(0).alias("_side"), F.col(value).alias("_value"))
    both = left.unionByName(right, allowMissingColumns=True).withColumn("_b", block_of("_at", block_days))
    held = blocked_running(both.filter("_at is not null"), [entity], "_b", order, {f"{value}_then": ("last", "_value")})
    return held.filter("_side = 1").drop("_at", "_side", "_value", "_b")


def takeover(log: DataFrame, entity: str, actor: str, at: str, tiebreak: str) -> DataFrame:
    """(entity, lost_at, taken_at, seconds): from the first row of an entity to the first by another actor.

    Two aggregations instead of a join on inequality: each actor's first row, then the first two of those.
    """
    firsts = log.filter(F.col(actor).isNotNull()).groupBy(entity, actor).agg(F.min(F.struct(at, tiebreak)).alias("first"))
    lost = firsts.groupBy(entity).agg(F.min("first").alias("lost"))
    later = firsts.join(lost, entity).filter(F.col("first") > F.col("lost"))
    both = later.groupBy(entity).agg(F.first("lost").alias("lost"), F.min("first").alias("taken"))
    seconds = F.round((micros(F.col("taken")[at]) - micros(F.col("lost")[at])) / 1_000_000).cast("long")
    return both.select(entity, F.col("lost")[at].alias("lost_at"), F.col("taken")[at].alias("taken_at"), seconds.alias("seconds"))


def rate(events: Column, seconds: Column) -> Column:
    """Events a second, rounded to two places; a span of 0 counts as a second."""
    return F.round(events / F.greatest(seconds, F.lit(1)), 2)
