"""Queries of the coordination model: status, retention, fencing, audits, advice, replay."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.blocked import blocked_lead, blocked_running
from ..functions.keys import block_of, clean_name, idempotency_key, key_headers, micros, millis_between, of_run, parse_progress, run_stage_key, run_text, stable_id, time_text
from ..operators import advice, audit, leases, signals
from ..operators.replay import replay
from ..operators.resume import fold
from ..operators.runs import current_runs
from ..operators.status import at_latest, missing_locks, newest_runs, status_view, without_keys
from ..sources.stores import standing
from .logs import _blocks, _name, _run, _text, table

AS_OF = "2025-04-20 00:00:00"
HALF_DAY = 43_200_000_000
RUN_COLUMNS = ("run_id", "started_at", "finished_at", "status", "items_processed", "rec_id", "loaded_at")

#: The stages that the code of the jobs knows.
DECLARED_STAGES = ("SweepStage.SCAN", "SweepStage.PRUNE", "ExportStage.LOAD", "ExportStage.TRANSFORM", "ExportStage.PUBLISH")


def _as_of():
    return F.lit(AS_OF).cast("timestamp_ntz")


def _locks(spark: SparkSession, sf_dir: str) -> DataFrame:
    locks = table(spark, sf_dir, "job_locks")
    return locks.select("job_name", run_text("run_id").alias("run_id"), "holder", "token", "acquired_at", "expires_at", "status")


def _runs(spark: SparkSession, sf_dir: str, *more: str) -> DataFrame:
    return current_runs(table(spark, sf_dir, "job_runs"), *RUN_COLUMNS, *more).withColumn("run_id", run_text("run_id")).withColumn("items_processed", F.greatest("items_processed", F.lit(0)))


def _writes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Checkpoint writes with clean keys."""
    rows = table(spark, sf_dir, "job_checkpoints")
    clean = rows.select(
        "rec_id", clean_name("job_name").alias("job_name"), run_text("run_id").alias("run_id"), "stage_name", "status", "stored_value", "value_type", "fencing_token", "updated_at"
    )
    return clean.filter("job_name is not null and run_id is not null and stage_name is not null")


KEY = ["job_name", "run_id", "stage_name"]


def _committed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The row that stands of each checkpoint."""
    return standing(_writes(spark, sf_dir), "rec_id")


def status_overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    view = status_view(_locks(spark, sf_dir), _committed(spark, sf_dir), _runs(spark, sf_dir, "error_message"))
    view = view.join(_saves(spark, sf_dir), "job_name", "left").join(_recoveries(spark, sf_dir), "job_name", "left").na.fill(0, ["n_saves", "n_recoveries"])
    return view.select(
        "job_name", "run_id", "status", "token", "holder", time_text("expires_at").alias("expires_at"), "stage_name", "stage_status",
        time_text("stage_updated_at").alias("stage_updated_at"), "last_run_id", "last_run_status", time_text("last_run_finished_at").alias("last_run_finished_at"),
        "last_run_duration_ms", "last_run_items", "last_error", "n_saves", "n_recoveries",
    )


def _saves(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _writes(spark, sf_dir).groupBy("job_name").agg(F.count(F.lit(1)).alias("n_saves"))


def _recoveries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often a job's run went on under a new token."""
    tokens = _snapshots(spark, sf_dir).filter("run_id is not null and token is not null").groupBy("job_name", "run_id", "token").agg(F.count(F.lit(1)).alias("_"))
    return tokens.groupBy("job_name", "run_id").agg((F.count(F.lit(1)) - 1).alias("n")).groupBy("job_name").agg(F.sum("n").alias("n_recoveries"))


def latest_checkpoint(spark: SparkSession, sf_dir: str) -> DataFrame:
    latest = at_latest(_committed(spark, sf_dir), ["job_name", "run_id"], "updated_at")
    return latest.select("job_name", "run_id", "stage_name", "status", time_text("updated_at").alias("updated_at"))


def latest_finished_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    last = at_latest(_runs(spark, sf_dir), ["job_name"], "finished_at", F.col("status") != "RUNNING")
    return last.select("job_name", "run_id", "status", time_text("finished_at").alias("finished_at"))


def orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _locks(spark, sf_dir).filter(leases.orphaned(_as_of(), F.col("status"), F.col("expires_at")))
    return found.select("job_name", "status", "holder", "token")


def orphans_registered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orphaned locks of jobs that are registered (ran at any time) and have no paused lock."""
    jobs = table(spark, sf_dir, "job_runs").select(clean_name("job_name").alias("job_name")).filter("job_name is not null")
    paused = _locks(spark, sf_dir).filter("status = 'PAUSED'").select("job_name")
    return orphans(spark, sf_dir).join(jobs, "job_name", "left_semi").join(paused, "job_name", "left_anti")


def acquirable_locks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What an acquisition at AS_OF would do to each lock."""
    locks = _locks(spark, sf_dir)
    state = (F.col("status"), F.col("expires_at"))
    can = leases.acquirable(_as_of(), *state)
    fresh = F.lit("candidate")
    built, documented = (leases.next_run_id(_as_of(), *state, F.col("run_id"), fresh, p) for p in ("as_built", "as_documented"))
    token = F.when(can, F.col("token") + 1).otherwise(F.col("token"))
    renews = leases.renewable(_as_of(), *state, F.col("token"), F.col("token"))
    releases = leases.releasable(F.col("status"), F.col("token"), F.col("token"))
    return locks.select(
        "job_name", can.alias("acquirable"), token.alias("token_after"), F.when(can, built).alias("run_as_built"), F.when(can, documented).alias("run_as_documented"),
        renews.alias("renewable"), releases.alias("releasable"),
    )


def active_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jobs that ran and aren't suspended (paused)."""
    jobs = table(spark, sf_dir, "job_runs").select(clean_name("job_name").alias("job_name")).filter("job_name is not null").distinct()
    suspended = _locks(spark, sf_dir).filter("status = 'PAUSED'").select("job_name")
    return jobs.join(suspended, "job_name", "left_anti")


def recent_activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs started in the two hours before AS_OF."""
    runs = _runs(spark, sf_dir)
    near = (F.col("started_at") > _as_of() - F.expr("interval 2 hours")) & (F.col("started_at") <= _as_of())
    return runs.filter(near).select("job_name", "run_id", time_text("started_at").alias("started_at"))


def stale_stages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored stages that the code doesn't know any more."""
    declared = spark.createDataFrame([(s,) for s in DECLARED_STAGES], "stage_name string")
    return stage_names(spark, sf_dir).join(F.broadcast(declared), "stage_name", "left_anti").select("job_name", "stage_name")


def stage_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _writes(spark, sf_dir).select("job_name", "stage_name").distinct()


def seed_missing_locks(spark: SparkSession, sf_dir: str) -> DataFrame:
    jobs = table(spark, sf_dir, "job_runs").select(clean_name("job_name").alias("job_name")).filter("job_name is not null")
    return missing_locks(jobs, _locks(spark, sf_dir))


def retention_keep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return newest_runs(_runs(spark, sf_dir), 20).filter("kept").select("job_name", "run_id", "rank")


def retention_purge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The runs that are deleted: all but those kept."""
    runs = _runs(spark, sf_dir).select("job_name", "run_id")
    return without_keys(runs, retention_keep(spark, sf_dir), ["job_name", "run_id"])


def purged_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Current runs that the log of deletions leaves: neither the run nor its whole job was deleted."""
    purges = table(spark, sf_dir, "run_purges").select(clean_name("job_name").alias("job_name"), run_text("run_id").alias("run_id"))
    left = without_keys(_runs(spark, sf_dir).select("job_name", "run_id"), purges.filter("run_id is not null"), ["job_name", "run_id"])
    return without_keys(left, purges.filter("run_id is null"), ["job_name"])


def split_brain_victims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users charged by one actor within ten minutes of another."""
    found = audit.rival_effects(table(spark, sf_dir, "events"), "user_id", "event_type", "ts", 600, _blocks(spark, sf_dir, "events"))
    return found.agg(F.countDistinct("user_id").alias("victims"), F.count(F.lit(1)).alias("rival_events"))


def out_of_order_writes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = audit.out_of_order(_writes(spark, sf_dir), "job_name", "updated_at", "rec_id", "fencing_token", _blocks(spark, sf_dir, "job_checkpoints"))
    return found.select("job_name", "rec_id", "fencing_token", "run_max")


def cumulative_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = audit.out_of_order(_writes(spark, sf_dir), "job_name", "updated_at", "rec_id", "fencing_token", _blocks(spark, sf_dir, "job_checkpoints"))
    return audit.running_count(found, "job_name", "updated_at", "rec_id", _blocks(spark, sf_dir, "job_checkpoints")).select("job_name", "rec_id", F.col("n_so_far").cast("long").alias("n_so_far"))


def norm_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where in its job's time each failed or stolen run started."""
    runs = _runs(spark, sf_dir).filter("started_at is not null")
    placed = audit.normalised(runs, "job_name", "started_at")
    return placed.filter("status in ('FAILED', 'STOLEN')").select("job_name", "run_id", "status", F.round("position", 6).alias("position"))


def has_checkpoint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each run resumes: any checkpoint of it exists."""
    n = _writes(spark, sf_dir).groupBy("job_name", "run_id").agg(F.count(F.lit(1)).alias("n"))
    runs = _runs(spark, sf_dir).select("job_name", "run_id")
    return runs.join(n, ["job_name", "run_id"], "left").select("job_name", "run_id", (F.coalesce("n", F.lit(0)) > 0).alias("is_resume"))


def stage_complete(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _committed(spark, sf_dir).filter("status = 'COMPLETE'").select(*KEY)


def checkpoint_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The checkpoints of the current run of the busiest job, by key."""
    lock = _locks(spark, sf_dir).orderBy(F.desc("token"), "job_name").limit(1).select("job_name", "run_id")
    return _committed(spark, sf_dir).join(F.broadcast(lock), ["job_name", "run_id"], "left_semi").select(*KEY, "status", "fencing_token")  # lock: one row


def lifecycle_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = _runs(spark, sf_dir)
    return runs.groupBy("job_name", F.col("status").alias("result")).agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("items_processed"), F.lit(0)).alias("items"))


def _durations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _runs(spark, sf_dir).withColumn("duration_ms", millis_between("started_at", "finished_at")).filter("status = 'SUCCESS' and duration_ms >= 0")


def success_durations(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _durations(spark, sf_dir)
    return d.groupBy("job_name").agg(F.count(F.lit(1)).alias("n"), F.sum("duration_ms").alias("total_ms"), F.max("duration_ms").alias("max_ms"))


_RUN_ORDER = ["finished_at", "rec_id"]


def peak_last10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return advice.peak_of_recent(_durations(spark, sf_dir), *_RUN_ORDER, "duration_ms", block_days=_blocks(spark, sf_dir, "job_runs")).select("job_name", "run_id", "duration_ms", "peak")


def ttl_advice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For a lease of two hours: the first run of each job at which a longer one is advised."""
    order = [F.col(c) for c in _RUN_ORDER]
    peaks = advice.peak_of_recent(_durations(spark, sf_dir), *_RUN_ORDER, "duration_ms", block_days=_blocks(spark, sf_dir, "job_runs"))
    return advice.lease_advice(peaks, order, F.lit(7200)).select("job_name", "run_id", "peak", "recommended_ttl_s")


def heartbeat_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = _locks(spark, sf_dir).filter("status = 'HELD'")
    return advice.heartbeat_interval(held.select(millis_between("acquired_at", "expires_at").alias("ttl_ms")))


def throughput(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs and successful runs a day of each job, over the time from its first start to its last."""
    runs = _runs(spark, sf_dir).filter("started_at is not null")
    good = F.count(F.when(F.col("status") == "SUCCESS", 1))
    per = runs.groupBy("job_name").agg(F.count(F.lit(1)).alias("n"), good.alias("good"), F.min("started_at").alias("a"), F.max("started_at").alias("b"))
    days = F.greatest(F.floor((micros("b") - micros("a")) / F.lit(86_400_000_000)), F.lit(1))
    return per.select("job_name", audit.rate(F.col("n"), days).alias("runs_a_day"), audit.rate(F.col("good"), days).alias("valid_runs_a_day"))


def write_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Checkpoint writes a day of each job, and those that don't break the order of tokens."""
    writes = _writes(spark, sf_dir).filter("updated_at is not null")
    found = audit.guarded(writes, "job_name", "updated_at", "rec_id", "fencing_token", _blocks(spark, sf_dir, "job_checkpoints"))
    good = F.count(F.when(F.col("accepted") | F.col("fencing_token").isNull(), 1))
    per = found.groupBy("job_name").agg(F.count(F.lit(1)).alias("n"), good.alias("good"), F.min("updated_at").alias("a"), F.max("updated_at").alias("b"))
    days = F.greatest(F.floor((micros("b") - micros("a")) / F.lit(86_400_000_000)), F.lit(1))
    return per.select("job_name", audit.rate(F.col("n"), days).alias("writes_a_day"), audit.rate(F.col("good"), days).alias("valid_writes_a_day"))


def _ledgers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per job the token that the last write left without a guard, the one that a guarded ledger has, and the highest there was."""
    return audit.ledgers(_writes(spark, sf_dir), "job_name", "updated_at", "rec_id", "fencing_token", _blocks(spark, sf_dir, "job_checkpoints"))


def corruption_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of jobs whose checkpoints are overwritten in order of time, those that end below their highest token, without and with a guard."""
    bad = lambda c: F.round(F.avg((F.col(c) != F.col("expected")).cast("int")), 6)
    return _ledgers(spark, sf_dir).agg(bad("final").alias("unguarded"), bad("guarded_final").alias("guarded"), F.count(F.lit(1)).alias("n_jobs"))


def latency_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How long after a run's end its row was loaded."""
    late = _runs(spark, sf_dir).withColumn("ms", millis_between("finished_at", "loaded_at")).filter("ms is not null")
    return late.groupBy("status").agg(F.min("ms").alias("min_ms"), F.max("ms").alias("max_ms"), F.expr("sum(ms) div count(ms)").alias("avg_ms"))


def _snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lock_snapshots")
    return rows.select(
        clean_name("job_name").alias("job_name"), "snap_at", "rec_id", clean_name("holder").alias("holder"), "token", run_text("run_id").alias("run_id"), F.upper(clean_name("status")).alias("status")
    ).filter("job_name is not null and snap_at is not null")


def mttr(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From a job's first holder seen to the first other one."""
    found = audit.takeover(_snapshots(spark, sf_dir), "job_name", "holder", "snap_at", "rec_id")
    return found.select("job_name", time_text("lost_at").alias("lost_at"), time_text("taken_at").alias("taken_at"), "seconds")


def recovery_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What changed between a job's first and last snapshot, and whether its stored progress never went back nor was made twice."""
    row = F.struct("snap_at", "rec_id", "holder", "token", "run_id")
    ends = _snapshots(spark, sf_dir).groupBy("job_name").agg(F.min(row).alias("a"), F.max(row).alias("b"))
    saved = _writes(spark, sf_dir).select("rec_id", *KEY, "updated_at", parse_progress("stored_value")["lastId"].alias("last_id"))
    found = audit.progress_findings(saved, "job_name", ["run_id", "stage_name"], "last_id", "updated_at", "rec_id", _blocks(spark, sf_dir, "job_checkpoints"))
    return ends.join(found, "job_name", "left").na.fill(0, ["resets", "repeats"]).select(
        "job_name",
        (F.col("resets") == 0).alias("progress_kept"),
        (F.col("repeats") == 0).alias("no_duplicates"),
        (~F.col("a.holder").eqNullSafe(F.col("b.holder"))).alias("holder_changed"),
        (F.col("b.token") > F.col("a.token")).alias("token_grew"),
        F.col("a.run_id").eqNullSafe(F.col("b.run_id")).alias("same_run"),
    )


def history_integrity(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs, n = _runs(spark, sf_dir), lambda c: F.count(F.when(F.expr(c), 1))
    return runs.agg(
        n("status <> 'RUNNING' and finished_at is null").alias("finished_without_time"),
        n("status = 'RUNNING' and finished_at is not null").alias("running_with_time"),
        n("finished_at < started_at").alias("ends_before_start"),
        n("status = 'SUCCESS'").alias("successes"),
        F.sum(F.expr("case when status = 'SUCCESS' then items_processed else 0 end")).alias("items_of_successes"),
    )


def latest_activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    last = table(spark, sf_dir, "job_runs").filter("finished_at is not null").orderBy(F.desc("finished_at"), F.desc("rec_id")).limit(1)
    return last.select("rec_id", clean_name("job_name").alias("job_name"), time_text("finished_at").alias("finished_at"))


def duplicate_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Job names that are written in more than one way."""
    names = table(spark, sf_dir, "job_runs").select(clean_name("job_name").alias("job_name"), F.col("job_name").alias("written")).filter("job_name is not null").distinct()
    return names.groupBy("job_name").agg(F.count(F.lit(1)).alias("n_forms")).filter("n_forms > 1")


def _keyed_writes(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = idempotency_key(stable_id(F.col("run_id"), F.col("fencing_token")), F.col("stage_name"))
    return _writes(spark, sf_dir).withColumn("idempotency_key", F.concat_ws("_", key, "job_name"))


def idempotency_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _keyed_writes(spark, sf_dir).select("rec_id", "idempotency_key")


def idempotency_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a receiver lets through: the first write under each key."""
    first = Window.partitionBy("idempotency_key").orderBy(F.asc_nulls_last("updated_at"), "rec_id")
    return _keyed_writes(spark, sf_dir).withColumn("_n", F.row_number().over(first)).filter("_n = 1").select("rec_id", "idempotency_key")


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.lpad(F.col("doc_id").cast("string"), 12, "0").alias("item_id"), "n_chars")


CURSOR = "000000000400"
PAGE = 100


def resume_remaining(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items after a stored cursor, compared as text."""
    return _items(spark, sf_dir).filter(F.col("item_id") > F.lit(CURSOR)).select("item_id")


def page_cursor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of items in order of their ids: size and the cursor each leaves.

    Rows are numbered inside blocks of ids, and blocks by their sizes inside wider blocks, so the whole order is in no single task.
    """
    prefix = lambda n: F.substring("item_id", 1, n)
    blocked = _items(spark, sf_dir).withColumns({"_b": prefix(10), "_b8": prefix(8), "_b5": prefix(5), "_one": F.lit(1), "_all": F.lit(0)})
    ranked = blocked_running(blocked, ["_all"], "_b", [F.col("item_id")], {"rank": ("count", "_one")}, wider=("_b8", "_b5"))
    page = F.expr(f"(rank - 1) div {PAGE}").cast("long")
    return ranked.groupBy(page.alias("page")).agg(F.count(F.lit(1)).alias("n_items"), F.max("item_id").alias("cursor"))


def fold_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items processed so far after each run of a job: a running sum, which needs no fold."""
    runs = _runs(spark, sf_dir).filter("started_at is not null").withColumn("_b", block_of("started_at", _blocks(spark, sf_dir, "job_runs")))
    order = [F.col("started_at"), F.col("rec_id")]
    return blocked_running(runs, ["job_name"], "_b", order, {"state": ("sum", "items_processed")}).select("job_name", "run_id", F.col("state").cast("long").alias("state"))


def _chained(state: int, items: int) -> int:
    """A step whose result depends on the order of all steps before."""
    return (state * 31 + items) % 1_000_003


def _folded(spark: SparkSession, sf_dir: str, when: str, stored: DataFrame | None = None) -> DataFrame:
    runs = _runs(spark, sf_dir).filter("started_at is not null").withColumn("items", F.coalesce("items_processed", F.lit(0))).filter(when)
    return fold(runs, ["job_name"], ["started_at", "rec_id"], "items", 7, _chained, stored=stored)


def fold_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The end of a fold over each job's runs that depends on their order."""
    return _folded(spark, sf_dir, "true")


def fold_resume(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same fold stopped at AS_OF and gone on from the stored state."""
    stored = _folded(spark, sf_dir, f"started_at <= timestamp_ntz'{AS_OF}'")
    return _folded(spark, sf_dir, f"started_at > timestamp_ntz'{AS_OF}'", stored)


def json_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cursor and state in stored progress documents; broken documents give null."""
    rows = table(spark, sf_dir, "job_checkpoints").filter("stored_value is not null")
    parsed = rows.select("rec_id", parse_progress("stored_value").alias("p"))
    return parsed.select("rec_id", F.col("p.lastId").alias("last_id"), F.col("p.state").alias("state"), F.col("p.stateType").alias("state_type"))


def _commands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event log read as commands: one lock a user, three pods, a lease of half a day, every fourth token stale."""
    op = F.expr("case event_type when 'click' then 'ACQUIRE' when 'view' then 'RENEW' when 'purchase' then 'RELEASE' when 'signup' then 'SAVE' else 'NOOP' end")
    events = table(spark, sf_dir, "events")
    return events.select(
        F.col("user_id").cast("string").alias("job"), F.col("event_id").alias("seq"), micros("ts").alias("at"), op.alias("op"), F.concat(F.lit("pod-"), F.col("event_id") % 3).alias("pod"),
        F.lit(HALF_DAY).alias("ttl"), F.lit(None).cast("long").alias("token"), (F.col("event_id") % 4 == 0).cast("int").alias("stale"),
        F.concat(F.lit("run-"), F.col("event_id")).alias("candidate"),
    )


def _replayed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replay(_commands(spark, sf_dir))


def lease_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _replayed(spark, sf_dir).select("job", "seq", "op", "ok", "status", "token", "holder", "run_id", "expires_at")


def token_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """When each token was given out, and to whom."""
    return _replayed(spark, sf_dir).filter("op = 'ACQUIRE' and ok").select("job", "token", "holder", "run_id", "at")


def fenced_writes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Checkpoint writes against the token their job's lock had then: accepted only if it is the same."""
    timeline = _snapshots(spark, sf_dir).groupBy("job_name", F.col("snap_at").alias("updated_at")).agg(F.max_by("token", "rec_id").alias("token"))
    then = audit.known_at(_writes(spark, sf_dir).select("rec_id", "job_name", "fencing_token", "updated_at"), timeline, "job_name", "updated_at", "token", _blocks(spark, sf_dir, "job_checkpoints"))
    return then.select("rec_id", "token_then", F.coalesce(F.col("token_then") == F.col("fencing_token"), F.lit(False)).alias("accepted"))


def committed_checkpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _committed(spark, sf_dir).select(*KEY, "rec_id", "fencing_token", "status")


def run_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How each acquisition ended: released by its token, lost to the next, or still open."""
    moves = _replayed(spark, sf_dir).filter("ok and (op = 'ACQUIRE' or op = 'RELEASE')")
    length = int(_blocks(spark, sf_dir, "events") * 86_400_000_000)
    blocked = moves.withColumn("_b", F.floor(F.col("at") / F.lit(length)))
    ends = blocked_lead(blocked, ["job"], "_b", [F.col("at"), F.col("seq")], {"next_op": "op"}).filter("op = 'ACQUIRE'")
    outcome = F.when(F.col("next_op") == "RELEASE", "SUCCESS").when(F.col("next_op") == "ACQUIRE", "STOLEN").otherwise("RUNNING")
    return ends.select("job", "token", "run_id", outcome.alias("outcome"))


def self_fence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Renewals after a pause of a lease or more."""
    renewals = table(spark, sf_dir, "events").filter("event_type = 'view'")
    return advice.self_fenced(renewals, "user_id", "ts", "event_id", HALF_DAY // 1000, _blocks(spark, sf_dir, "events")).select("user_id", "event_id", "gap_ms")


def invariants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often what must never be is in the replayed log, one row a rule."""
    return audit.invariant_breaks(_replayed(spark, sf_dir))


def heartbeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Renewals under each token, and when it was found lost."""
    return signals.heartbeats(_replayed(spark, sf_dir))


def stop_commands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What an orderly stop sends: a release of every lock held."""
    return signals.stop_commands(_locks(spark, sf_dir))


def recovery_commands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the orphan scan at AS_OF starts again."""
    jobs = table(spark, sf_dir, "job_runs").select(clean_name("job_name").alias("job_name")).filter("job_name is not null")
    suspended = _locks(spark, sf_dir).filter("status = 'PAUSED'")
    return signals.recovery_commands(orphans(spark, sf_dir), jobs, suspended)


def start_delays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How late each run started for a job that pauses an hour between runs."""
    runs = _runs(spark, sf_dir).filter("started_at is not null and finished_at is not null")
    return signals.start_delays(runs, "rec_id", 3_600_000, _blocks(spark, sf_dir, "job_runs")).select("job_name", "run_id", "late_ms")


def fixed_rate_ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly ticks of each registered job in the six hours before AS_OF, counted by job."""
    jobs = _locks(spark, sf_dir).select("job_name", (_as_of() - F.expr("interval 6 hours")).alias("first_at"), _as_of().alias("last_at"), F.lit(3_600_000).alias("rate_ms"))
    return signals.fixed_rate_ticks(jobs).select("job_name", time_text("tick_at").alias("tick_at"))


def charge_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events and users of each kind."""
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("user_id").alias("users"))


def ledger_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per job what the last write leaves without and with a guard, what the highest token leaves, and whether the job had a fault."""
    faulty = _runs(spark, sf_dir).filter("status in ('FAILED', 'STOLEN')").groupBy("job_name").agg(F.count(F.lit(1)).alias("n_faults"))
    return _ledgers(spark, sf_dir).join(faulty, "job_name", "left").select(
        "job_name", "expected", "final", "guarded_final", (F.col("final") != F.col("expected")).alias("corrupted"), F.coalesce("n_faults", F.lit(0)).alias("n_faults")
    )


def fault_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults (failed and stolen runs) and violations (writes out of order) of each job in order of time, each kind counted so far."""
    runs = _runs(spark, sf_dir).filter("status in ('FAILED', 'STOLEN') and started_at is not null")
    found = audit.out_of_order(_writes(spark, sf_dir), "job_name", "updated_at", "rec_id", "fencing_token", _blocks(spark, sf_dir, "job_checkpoints"))
    event = lambda df, kind, at: df.select("job_name", F.lit(kind).alias("kind"), "rec_id", F.col(at).alias("at"))
    both = event(runs, "fault", "started_at").unionByName(event(found, "violation", "updated_at"))
    blocked = both.withColumns({"_b": block_of("at", _blocks(spark, sf_dir, "job_runs")), "_one": F.lit(1)})
    counted = blocked_running(blocked, ["job_name", "kind"], "_b", [F.col("at"), F.col("rec_id")], {"n_so_far": ("count", "_one")})
    return counted.select("job_name", "kind", "rec_id", time_text("at").alias("at"), F.col("n_so_far").cast("long").alias("n_so_far"))


def event_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counters of each job by event and result: runs, items, checkpoints saved, acquisitions and recoveries."""
    runs = _runs(spark, sf_dir)
    row = lambda df, event, result, n: df.select("job_name", F.lit(event).alias("event"), result.alias("result"), n.cast("long").alias("n"))
    ends = row(runs.groupBy("job_name", "status").agg(F.count(F.lit(1)).alias("n")), "execution", F.lower("status"), F.col("n"))
    items = row(runs.groupBy("job_name").agg(F.coalesce(F.sum("items_processed"), F.lit(0)).alias("n")), "items", F.lit("processed"), F.col("n"))
    saves = row(_saves(spark, sf_dir), "saves", F.lit("saved"), F.col("n_saves"))
    taken = _snapshots(spark, sf_dir).filter("token is not null").groupBy("job_name").agg(F.countDistinct("token").alias("n"))
    taken = row(taken, "acquisition", F.lit("acquired"), F.col("n"))
    recovered = row(_recoveries(spark, sf_dir), "recovery", F.lit("recovered"), F.col("n_recoveries"))
    return ends.unionByName(items).unionByName(saves).unionByName(taken).unionByName(recovered)


def whole_second_leases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lease of each lock, and what a store with whole seconds keeps of it."""
    ttl = millis_between("acquired_at", "expires_at")
    return _locks(spark, sf_dir).select("job_name", ttl.alias("ttl_ms"), leases.whole_seconds(ttl).cast("long").alias("kept_ms"))


def stages_of_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The checkpoints of each lock's current run, by the prefix of their sort key."""
    keyed = _committed(spark, sf_dir).withColumn("sort_key", run_stage_key("run_id", "stage_name"))
    run = _locks(spark, sf_dir).select("job_name", F.col("run_id").alias("current"))
    return keyed.join(run, "job_name").filter(of_run("sort_key", "current")).select("job_name", "sort_key")


def cleared_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The checkpoints left when those of every removed job are cleared, all its runs."""
    gone = table(spark, sf_dir, "run_purges").select(clean_name("job_name").alias("job_name"), run_text("run_id").alias("run_id")).filter("run_id is null")
    return without_keys(_committed(spark, sf_dir), gone, ["job_name"]).select(*KEY)


def cleared_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The checkpoints left when every successful run clears its own, under the highest token it wrote with: if that is the lock's."""
    done = _runs(spark, sf_dir).filter("status = 'SUCCESS' and run_id is not null").select("job_name", "run_id")
    under = _writes(spark, sf_dir).groupBy("job_name", "run_id").agg(F.max("fencing_token").alias("token"))
    current = _locks(spark, sf_dir).select("job_name", "token")
    clears = under.join(done, ["job_name", "run_id"], "left_semi").join(current, ["job_name", "token"], "left_semi")
    return without_keys(_committed(spark, sf_dir), clears, ["job_name", "run_id"]).select(*KEY)


def keyed_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The headers that carry each write's key to its receiver."""
    headers = key_headers(F.col("idempotency_key"))
    return _keyed_writes(spark, sf_dir).select("rec_id", headers["Idempotency-Key"].alias("idempotency_header"), headers["X-Idempotency-Key"].alias("x_idempotency_header"))


QUERIES = {
    f.__name__: f
    for f in (
        status_overview, latest_checkpoint, latest_finished_run, orphans, orphans_registered, acquirable_locks, active_jobs, recent_activity, stale_stages, stage_names,
        seed_missing_locks, retention_keep, retention_purge, purged_history, split_brain_victims, out_of_order_writes, cumulative_violations, norm_timeline, has_checkpoint,
        stage_complete, checkpoint_lookup, lifecycle_counters, success_durations, peak_last10, ttl_advice, heartbeat_interval, throughput, corruption_rate, latency_stats, mttr,
        recovery_checks, history_integrity, latest_activity, duplicate_jobs, idempotency_keys, idempotency_dedup, resume_remaining, page_cursor, fold_sum, fold_resume,
        json_progress, heartbeats, stop_commands, recovery_commands, start_delays, fixed_rate_ticks, charge_counts, ledger_rounds, keyed_headers, lease_replay, token_timeline, fenced_writes, committed_checkpoints, run_outcomes, self_fence, invariants,
        write_rates, fold_chain, fault_timeline, event_counters, whole_second_leases, stages_of_run, cleared_jobs, cleared_runs,
    )
}

_AT = f"timestamp '{AS_OF}'"

_WITH = f"""with recursive lk as (select job_name, {_run('run_id')} as run_id, holder, token, acquired_at, expires_at, status from job_locks),
nm as (select {_name('job_name')} as job_name, {_run('run_id')} as run_id, started_at, finished_at, status, greatest(items_processed, 0) as items_processed, rec_id, loaded_at, error_message from job_runs),
rn as (
  select * from nm where job_name is not null
  qualify row_number() over (partition by job_name, run_id order by (finished_at is not null) desc, loaded_at desc nulls last, rec_id desc) = 1
),
wr as (
  select rec_id, {_name('job_name')} as job_name, {_run('run_id')} as run_id, stage_name, status, stored_value, value_type, fencing_token, updated_at from job_checkpoints
  where {_name('job_name')} is not null and {_run('run_id')} is not null and stage_name is not null
),
cm as (
  select * from wr qualify row_number() over (partition by job_name, run_id, stage_name order by fencing_token desc nulls last, updated_at desc nulls last, rec_id desc) = 1
),
pg as (select {_name('job_name')} as job_name, {_run('run_id')} as run_id from run_purges),
sn as (
  select {_name('job_name')} as job_name, snap_at, rec_id, {_name('holder')} as holder, token, {_run('run_id')} as run_id from lock_snapshots
  where {_name('job_name')} is not null and snap_at is not null
),
lf as (select job_name, max(finished_at) as finished_at from rn where status <> 'RUNNING' group by 1),
lc as (select job_name, run_id, max(updated_at) as updated_at from cm group by 1, 2),
ok as (select *, date_diff('millisecond', started_at, finished_at) as duration_ms from rn where status = 'SUCCESS'),
du as (select * replace ((epoch_us(finished_at) - epoch_us(started_at)) // 1000 as duration_ms) from ok where finished_at >= started_at),
vio as (
  select * from (
    select *, max(fencing_token) over (partition by job_name order by updated_at, rec_id rows between unbounded preceding and 1 preceding) as run_max from wr where updated_at is not null
  ) where fencing_token < run_max
),
led as (select job_name, arg_max(fencing_token, (updated_at, rec_id)) as final, arg_max(fencing_token, (updated_at, rec_id)) filter (taken) as guarded_final, max(fencing_token) as expected from (
  select *, fencing_token >= coalesce(max(fencing_token) over (partition by job_name order by updated_at, rec_id rows between unbounded preceding and 1 preceding), fencing_token) as taken
  from wr where fencing_token is not null and updated_at is not null) group by 1),
sv as (select job_name, count(*) as n from wr group by 1),
rc as (select job_name, sum(c - 1)::bigint as n from (select job_name, run_id, count(distinct token) as c from sn where run_id is not null and token is not null group by 1, 2) group by 1),
pk as (select *, max(duration_ms) over (partition by job_name order by finished_at, rec_id rows between 9 preceding and current row) as peak from du),
"""

_ITEM = "lpad(doc_id::varchar, 12, '0')"

_REPLAY = f"""cmd as (
  select user_id::varchar as job, event_id as seq, epoch_us(ts) as "at", 'pod-' || (event_id % 3) as pod, (event_id % 4 = 0)::int as stale, 'run-' || event_id as cand,
    case event_type when 'click' then 'ACQUIRE' when 'view' then 'RENEW' when 'purchase' then 'RELEASE' when 'signup' then 'SAVE' else 'NOOP' end as op,
    row_number() over (partition by user_id order by ts, event_id) as n
  from events
),
st as (
  select distinct job, 0::bigint as n, null::bigint as seq, null::bigint as "at", null::varchar as op, true as ok, 0::bigint as given, 0::bigint as token_before, null::varchar as status_before, null::bigint as expires_before,
    'FREE' as status, 0::bigint as token, 'init' as holder, 'run-0' as run_id, 0::bigint as expires_at
  from cmd
  union all
  select job, n, seq, "at", op, ok, token_was - stale, token_was, status, expires_at,
    case when ok and op = 'ACQUIRE' then 'HELD' when ok and op = 'RELEASE' then 'FREE' else status end,
    case when ok and op = 'ACQUIRE' then token_was + 1 else token_was end,
    case when ok and op = 'ACQUIRE' then pod else holder end,
    case when ok and op = 'ACQUIRE' and status = 'FREE' and expires_at >= "at" then cand else run_id end,
    case when ok and op in ('ACQUIRE', 'RENEW') then "at" + {HALF_DAY} else expires_at end
  from (
    select c.job, c.n, c.seq, c."at", c.op, c.pod, c.cand, c.stale, s.status, s.token as token_was, s.holder, s.run_id, s.expires_at,
      case c.op when 'ACQUIRE' then s.status in ('FREE', 'ORPHANED') or s.expires_at < c."at"
        when 'RENEW' then c.stale = 0 and s.status = 'HELD' and s.expires_at >= c."at"
        when 'RELEASE' then c.stale = 0 and s.status = 'HELD'
        when 'SAVE' then c.stale = 0 else true end as ok
    from st s join cmd c on c.job = s.job and c.n = s.n + 1
  )
),
rp as (select * from st where n > 0)"""

_CHAIN = """x as (select 1) select job_name,
  list_reduce(list_prepend(7::bigint, list(coalesce(items_processed, 0) order by started_at, rec_id)), lambda a, b: (a * 31 + b) % 1000003) as state
from rn where started_at is not null group by 1"""

_BODY = {
    "status_overview": f"""x as (select 1)
select lk.job_name, lk.run_id, lk.status, lk.token, lk.holder, {_text('lk.expires_at')} as expires_at, c.stage_name, c.status as stage_status, {_text('c.updated_at')} as stage_updated_at,
  r.run_id as last_run_id, r.status as last_run_status, {_text('r.finished_at')} as last_run_finished_at, (epoch_us(r.finished_at) - epoch_us(r.started_at)) // 1000 as last_run_duration_ms,
  r.items_processed as last_run_items, r.error_message as last_error, coalesce(sv.n, 0) as n_saves, coalesce(rc.n, 0) as n_recoveries
from lk left join sv on sv.job_name = lk.job_name left join rc on rc.job_name = lk.job_name left join lc on lc.job_name = lk.job_name and lc.run_id = lk.run_id
left join cm c on c.job_name = lk.job_name and c.run_id = lk.run_id and c.updated_at = lc.updated_at
left join lf on lf.job_name = lk.job_name left join rn r on r.job_name = lk.job_name and r.finished_at = lf.finished_at""",
    "latest_checkpoint": f"""x as (select 1)
select cm.job_name, cm.run_id, stage_name, status, {_text('cm.updated_at')} as updated_at from cm join lc using (job_name, run_id, updated_at)""",
    "latest_finished_run": f"""x as (select 1)
select job_name, run_id, status, {_text('finished_at')} as finished_at from rn join lf using (job_name, finished_at)""",
    "orphans": f"""x as (select 1) select job_name, status, holder, token from lk where status = 'ORPHANED' or (status = 'HELD' and expires_at < {_AT})""",
    "orphans_registered": f"""x as (select 1) select job_name, status, holder, token from lk where (status = 'ORPHANED' or (status = 'HELD' and expires_at < {_AT}))
and job_name in (select {_name('job_name')} from job_runs) and status <> 'PAUSED'""",
    "acquirable_locks": f"""a as (select *, status <> 'PAUSED' and (status in ('FREE', 'ORPHANED') or expires_at < {_AT}) as can from lk)
select job_name, can as acquirable, token + can::int as token_after, case when can then case when status = 'FREE' and expires_at >= {_AT} then 'candidate' else run_id end end as run_as_built,
  case when can then case when status = 'FREE' then 'candidate' else run_id end end as run_as_documented, status = 'HELD' and expires_at >= {_AT} as renewable, status = 'HELD' as releasable
from a""",
    "active_jobs": "x as (select 1) select distinct job_name from rn where job_name not in (select job_name from lk where status = 'PAUSED')",
    "recent_activity": f"""x as (select 1) select job_name, run_id, {_text('started_at')} as started_at from rn where started_at > {_AT} - interval 2 hours and started_at <= {_AT}""",
    "stale_stages": f"""x as (select 1) select distinct job_name, stage_name from wr where stage_name not in ({', '.join(f"'{s}'" for s in DECLARED_STAGES)})""",
    "stage_names": "x as (select 1) select distinct job_name, stage_name from wr",
    "seed_missing_locks": """x as (select 1) select distinct job_name, 'init' as holder, 0::bigint as token, 'FREE' as status from nm
where job_name is not null and not exists (select 1 from lk where lk.job_name = nm.job_name)""",
    "retention_keep": """x as (select 1) select job_name, run_id, rank from
(select *, row_number() over (partition by job_name order by started_at desc nulls last, run_id desc) as rank from rn) where rank <= 20""",
    "retention_purge": """x as (select 1) select job_name, run_id from
(select *, row_number() over (partition by job_name order by started_at desc nulls last, run_id desc) as rank from rn) where rank > 20""",
    "purged_history": """x as (select 1) select job_name, run_id from rn
where not exists (select 1 from pg where pg.job_name = rn.job_name and (pg.run_id = rn.run_id or pg.run_id is null))""",
    "split_brain_victims": """x as (select 1) select count(distinct b.user_id) as victims, count(distinct b.event_id) as rival_events
from events a join events b on a.user_id = b.user_id and a.event_type <> b.event_type and b.ts > a.ts and b.ts - a.ts < interval 600 seconds""",
    "out_of_order_writes": "x as (select 1) select job_name, rec_id, fencing_token, run_max from vio",
    "cumulative_violations": "x as (select 1) select job_name, rec_id, count(*) over (partition by job_name order by updated_at, rec_id rows unbounded preceding) as n_so_far from vio",
    "norm_timeline": """p as (select *, (epoch_us(started_at) - epoch_us(min(started_at) over (partition by job_name))) /
  greatest(epoch_us(max(started_at) over (partition by job_name)) - epoch_us(min(started_at) over (partition by job_name)), 1) as pos from rn where started_at is not null)
select job_name, run_id, status, round(greatest(0, least(1, pos)), 6) as position from p where status in ('FAILED', 'STOLEN')""",
    "has_checkpoint": "w as (select distinct job_name, run_id from wr) select rn.job_name, rn.run_id, w.run_id is not null as is_resume from rn left join w using (job_name, run_id)",
    "stage_complete": "x as (select 1) select job_name, run_id, stage_name from cm where status = 'COMPLETE'",
    "checkpoint_lookup": """b as (select job_name, run_id from lk order by token desc, job_name limit 1)
select cm.job_name, cm.run_id, stage_name, status, fencing_token from cm join b using (job_name, run_id)""",
    "lifecycle_counters": "x as (select 1) select job_name, status as result, count(*) as n, coalesce(sum(items_processed), 0)::bigint as items from rn group by 1, 2",
    "success_durations": "x as (select 1) select job_name, count(*) as n, sum(duration_ms)::bigint as total_ms, max(duration_ms) as max_ms from du group by 1",
    "peak_last10": "x as (select 1) select job_name, run_id, duration_ms, peak from pk",
    "ttl_advice": """x as (select 1) select job_name, run_id, peak, peak * 2 // 1000 + 1 as recommended_ttl_s from pk where peak > 7200 * 500
qualify row_number() over (partition by job_name order by finished_at, rec_id) = 1""",
    "heartbeat_interval": """x as (select 1) select greatest(1000, coalesce(min(((epoch_us(expires_at) - epoch_us(acquired_at)) // 1000) // 3), 10000))::bigint as interval_ms from lk where status = 'HELD'""",
    "throughput": """p as (select job_name, count(*) as n, count(*) filter (status = 'SUCCESS') as good,
  greatest((epoch_us(max(started_at)) - epoch_us(min(started_at))) // 86400000000, 1) as days from rn where started_at is not null group by 1)
select job_name, round(n / days, 2) as runs_a_day, round(good / days, 2) as valid_runs_a_day from p""",
    "corruption_rate": """x as (select 1)
select round(avg((final <> expected)::int), 6) as unguarded, round(avg((guarded_final <> expected)::int), 6) as guarded, count(*) as n_jobs from led""",
    "latency_stats": """m as (select status, (epoch_us(loaded_at) - epoch_us(finished_at)) as us from rn where loaded_at is not null and finished_at is not null),
n as (select status, (us - us % 1000) // 1000 as ms from m)
select status, min(ms) as min_ms, max(ms) as max_ms, (sum(ms) // count(*))::bigint as avg_ms from n group by 1""",
    "mttr": f"""f as (select job_name, holder, min((snap_at, rec_id)) as f from sn where holder is not null group by 1, 2),
o as (select *, row_number() over (partition by job_name order by f) as k from f)
select a.job_name, {_text('a.f[1]')} as lost_at, {_text('b.f[1]')} as taken_at, round((epoch_us(b.f[1]) - epoch_us(a.f[1])) / 1e6)::bigint as seconds
from o a join o b on b.job_name = a.job_name and b.k = 2 where a.k = 1""",
    "recovery_checks": """it as (select * from (select job_name, run_id, stage_name, updated_at, rec_id,
  case when json_valid(stored_value) and json_type(stored_value) = 'OBJECT' then json_extract_string(stored_value, '$.lastId') end as last_id from wr) where last_id is not null and updated_at is not null),
tp as (select *, max(last_id) over (partition by job_name, run_id, stage_name order by updated_at, rec_id rows between unbounded preceding and 1 preceding) as top from it),
f as (select job_name, count(*) filter (last_id < top) as resets, count(*) - count(distinct (run_id, stage_name, last_id)) as repeats from tp group by 1),
a as (select * from sn qualify row_number() over (partition by job_name order by snap_at, rec_id) = 1),
b as (select * from sn qualify row_number() over (partition by job_name order by snap_at desc, rec_id desc) = 1)
select a.job_name, coalesce(f.resets, 0) = 0 as progress_kept, coalesce(f.repeats, 0) = 0 as no_duplicates, a.holder is distinct from b.holder as holder_changed, b.token > a.token as token_grew, a.run_id is not distinct from b.run_id as same_run from a join b using (job_name) left join f using (job_name)""",
    "history_integrity": """x as (select 1) select count(*) filter (status <> 'RUNNING' and finished_at is null) as finished_without_time,
  count(*) filter (status = 'RUNNING' and finished_at is not null) as running_with_time, count(*) filter (finished_at < started_at) as ends_before_start,
  count(*) filter (status = 'SUCCESS') as successes, sum(case when status = 'SUCCESS' then items_processed else 0 end)::bigint as items_of_successes from rn""",
    "latest_activity": f"""x as (select 1) select rec_id, job_name, {_text('finished_at')} as finished_at from nm where finished_at is not null order by nm.finished_at desc, rec_id desc limit 1""",
    "duplicate_jobs": f"""w as (select distinct {_name('job_name')} as job, job_name as written from job_runs)
select job as job_name, count(*) as n_forms from w where job is not null group by 1 having count(*) > 1""",
    "idempotency_keys": "x as (select 1) select rec_id, 'fl_' || run_id || '_' || stage_name || '_' || job_name as idempotency_key from wr",
    "idempotency_dedup": """k as (select *, 'fl_' || run_id || '_' || stage_name || '_' || job_name as idempotency_key from wr)
select rec_id, idempotency_key from k qualify row_number() over (partition by idempotency_key order by updated_at nulls last, rec_id) = 1""",
    "resume_remaining": f"x as (select 1) select {_ITEM} as item_id from documents where {_ITEM} > '{CURSOR}'",
    "page_cursor": f"""i as (select {_ITEM} as item_id, (row_number() over (order by {_ITEM}) - 1) // {PAGE} as page from documents)
select page, count(*) as n_items, max(item_id) as cursor from i group by 1""",
    "fold_sum": """x as (select 1) select job_name, run_id, coalesce(sum(items_processed) over (partition by job_name order by started_at, rec_id rows unbounded preceding), 0)::bigint as state
from rn where started_at is not null""",
    "fold_chain": _CHAIN,
    "fold_resume": _CHAIN,
    "json_progress": """v as (select rec_id, case when json_valid(stored_value) and json_type(stored_value) = 'OBJECT' then stored_value end as j from job_checkpoints where stored_value is not null)
select rec_id, json_extract_string(j, '$.lastId') as last_id, json_extract_string(j, '$.state') as state, json_extract_string(j, '$.stateType') as state_type from v""",
    "lease_replay": f"{_REPLAY} select job, seq, op, ok, status, token, holder, run_id, expires_at from rp",
    "token_timeline": f"""{_REPLAY} select job, token, holder, run_id, "at" from rp where op = 'ACQUIRE' and ok""",
    "fenced_writes": """t as (select job_name, snap_at, arg_max(token, rec_id) as token from sn group by 1, 2)
select w.rec_id, t.token as token_then, coalesce(t.token = w.fencing_token, false) as accepted
from wr w asof left join t on t.job_name = w.job_name and t.snap_at <= w.updated_at where w.updated_at is not null""",
    "committed_checkpoints": "x as (select 1) select job_name, run_id, stage_name, rec_id, fencing_token, status from cm",
    "run_outcomes": f"""{_REPLAY}, mv as (select *, lead(op) over (partition by job order by "at", seq) as next_op from rp where ok and op in ('ACQUIRE', 'RELEASE'))
select job, token, run_id, case next_op when 'RELEASE' then 'SUCCESS' when 'ACQUIRE' then 'STOLEN' else 'RUNNING' end as outcome from mv where op = 'ACQUIRE'""",
    "self_fence": f"""g as (select user_id, event_id, (epoch_us(ts) - epoch_us(lag(ts) over (partition by user_id order by ts, event_id))) // 1000 as gap_ms from events where event_type = 'view')
select user_id, event_id, gap_ms from g where gap_ms >= {HALF_DAY // 1000}""",
    "invariants": f"""{_REPLAY}, h as (select job, token, count(distinct holder) as h from rp where op = 'ACQUIRE' and ok group by 1, 2)
select 'token_falls' as rule, count(*) filter (token < token_before) as n from rp union all select 'two_holders', count(*) filter (h > 1) from h
union all select 'zombie_writes', count(*) filter (op = 'SAVE' and ok and given <> token_before) from rp
union all select 'stolen_unmarked', count(*) filter (op = 'RELEASE' and ok and given <> token_before) from rp
union all select 'double_holding', count(*) filter (op = 'ACQUIRE' and ok and status_before = 'HELD' and expires_before >= "at") from rp
union all select 'revived_leases', count(*) filter (op = 'RENEW' and ok and expires_before < "at") from rp""",
}

_BODY |= {
    "heartbeats": f"""{_REPLAY} select job, given as token, count(*) filter (ok) as renewed, count(*) filter (not ok) as refused, max("at") filter (ok) as last_renewed_at,
  min("at") filter (not ok) as lost_at from rp where op = 'RENEW' group by 1, 2""",
    "stop_commands": "x as (select 1) select job_name as job, 'RELEASE' as op, token from lk where status = 'HELD'",
    "recovery_commands": f"""x as (select 1) select job_name as job, 'ACQUIRE' as op from lk where (status = 'ORPHANED' or (status = 'HELD' and expires_at < {_AT}))
and job_name in (select job_name from nm where job_name is not null) and status <> 'PAUSED'""",
    "start_delays": """s as (select job_name, run_id, epoch_us(started_at) - epoch_us(lag(finished_at) over (partition by job_name order by started_at, rec_id)) - 3600000000 as us
  from rn where started_at is not null and finished_at is not null)
select job_name, run_id, floor(us / 1000)::bigint as late_ms from s""",
    "fixed_rate_ticks": f"""t as (select job_name, unnest(generate_series({_AT} - interval 6 hours, {_AT}, interval 1 hour)) as tick_at from lk)
select job_name, {_text('tick_at')} as tick_at from t""",
    "charge_counts": "x as (select 1) select event_type, count(*) as n, count(distinct user_id) as users from events group by 1",
    "ledger_rounds": """fl as (select job_name, count(*) as n from rn where status in ('FAILED', 'STOLEN') group by 1)
select led.job_name, expected, final, guarded_final, final <> expected as corrupted, coalesce(fl.n, 0) as n_faults from led left join fl using (job_name)""",
    "write_rates": """p as (select job_name, count(*) as n, count(*) filter (fencing_token is null or low) as good, greatest((epoch_us(max(updated_at)) - epoch_us(min(updated_at))) // 86400000000, 1) as days from (
  select *, fencing_token >= coalesce(max(fencing_token) over (partition by job_name order by updated_at, rec_id rows between unbounded preceding and 1 preceding), fencing_token) as low
  from wr where updated_at is not null) group by 1)
select job_name, round(n / days, 2) as writes_a_day, round(good / days, 2) as valid_writes_a_day from p""",
    "fault_timeline": f"""e as (select job_name, 'fault' as kind, rec_id, started_at as t from rn where status in ('FAILED', 'STOLEN') and started_at is not null
  union all select job_name, 'violation', rec_id, updated_at from vio)
select job_name, kind, rec_id, {_text('t')} as "at", count(*) over (partition by job_name, kind order by t, rec_id rows unbounded preceding) as n_so_far from e""",
    "event_counters": """x as (select 1) select job_name, 'execution' as event, lower(status) as result, count(*) as n from rn group by 1, 3
union all select job_name, 'items', 'processed', coalesce(sum(items_processed), 0)::bigint from rn group by 1
union all select job_name, 'saves', 'saved', n from sv
union all select job_name, 'acquisition', 'acquired', count(distinct token) from sn where token is not null group by 1
union all select job_name, 'recovery', 'recovered', n from rc""",
    "whole_second_leases": """x as (select 1) select job_name, (epoch_us(expires_at) - epoch_us(acquired_at)) // 1000 as ttl_ms,
  floor((epoch_us(expires_at) - epoch_us(acquired_at)) / 1000000)::bigint * 1000 as kept_ms from lk""",
    "stages_of_run": "x as (select 1) select cm.job_name, cm.run_id || '#' || stage_name as sort_key from cm join lk using (job_name, run_id)",
    "cleared_jobs": "x as (select 1) select job_name, run_id, stage_name from cm where job_name not in (select job_name from pg where run_id is null and job_name is not null)",
    "cleared_runs": """u as (select job_name, run_id, max(fencing_token) as token from wr group by 1, 2),
c as (select u.* from u join lk on lk.job_name = u.job_name and lk.token = u.token join rn on rn.job_name = u.job_name and rn.run_id = u.run_id where rn.status = 'SUCCESS')
select job_name, run_id, stage_name from cm where not exists (select 1 from c where c.job_name = cm.job_name and c.run_id = cm.run_id)""",
    "keyed_headers": "k as (select rec_id, 'fl_' || run_id || '_' || stage_name || '_' || job_name as key from wr) select rec_id, key as idempotency_header, key as x_idempotency_header from k",
}

SQL = {name: _WITH + body for name, body in _BODY.items()}
