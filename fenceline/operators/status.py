"""Status views of jobs, and the queries behind them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.keys import millis_between


def at_latest(df: DataFrame, key: list[str], time: str, among: Column | None = None) -> DataFrame:
    """The rows of each key at its latest time; ties all stay. among: which rows count for the latest time."""
    counted = df if among is None else df.filter(among)
    latest = counted.groupBy(*key).agg(F.max(time).alias(time))
    return df.join(latest, [*key, time])


def status_view(locks: DataFrame, checkpoints: DataFrame, runs: DataFrame) -> DataFrame:
    """Each lock with the latest checkpoint of its current run and the job's latest finished run.

    Rows tied for the latest fan out. The latest finish is taken among runs that aren't RUNNING; every run of the job that
    finished just then is shown.
    """
    stage = at_latest(checkpoints, ["job_name", "run_id"], "updated_at").select(
        "job_name", "run_id", "stage_name", F.col("status").alias("stage_status"), F.col("updated_at").alias("stage_updated_at")
    )
    last = at_latest(runs, ["job_name"], "finished_at", F.col("status") != "RUNNING").select(
        "job_name",
        F.col("run_id").alias("last_run_id"),
        F.col("status").alias("last_run_status"),
        F.col("finished_at").alias("last_run_finished_at"),
        millis_between("started_at", "finished_at").alias("last_run_duration_ms"),
        F.col("items_processed").alias("last_run_items"),
        F.col("error_message").alias("last_error"),
    )
    return locks.join(stage, ["job_name", "run_id"], "left").join(last, "job_name", "left")


def newest_runs(runs: DataFrame, keep: int) -> DataFrame:
    """runs with rank 1.. by start, newest first; ties by run id. Those above keep are what retention deletes."""
    newest = Window.partitionBy("job_name").orderBy(F.desc_nulls_last("started_at"), F.desc("run_id"))
    return runs.withColumn("rank", F.row_number().over(newest)).withColumn("kept", F.col("rank") <= keep)


def without_keys(df: DataFrame, removed: DataFrame, key: list[str]) -> DataFrame:
    """df without the rows whose key is in removed: a delete as an anti-join. A null key removes nothing."""
    return df.join(removed.select(*key), key, "left_anti")


def missing_locks(jobs: DataFrame, locks: DataFrame) -> DataFrame:
    """Seed rows for the jobs without a lock, once each."""
    new = jobs.select("job_name").distinct().join(locks, "job_name", "left_anti")
    return new.select("job_name", F.lit("init").alias("holder"), F.lit(0).cast("long").alias("token"), F.lit("FREE").alias("status"))
