from fenceline.plans.coordination import orphans_registered


def test_orphans_of_jobs_that_ran_at_any_time_and_are_not_paused(spark, rows, tmp_path):
    locks = [("old", "ORPHANED"), ("new", "HELD"), ("held", "HELD"), ("never", "ORPHANED"), ("twice", "ORPHANED"), ("twice", "PAUSED")]
    lock = "struct(job_name, 'r' as run_id, 'pod' as holder, 1L as token, timestamp_ntz'2025-04-01' as acquired_at, if(job_name = 'held', timestamp_ntz'2025-05-01', timestamp_ntz'2025-04-02') as expires_at, status)"
    spark.createDataFrame(locks, "job_name string, status string").selectExpr(f"inline(array({lock}))").write.parquet(f"{tmp_path}/job_locks.parquet")
    runs = [(" OLD", "2024-11-01"), ("new", "2025-04-19"), ("held", "2025-04-19"), ("twice", "2025-04-19"), (None, "2025-04-19"), (" ", "2025-04-19")]
    run = spark.createDataFrame(runs, "job_name string, at string").selectExpr("job_name", "cast(at as timestamp_ntz) started_at")
    run.write.parquet(f"{tmp_path}/job_runs.parquet")
    assert rows(orphans_registered(spark, str(tmp_path)).select("job_name")) == [("new",), ("old",)]
