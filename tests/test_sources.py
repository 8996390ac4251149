from datetime import datetime

from fenceline import schemas
from fenceline.operators import advice, audit
from fenceline.sources import files, stores
from fenceline.sources.stores import Checkpoint, ParquetLog, health, readable, run_history


def test_audit_files(spark, tmp_path, rows):
    df = spark.createDataFrame([(1, "a", 2, 1.5), (2, "b", 3, 2.5)], files.WORKLOG)
    files.write_csv(df, str(tmp_path / "csv"))
    assert rows(files.read_csv(spark, str(tmp_path / "csv"), files.WORKLOG)) == rows(df)
    files.write_json(df, str(tmp_path / "json"))
    assert rows(spark.read.schema(files.WORKLOG).json(str(tmp_path / "json"))) == rows(df)
    (tmp_path / "log").write_text("12.5 STOP own pod-1\n\nnot a line\n  13 STOP other pod-2 \n")
    assert rows(files.read_injections(spark, str(tmp_path / "log"))) == [(12.5, "STOP", "own", "pod-1"), (13.0, "STOP", "other", "pod-2")]


def test_parquet_log(spark, tmp_path, rows):
    log = ParquetLog(spark, str(tmp_path / "log"))
    log.append([Checkpoint("j", "r", "s", "IN_PROGRESS", "1", None, 5, 1_000_000), Checkpoint("j", "r", "s", "COMPLETE", "2", None, 4, 2_000_000)])
    log.append([Checkpoint("j", "r", "s", "COMPLETE", "3", None, 5, 3_000_000)])
    assert rows(log.current().select("stored_value", "fencing_token", "updated_at")) == [("3", 5, datetime(1970, 1, 1, 0, 0, 3))]


def test_run_history(spark, rows):
    events = spark.createDataFrame(
        [
            ("START", "j", "r", datetime(2025, 1, 2), None, None, None),
            ("START", "j", "r", datetime(2025, 1, 1), None, None, None),
            ("FINISH", "j", "r", datetime(2025, 1, 3), "FAILED", 3, "e"),
            ("FINISH", "j", "r", datetime(2025, 1, 4), "SUCCESS", 5, None),
            ("START", "k", "q", datetime(2025, 1, 1), None, None, None),
            ("FINISH", "z", "q", datetime(2025, 1, 1), "SUCCESS", 1, None),
        ],
        "kind string, job_name string, run_id string, at timestamp_ntz, status string, items_processed long, error_message string",
    )
    got = [(r[0], r[2], r[3], r[4], r[5]) for r in run_history(events).collect()]
    assert sorted(got) == [("j", datetime(2025, 1, 1), datetime(2025, 1, 4), "SUCCESS", 5), ("k", datetime(2025, 1, 1), None, "RUNNING", 0)]


def test_health_and_tables(spark, rows):
    good = lambda: spark.range(3)
    bad = lambda: spark.read.parquet("/no/such/path")
    assert readable(good())
    assert rows(health({"a": good, "b": bad}, spark)) == [("a", "UP"), ("b", "DOWN")]
    spark.sql("create database if not exists fl_test")
    assert schemas.create_tables(spark, "fl_test") == ["fl_test.locks", "fl_test.checkpoints", "fl_test.runs"] == schemas.create_tables(spark, "fl_test")
    assert spark.table("fl_test.runs").columns == schemas.RUNS.fieldNames()
    spark.sql("drop database fl_test cascade")
    df = spark.createDataFrame([("a", "FREE"), ("a", "LOST"), ("b", None)], "job_name string, status string")
    assert rows(schemas.key_violations(df, ("job_name",))) == [("a", 2)]
    assert rows(schemas.unknown_states(df, schemas.LOCK_STATES)) == [("a", "LOST")]


def test_rival_effects(spark, rows):
    at = lambda s: datetime(2025, 1, 1, 0, 0, s)
    df = spark.createDataFrame([(1, "c", "p", at(0)), (2, "c", "q", at(7)), (3, "c", "q", at(15)), (4, "c", "p", at(23)), (5, "d", "q", at(1)), (6, "c", "p", at(7))], "i int, e string, a string, t timestamp_ntz")
    assert rows(audit.rival_effects(df, "e", "a", "t", 8).select("i")) == [(2,)]
    assert rows(audit.rival_effects(df, "e", "a", "t", 9).select("i")) == [(2,), (3,), (4,)]


def test_peak_and_advice(spark, rows):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([("j", n, n * 1000) for n in range(1, 13)] + [("k", 1, 29000), ("l", 1, 31000)], "job_name string, n long, d long")
    order = [F.col("n")]
    df = df.selectExpr("*", "timestamp_ntz'2025-01-01' + make_dt_interval(cast(n as int)) t")
    peaks = advice.peak_of_recent(df, "t", "n", "d")
    assert peaks.filter("job_name = 'j' and n = 12").first()["peak"] == 12000
    assert rows(advice.lease_advice(peaks, order, F.lit(60)).select("job_name", "recommended_ttl_s")) == [("l", 63)]
    assert advice.heartbeat_interval(df.limit(0).selectExpr("d as ttl_ms")).first()[0] == 10000
    assert advice.heartbeat_interval(df.selectExpr("d as ttl_ms")).first()[0] == 1000


def test_no_reference_to_the_llm_part():
    from pathlib import Path

    root = Path(stores.__file__).parent.parent
    for f in root.rglob("*.py"):
        if "llm" not in f.parts:
            assert "llm" not in f.read_text().replace("fulltext", ""), f


def test_fencing_time_and_ticks(spark, rows):
    from fenceline.operators import signals

    at = lambda s: datetime(2025, 1, 1, 0, 0, s)
    beats = [("j", at(0), True), ("j", at(4), None), ("j", at(9), None), ("j", at(10), None), ("j", at(20), None), ("k", at(0), True), ("k", at(5), None), ("k", at(6), True), ("l", at(1), None)]
    df = spark.createDataFrame(beats, "e string, t timestamp_ntz, ok boolean")
    assert rows(signals.fencing_time(df, "e", "t", 10_000)) == [("j", at(0), at(4), at(10)), ("k", at(0), at(5), None)]
    jobs = spark.createDataFrame([("j", at(0), at(5), 2000), ("k", at(0), at(5), 0), ("l", at(5), at(0), 1000)], "job_name string, first_at timestamp_ntz, last_at timestamp_ntz, rate_ms long")
    assert rows(signals.fixed_rate_ticks(jobs)) == [("j", at(0)), ("j", at(2)), ("j", at(4))]


def test_block_length_follows_the_size():
    from fenceline.functions.blocked import block_days_for

    assert block_days_for(0) == block_days_for(40_000_000) == 7.0
    assert abs(block_days_for(400_000_000) - 0.7) < 1e-9
