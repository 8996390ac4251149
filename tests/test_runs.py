from datetime import datetime

from fenceline.operators.runs import current_runs

SCHEMA = "rec_id long, job_name string, run_id string, finished_at timestamp_ntz, loaded_at timestamp_ntz, v long"
T = [datetime(2025, 1, d) for d in range(1, 9)]


def test_current_row(spark, rows):
    values = [
        (1, "A", "r", None, T[5], 1),  # no finish
        (2, "a ", "R ", T[0], T[1], 2),  # finished comes first
        (3, "\ta", "r", T[0], T[2], 3),  # later load
        (4, "a", "r", T[0], T[2], 4),  # higher rec_id
        (5, "a", None, None, None, 5),  # a run without an id
        (6, " ", "r", T[0], T[0], 6),
        (7, None, "r", T[0], T[0], 7),
        (8, "b", "q", None, None, 8),
        (8, "b", "q", None, None, 9),  # a tie in everything but the value
    ]
    df = spark.createDataFrame(values, SCHEMA)
    assert rows(current_runs(df, "v")) == [("a", 4), ("a", 5), ("b", 9)]
    assert current_runs(df.limit(0), "v").count() == 0
    assert rows(current_runs(df.union(df), "v")) == [("a", 4), ("a", 5), ("b", 9)]


def test_extra_columns(spark, rows):
    df = spark.createDataFrame([(1, "a", "r", None, None, 1, "x", 2)], SCHEMA + ", _rank string, _run long")
    assert rows(current_runs(df, "v")) == [("a", 1)]
