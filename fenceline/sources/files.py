"""Readers and writers of the audit files: CSV with a header, JSON lines, and space-separated logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Columns of the audit files.
VIOLATIONS = "seq bigint, pod string, acq_id bigint, run_max bigint, epoch double"
WORKLOG = "seq bigint, pod string, acq_id bigint, epoch double"
LEDGER = "library string, round int, faulted boolean, expected bigint, final bigint, corrupted boolean"


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.csv(path, schema=schema, header=True)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def read_injections(spark: SparkSession, path: str) -> DataFrame:
    """(epoch, action, library, pod) from lines `<epoch> STOP <library> <pod>`; other lines are left out."""
    parts = F.split(F.trim("value"), r"\s+")
    lines = spark.read.text(path).filter(F.size(parts) >= 4)
    return lines.select(F.try_to_number(parts[0], F.lit("999999999999.999")).cast("double").alias("epoch"), parts[1].alias("action"), parts[2].alias("library"), parts[3].alias("pod")).filter("epoch is not null")
