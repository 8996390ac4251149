"""The tables of the coordination model."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, LongType, StringType, StructField, StructType, TimestampNTZType

_TEXT, _NUMBER, _TIME = StringType(), LongType(), TimestampNTZType()


def _table(required: dict[str, DataType], optional: dict[str, DataType]) -> StructType:
    return StructType([StructField(n, t, False) for n, t in required.items()] + [StructField(n, t) for n, t in optional.items()])


LOCKS = _table({"job_name": _TEXT}, {"run_id": _TEXT, "holder": _TEXT, "token": _NUMBER, "acquired_at": _TIME, "expires_at": _TIME, "status": _TEXT})
CHECKPOINTS = _table(
    {"job_name": _TEXT, "run_id": _TEXT, "stage_name": _TEXT},
    {"status": _TEXT, "stored_value": _TEXT, "value_type": _TEXT, "fencing_token": _NUMBER, "updated_at": _TIME},
)
RUNS = _table(
    {"job_name": _TEXT, "run_id": _TEXT}, {"started_at": _TIME, "finished_at": _TIME, "status": _TEXT, "items_processed": _NUMBER, "error_message": _TEXT}
)

KEYS = {"locks": ("job_name",), "checkpoints": ("job_name", "run_id", "stage_name"), "runs": ("job_name", "run_id")}

# The states of locks, checkpoints and runs.
LOCK_STATES = ("FREE", "HELD", "ORPHANED", "PAUSED")
CHECKPOINT_STATES = ("IN_PROGRESS", "COMPLETE")
RUN_STATES = ("RUNNING", "SUCCESS", "FAILED", "STOLEN")


def create_tables(spark: SparkSession, database: str = "default") -> list[str]:
    """Create the three tables where they don't exist; returns their names."""
    made = []
    for name, schema in (("locks", LOCKS), ("checkpoints", CHECKPOINTS), ("runs", RUNS)):
        columns = ", ".join(f"{f.name} {f.dataType.simpleString()}{'' if f.nullable else ' NOT NULL'}" for f in schema)
        spark.sql(f"CREATE TABLE IF NOT EXISTS {database}.{name} ({columns}) USING parquet")
        made.append(f"{database}.{name}")
    return made


def key_violations(df: DataFrame, key: tuple[str, ...]) -> DataFrame:
    """Keys that occur more than once: what a primary key would refuse."""
    return df.groupBy(*key).agg(F.count(F.lit(1)).alias("n_rows")).filter("n_rows > 1")


def unknown_states(df: DataFrame, states: tuple[str, ...]) -> DataFrame:
    """Rows whose status is outside the domain."""
    return df.filter(F.col("status").isNotNull() & ~F.col("status").isin(*states))
