"""The current row of each run in an extract of the run history."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.keys import clean_name, run_key


def current_runs(runs: DataFrame, *keep: str) -> DataFrame:
    """One row for each (job, run): job_name in its clean form, and the columns of keep.

    Of a run's rows one with a finish comes before one without, then the latest loaded_at, then the highest rec_id; of
    rows equal in all that, the highest by the kept columns, so the result doesn't depend on the order of the rows. Null
    comes last throughout. Rows whose job name is null or blank belong to no run; a null or blank run id is one run of
    its job. Other columns of the input are ignored. An empty input gives an empty result.

    The rank filter becomes a group limit ahead of the shuffle too, so a run with very many rows sends a row a task.
    """
    named = runs.select(
        clean_name("job_name").alias("job_name"),
        run_key("run_id").alias("_run"),
        F.col("finished_at").isNotNull().alias("_done"),
        F.col("loaded_at").alias("_loaded"),
        F.col("rec_id").alias("_rec"),
        *[F.col(c) for c in keep],
    ).filter(F.col("job_name").isNotNull())
    order = [F.desc("_done"), F.desc_nulls_last("_loaded"), F.desc_nulls_last("_rec"), *[F.desc_nulls_last(c) for c in keep]]
    rank = F.row_number().over(Window.partitionBy("job_name", "_run").orderBy(*order))
    return named.withColumn("_rank", rank).filter("_rank = 1").select("job_name", *keep)
