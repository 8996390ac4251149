"""Totals over trailing periods, by block decomposition."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

DAY0 = "date'1970-01-01'"


def daily_totals(df: DataFrame, entity: str, at: str, value: str) -> DataFrame:
    """(e, d, v, n): total and rows of each entity and day number; null and negative values count as 0.

    Rows with a null entity or time belong to no day. Partial sums are made ahead of the shuffle, so what is shuffled and
    windowed afterwards is bounded by the days of an entity, not by its rows.
    """
    day = F.date_diff(F.col(at).cast("date"), F.expr(DAY0))
    amount = F.greatest(F.coalesce(F.col(value), F.lit(0)), F.lit(0))
    rows = df.select(F.col(entity).alias("e"), day.alias("d"), amount.alias("v")).filter("e is not null and d is not null")
    return rows.groupBy("e", "d").agg(F.sum("v").alias("v"), F.count(F.lit(1)).alias("n"))


def trailing_totals(df: DataFrame, entity: str, at: str, value: str, windows: tuple[int, ...] = (7, 30)) -> DataFrame:
    """(entity, on_day, n_rows, total_W and avg_W of the last W days for each W of windows).

    There is a row for every calendar day, with or without rows, on which the longest window holds a row of the entity;
    on all other days every total is 0. Averages are over the W days. Null and negative values count as 0, rows with a
    null entity or time are left out, repeated rows count each, other columns are ignored; an empty input gives an empty
    result.

    Block decomposition: in blocks of W days every day has the sum from its block's start (prefix) and to its block's end
    (suffix). The W days up to d are the prefix at d and the suffix at d - W + 1 in the block before; where d ends a block
    they are that block, so its prefix alone. Days around activity are filled in first, so that the row W - 1 before is
    the day W - 1 before. Everything after the daily sums runs on one shuffle by entity.
    """
    longest = max(windows)
    days = daily_totals(df, entity, at, value)
    along = Window.partitionBy("e").orderBy("d")
    reach = F.lit(longest - 1)
    first = F.least(F.col("d"), F.greatest(F.col("prev") + F.lit(longest), F.col("d") - reach))
    last = F.least(F.coalesce(F.col("next") - 1, F.col("d") + reach), F.col("d") + reach)
    around = days.withColumns({"prev": F.lag("d").over(along), "next": F.lead("d").over(along)})
    dense = around.select("e", F.col("d").alias("own"), "v", "n", F.explode(F.sequence(first, last)).alias("d"))
    own = F.col("d") == F.col("own")
    dense = dense.select(
        "e",
        "d",
        F.when(own, F.col("v")).otherwise(F.lit(0)).alias("v"),
        F.when(own, F.col("n")).otherwise(F.lit(0)).alias("n"),
        (F.col("d") >= F.col("own")).alias("shown"),
    )
    for w in windows:
        block = Window.partitionBy("e", f"b{w}").orderBy("d")
        dense = dense.withColumn(f"b{w}", F.floor(F.col("d") / F.lit(w))).withColumns(
            {f"p{w}": F.sum("v").over(block.rowsBetween(Window.unboundedPreceding, 0)), f"s{w}": F.sum("v").over(block.rowsBetween(0, Window.unboundedFollowing))}
        )
    totals = {}
    for w in windows:
        ends = F.pmod(F.col("d") + 1, F.lit(w)) == 0
        totals[f"total_{w}"] = F.col(f"p{w}") + F.when(ends, F.lit(0)).otherwise(F.coalesce(F.lag(f"s{w}", w - 1).over(along), F.lit(0)))
    shown = dense.withColumns(totals).filter("shown")
    return shown.select(
        F.col("e").alias(entity),
        F.date_from_unix_date("d").alias("on_day"),
        F.col("n").alias("n_rows"),
        *[f"total_{w}" for w in windows],
        *[(F.col(f"total_{w}") / F.lit(w)).alias(f"avg_{w}") for w in windows],
    )
