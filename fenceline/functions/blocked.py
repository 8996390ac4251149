"""lag and lead over a whole key without bringing the key's rows together.

A window over a key sends all of its rows to one task. Here rows are windowed inside (key, block), and only the first and
last row of every block are windowed over the key: two rows a block, however many rows a key has.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: Up to so many rows, blocks are of MOST_DAYS.
ROWS_FOR_MOST = 40_000_000
MOST_DAYS = 7.0


def block_days_for(n_rows: int) -> float:
    """Length of a block of time for a log of n_rows, so that a block stays one task's work.

    Of a log over a quarter of a year in which one key has a third of all rows, a block then holds about a million rows of
    that key, and the key has n_rows / 3,000,000 blocks. Counting the rows of a Parquet table reads no data.
    """
    return MOST_DAYS * min(1.0, ROWS_FOR_MOST / max(1, n_rows))


def blocked_shift(df: DataFrame, key: list[str], block: str, order: list[Column], take: dict[str, str], back: bool) -> DataFrame:
    """Add for each new name of take the named column's value in the row before (back) or after, by key and order.

    block must not decrease in the order. Rows without such a neighbour get null.
    """
    inside = Window.partitionBy(*key, block).orderBy(*order)
    across = Window.partitionBy(*key).orderBy(block, *order)
    shift = F.lag if back else F.lead
    marked = df.withColumns(
        {new: shift(old).over(inside) for new, old in take.items()}
        | {"_head": F.lag(F.lit(True)).over(inside).isNull(), "_tail": F.lead(F.lit(True)).over(inside).isNull()}
    )
    edge = "_head" if back else "_tail"
    done = marked.filter(~F.col(edge))
    ends = marked.filter(F.col("_head") | F.col("_tail")).withColumns({new: shift(old).over(across) for new, old in take.items()})
    return done.unionByName(ends.filter(F.col(edge))).drop("_head", "_tail")


def blocked_lag(df: DataFrame, key: list[str], block: str, order: list[Column], take: dict[str, str]) -> DataFrame:
    return blocked_shift(df, key, block, order, take, True)


def blocked_lead(df: DataFrame, key: list[str], block: str, order: list[Column], take: dict[str, str]) -> DataFrame:
    return blocked_shift(df, key, block, order, take, False)


def blocked_recent_max(df: DataFrame, key: list[str], block: str, order: list[Column], value: str, new: str, recent: int) -> DataFrame:
    """Add the greatest value of a key's last `recent` rows up to each one, by key and order.

    Inside (key, block) this is a frame of rows. Only a block's first rows look back beyond it, at the last ones of the blocks
    before: so these ends, less than twice `recent` a block, are windowed over the key.
    """
    inside = Window.partitionBy(*key, block).orderBy(*order)
    back = Window.partitionBy(*key, block).orderBy(*[c.desc() for c in order])
    across = Window.partitionBy(*key).orderBy(block, *order).rowsBetween(1 - recent, 0)
    marked = df.withColumns({new: F.max(value).over(inside.rowsBetween(1 - recent, 0)), "_head": F.row_number().over(inside) < recent, "_tail": F.row_number().over(back) < recent})
    ends = marked.filter("_head or _tail").withColumn(new, F.max(value).over(across)).filter("_head")
    return marked.filter("not _head").unionByName(ends).drop("_head", "_tail")


def blocked_running(
    df: DataFrame, key: list[str], block: str, order: list[Column], take: dict[str, tuple[str, str]], include_current: bool = True, wider: tuple[str, ...] = ()
) -> DataFrame:
    """Add running values over a key's rows in order: take[new] = (kind, column), kind one of max, min, sum, count, last.

    Windows stay inside (key, block); what the blocks before come to is one row for each (key, block), carried over the
    key and joined back. last is the last value that isn't null. Without include_current a row's own value is left out.
    wider: columns with wider blocks, from narrow to wide, functions of block. With them the blocks' own rows are carried in
    blocks again, so no task has all of a key's blocks.
    """
    merge = {"max": F.greatest, "min": F.least, "sum": lambda a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0)), "last": lambda a, b: F.coalesce(b, a)}
    merge["count"] = merge["sum"]
    inside_fn = {"max": F.max, "min": F.min, "sum": F.sum, "count": F.count, "last": lambda c: F.last(c, ignorenulls=True)}
    over_fn = inside_fn | {"count": F.sum}
    inside = Window.partitionBy(*key, block).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0 if include_current else -1)
    before = Window.partitionBy(*key).orderBy(block).rowsBetween(Window.unboundedPreceding, -1)
    rank = F.struct(*[F.col(c) if isinstance(c, str) else c for c in order]) if order else F.lit(0)
    totals = {}
    for new, (kind, old) in take.items():
        last = F.max_by(F.col(old), F.when(F.col(old).isNotNull(), rank))
        totals[f"_c_{new}"] = last if kind == "last" else inside_fn[kind](F.col(old))
    carried = df.groupBy(*key, block, *wider).agg(*[c.alias(n) for n, c in totals.items()])
    if wider:
        again = {f"_b_{new}": ("sum" if kind == "count" else kind, f"_c_{new}") for new, (kind, _) in take.items()}
        carried = blocked_running(carried, key, wider[0], [F.col(block)], again, False, wider[1:]).select(*key, block, *again)
    else:
        carried = carried.select(*key, block, *[over_fn[kind](F.col(f"_c_{new}")).over(before).alias(f"_b_{new}") for new, (kind, _) in take.items()])
    local = df.withColumns({f"_i_{new}": inside_fn[kind](F.col(old)).over(inside) for new, (kind, old) in take.items()})
    joined = local.join(carried, [*key, block])
    return joined.withColumns({new: merge[kind](F.col(f"_b_{new}"), F.col(f"_i_{new}")) for new, (kind, _) in take.items()}).drop(
        *[f"{p}{new}" for new in take for p in ("_i_", "_b_")]
    )
