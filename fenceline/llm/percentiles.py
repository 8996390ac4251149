"""Percentiles of very large numeric columns by bisection of value intervals."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, DecimalType, DoubleType, FloatType, IntegralType

from ..session import discard, written

#: Each pass cuts an interval at 2 ** PASS_BITS - 1 midpoints at once: so many halvings for one look at the data.
PASS_BITS = 8

#: The first pass cuts at the powers of two, and between two of them at 2 ** FIRST_BITS - 1 midpoints.
FIRST_BITS = 6

#: Percents may have so many decimal places.
PLACES = 6

_LOW_63 = 2**63 - 1


def _shifted(v: Column, by: Column) -> Column:
    return F.call_function("shiftright", v, by)


def _order(v: Column | str, kind: DataType) -> Column:
    """A whole number in the order of the values: themselves, the digits of a decimal, or the bits of a floating-point number.

    -0.0 is 0.0; NaN comes after all others.
    """
    v = F.col(v) if isinstance(v, str) else v
    if isinstance(kind, IntegralType):
        return v.cast("long")
    if isinstance(kind, (FloatType, DoubleType)):
        bits = F.java_method(F.lit("java.lang.Double"), F.lit("doubleToLongBits"), v.cast("double") + F.lit(0.0)).cast("long")
        return F.when(v.isNull(), None).when(bits < 0, bits.bitwiseXOR(F.lit(_LOW_63))).otherwise(bits)
    if isinstance(kind, DecimalType) and kind.precision <= 18:
        return (v * F.lit(10**kind.scale).cast("decimal(19,0)")).cast("long")
    raise TypeError(f"no percentiles of {kind.simpleString()}")


def _value(order: Column, kind: DataType) -> Column:
    """The value of a number made by _order."""
    if isinstance(kind, (FloatType, DoubleType)):
        bits = F.when(order < 0, order.bitwiseXOR(F.lit(_LOW_63))).otherwise(order)
        return F.java_method(F.lit("java.lang.Double"), F.lit("longBitsToDouble"), bits).cast(kind)
    if isinstance(kind, DecimalType):
        return (order.cast("decimal(19,0)") / F.lit(10**kind.scale).cast("decimal(19,0)")).cast(kind)
    return order.cast(kind)


def _size(order: Column) -> Column:
    """order for numbers from 0, and so that -1 is 0, -2 is 1 ... for those below."""
    return F.when(order < 0, F.bitwise_not(order)).otherwise(order)


def _signed(size: Column, order: Column) -> Column:
    return F.when(order < 0, F.bitwise_not(size)).otherwise(size)


def rounded_down(value: Column | str, keep_bits: int, kind: DataType) -> Column:
    """value with all but its keep_bits leading binary digits set to 0: less than 2 ** (1 - keep_bits) of it is lost, towards 0.

    Below 0 a whole number's digits are those of the number after it, so -1 - x is rounded as x is. The grid is the same for
    all data, so counts of such values can be added up over partitions, days or files.
    """
    order = _order(value, kind)
    size = _size(order)
    if isinstance(kind, (FloatType, DoubleType)):
        drop = F.lit(53 - keep_bits)  # of the 52 digits after the first one
    else:
        drop = F.greatest(F.length(F.bin(size)) - F.lit(keep_bits), F.lit(0))
    return _value(_signed(F.call_function("shiftleft", _shifted(size, drop), drop), order), kind)


def _whole(df: DataFrame, columns: list[str]) -> DataFrame:
    """The rows without a null in columns; NaN is none."""
    return df.filter(reduce(Column.__and__, [F.col(c).isNotNull() for c in columns]))


def value_counts(df: DataFrame, group: list[str], value: str, keep_bits: int | None = None) -> DataFrame:
    """The part that can be combined: (group, v, n), how often each value occurs, on the grid if keep_bits is given.

    Values are whole, decimal (up to 18 digits) or floating-point numbers, of any sign. With keep_bits, from 2 to 50, a group
    has at most 64 * 2 ** keep_bits rows of whole numbers and 2048 * 2 ** keep_bits of floating-point ones for each sign,
    however large it is. Null values and rows with a null in group are left out. NaN is a value, larger than all others.
    Made ahead of the shuffle as far as possible.
    """
    rows = _whole(df.select(*group, F.col(value).alias("v")), [*group, "v"])
    if keep_bits:
        rows = rows.withColumn("v", rounded_down("v", keep_bits, rows.schema["v"].dataType))
    return rows.groupBy(*group, "v").agg(F.count(F.lit(1)).alias("n"))


def merged_counts(*parts: DataFrame) -> DataFrame:
    """Counts of several days, files or partitions put together; all must be on the same grid."""
    group = [c for c in parts[0].columns if c not in ("v", "n")]
    return reduce(DataFrame.unionByName, parts).groupBy(*group, "v").agg(F.sum("n").alias("n"))


def percentiles(counts: DataFrame, percents: list[float], together: dict[str, object] | None = None) -> DataFrame:
    """(group, n_values, percent, value): for each percent the smallest value that at least so many percent don't exceed.

    counts: (group, v, n) as value_counts gives them; without n every row counts once. Rows with a null are left out. The values
    are exact ones of counts; on a grid of keep_bits they are less than 2 ** (1 - keep_bits) off the true ones,
    relatively. Percents from 0 to 100 with up to PLACES decimal places; 0 is the smallest value. Empty counts give an empty
    result. Groups of any size are handled; ties and repeated values count by their number. together: {column: shown}, also
    the percentiles of all rows that differ in that group column only, put together, with the column as shown (no value of its own).

    Bisection: a (group, percent) holds the interval in which its target rank lies, and the rank inside it. Each pass
    counts the rows between the midpoints inside the intervals still open and keeps the part that holds the rank. A part's
    first and last rank are its least and greatest value; the others go on to the next pass. The first pass cuts at the powers
    of two and halves FIRST_BITS times between them, each later one halves PASS_BITS times. Only rows in open intervals go on,
    so passes shrink; they and the state are cut off into written tables. Counting is by (group, part), pre-aggregated, so
    a group with a third of all rows is no more than its few parts, and groups put together are added up from those.
    """
    group = [c for c in counts.columns if c not in ("v", "n")]
    kind = counts.schema["v"].dataType
    scaled = [round(p * 10**PLACES) for p in percents]
    if any(not 0 <= p <= 100 for p in percents):
        raise ValueError(f"percents are from 0 to 100: {percents}")
    n = F.col("n").cast("long") if "n" in counts.columns else F.lit(1).cast("long")
    rows = _whole(counts, [*group, "v"]).select(*group, _order("v", kind).alias("v"), n.alias("n"))
    digits = F.length(F.bin(_size(F.col("v"))))
    alive = written(rows.withColumn("d", F.when(F.col("v") < 0, -digits).otherwise(digits).cast("byte")), "value-counts")
    state, done = None, []
    for depth in range(2 + 64 // PASS_BITS):
        cut = alive.withColumn("part", _part(depth))
        if state is None:
            parts = fine = _parts(cut, group)
            for column, shown in (together or {}).items():
                one = fine.withColumn(column, F.lit(shown).cast(counts.schema[column].dataType)).groupBy(*group, "d", "part")
                parts = parts.unionByName(one.agg(F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi")))
            hits = _hits(_with_ranks(_counted(parts, group), group, scaled))
        else:
            inside = _parts(cut, group).withColumn("up", _shifted(F.col("part"), _finer(depth)))
            hits = _hits(_counted(inside, [*group, "d", "up"]).join(state, [*group, "d", "up"]))
        ended = (F.col("lo") == F.col("hi")) | (F.col("n") == 2)
        found = written(hits.withColumn("ended", ended), "bisection")
        at = lambda r: F.when(r["rank"] == 1, F.col("lo")).otherwise(F.col("hi"))
        edge = lambda r: (r["rank"] == 1) | (r["rank"] == F.col("n"))
        known = F.transform(F.filter("asked", lambda r: F.col("ended") | edge(r)), lambda r: F.struct(r["p"].alias("p"), at(r).alias("value")))
        done.append(found.select(*group, "n_values", F.inline(known)))
        state = found.filter(~F.col("ended")).withColumn("asked", F.filter("asked", lambda r: ~edge(r))).filter(F.size("asked") > 0)
        state = state.select(*group, "d", F.col("part").alias("up"), "n_values", "asked")
        before = alive
        if state.isEmpty():
            discard(before)
            break
        alive = written(_open_rows(cut, state.select(*group, "d", "up"), group, together if depth == 0 else None), "open-values")
        discard(before)
    whole = all(p % 10**PLACES == 0 for p in scaled)
    percent = (F.col("p") / F.lit(10**PLACES)).cast("int" if whole else "double")
    return reduce(DataFrame.unionByName, done).select(*group, "n_values", percent.alias("percent"), _value(F.col("value"), kind).alias("value"))


def _parts(cut: DataFrame, group: list[str]) -> DataFrame:
    return cut.groupBy(*group, "d", "part").agg(F.sum("n").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))


def _open_rows(cut: DataFrame, still: DataFrame, group: list[str], together: dict[str, object] | None) -> DataFrame:
    """The rows of cut in parts that are still open, for groups put together once more with the column as shown."""
    at = cut.withColumnRenamed("part", "up")
    rows = at.join(still, [*group, "d", "up"], "left_semi")
    for column, shown in (together or {}).items():
        both = at.withColumn(column, F.lit(shown).cast(cut.schema[column].dataType))
        rows = rows.unionByName(both.join(still.filter(F.col(column) == F.lit(shown)), [*group, "d", "up"], "left_semi"))
    return rows.select(*group, "v", "n", "d")


def _counted(parts: DataFrame, key: list[str]) -> DataFrame:
    """parts with upto, the rows in a key's parts up to this one."""
    return parts.withColumn("upto", F.sum("n").over(Window.partitionBy(*key).orderBy("d", "part")))


def _with_ranks(counted: DataFrame, group: list[str], scaled: list[int]) -> DataFrame:
    """With each percent's rank in the whole group: the least whole number that is at least percent % of all, 1 at least."""
    counted = counted.withColumn("n_values", F.sum("n").over(Window.partitionBy(*group)))
    one = 100 * 10**PLACES
    rank = lambda p: F.greatest(F.ceil(F.col("n_values").cast("decimal(20,0)") * F.lit(p).cast("decimal(10,0)") / F.lit(one).cast("decimal(10,0)")), F.lit(1)).cast("long")
    return counted.withColumn("asked", F.array(*[F.struct(F.lit(p).cast("long").alias("p"), rank(p).alias("rank")) for p in scaled]))


def _hits(parts: DataFrame) -> DataFrame:
    """The parts that hold a rank, and the ranks inside them."""
    before = F.col("upto") - F.col("n")
    here = F.filter("asked", lambda r: (r["rank"] > before) & (r["rank"] <= F.col("upto")))
    inner = F.transform(here, lambda r: F.struct(r["p"].alias("p"), (r["rank"] - before).alias("rank")))
    return parts.withColumn("asked", inner).filter(F.size("asked") > 0).drop("upto", "up")


def _digits_dropped(depth: int) -> Column:
    return F.greatest(F.abs(F.col("d").cast("int")) - F.lit(1 + FIRST_BITS + PASS_BITS * depth), F.lit(0))


def _part(depth: int) -> Column:
    """Leading binary digits of v, PASS_BITS more at each depth."""
    v = F.col("v")
    return _signed(_shifted(_size(v), _digits_dropped(depth)), v)


def _finer(depth: int) -> Column:
    """By how many digits a part at this depth is longer than the one before it."""
    return _digits_dropped(depth - 1) - _digits_dropped(depth)
