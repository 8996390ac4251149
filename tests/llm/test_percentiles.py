import math
import random
from decimal import Decimal

import pytest

pytest.importorskip("fenceline.llm")

from pyspark.sql.types import LongType  # noqa: E402

from fenceline.llm.percentiles import merged_counts, percentiles, rounded_down, value_counts  # noqa: E402

PERCENTS = [0, 1, 25, 50, 75, 99, 100]


def brute(values, percents):
    out = []
    for g in {g for g, v in values if g is not None and v is not None}:
        mine = sorted(v for x, v in values if x == g and v is not None)
        out += [(g, len(mine), p, mine[max(1, math.ceil(len(mine) * Decimal(str(p)) / 100)) - 1]) for p in percents]
    return sorted(out, key=repr)


def draw(seed, n):
    r = random.Random(seed)
    pick = lambda: r.choice([None, -3, -1, 0, 0, 1, 2, -r.randrange(10**5), -(2**63), 2**63 - 1, r.randrange(10), r.randrange(10**4), int(r.paretovariate(0.3)) % 2**62, 2**62])
    return [("hot" if r.random() < 0.4 else r.choice(["a", "b", "c", None]), pick()) for _ in range(n)]


@pytest.mark.parametrize("seed,n", [(1, 5), (2, 60), (3, 900)])
def test_exact(spark, rows, seed, n):
    values = draw(seed, n)
    df = spark.createDataFrame(values, "g string, x long")
    assert rows(percentiles(value_counts(df, ["g"], "x"), PERCENTS)) == brute(values, PERCENTS)


def test_combined_parts_equal_the_whole_within_the_stated_error(spark, rows):
    values = draw(4, 600)
    df = spark.createDataFrame(values, "g string, x long")
    parts = [value_counts(spark.createDataFrame(values[k::3], df.schema), ["g"], "x", 8) for k in range(3)]
    got = rows(percentiles(merged_counts(*parts), PERCENTS))
    assert got == rows(percentiles(value_counts(df, ["g"], "x", 8), PERCENTS))
    for (g, n, p, v), (g2, n2, p2, true) in zip(got, brute(values, PERCENTS)):
        assert (g, n, p) == (g2, n2, p2)
    exact = {(g, p): v for g, _, p, v in brute(values, PERCENTS)}
    assert all(abs(v - exact[g, p]) <= 2**-7 * abs(exact[g, p]) and abs(v) <= abs(exact[g, p]) for g, _, p, v in got)


def test_grid_is_bounded(spark):
    df = spark.range(200_000).selectExpr("'g' g", "id * 37 x")
    assert value_counts(df, ["g"], "x", 6).count() <= 64 * 2**6
    got = [r[0] for r in spark.createDataFrame([(v,) for v in (0, 1, 255, 256, 257, 1023, -1, -256, -258, -1024)], "v long").select(rounded_down("v", 8, LongType())).collect()]
    assert got == [0, 1, 255, 256, 256, 1020, -1, -256, -257, -1021]


def test_no_value_is_dropped_or_cut(spark, rows):
    values = [-5.0, -1.5, 0.25, 0.75, 2.5]
    df = spark.createDataFrame([("g", v) for v in values], "g string, x double")
    assert rows(percentiles(value_counts(df, ["g"], "x"), [0, 50, 100])) == [("g", 5, 0, -5.0), ("g", 5, 100, 2.5), ("g", 5, 50, 0.25)]


@pytest.mark.parametrize("seed", [1, 2])
def test_floating_point_numbers(spark, rows, seed):
    r = random.Random(seed)
    pick = lambda: r.choice([r.uniform(-2, 2), r.gauss(0, 1e6), math.inf, -math.inf, 0.0, 1e-310, -1e300, r.uniform(0, 1) ** 40, 2.5])
    values = [(r.choice("ab"), pick()) for _ in range(500)]
    df = spark.createDataFrame(values, "g string, x double")
    assert rows(percentiles(value_counts(df, ["g"], "x"), PERCENTS)) == brute(values, PERCENTS)
    exact = {(g, p): v for g, _, p, v in brute(values, PERCENTS)}
    for g, _, p, v in rows(percentiles(value_counts(df, ["g"], "x", 8), PERCENTS)):
        assert v == exact[g, p] or abs(v - exact[g, p]) <= max(2**-7 * abs(exact[g, p]), 1e-307)


def test_nan_decimals_and_parts_of_a_percent(spark, rows):
    nan = spark.createDataFrame([("1",), ("NaN",), ("Infinity",), ("-0.0",), (None,)], "x string").selectExpr("cast(x as float) x")
    got = {p: v for _, p, v in percentiles(nan.select(nan.x.alias("v")), [0, 50, 75, 100]).collect()}
    assert (got[0], got[50], got[75]) == (0.0, 1.0, math.inf) and math.isnan(got[100])
    money = spark.createDataFrame([(Decimal(i) / 100 - 5,) for i in range(1000)], "v decimal(12,2)")
    assert rows(percentiles(money, [99.9, 0.05, 50])) == sorted([(1000, 99.9, Decimal("4.98")), (1000, 0.05, Decimal("-5.00")), (1000, 50.0, Decimal("-0.01"))], key=repr)
    with pytest.raises(TypeError):
        percentiles(spark.createDataFrame([("a",)], "v string"), [50])
    with pytest.raises(ValueError):
        percentiles(money, [101])


def test_groups_put_together(spark, rows):
    values = [(g, r, v) for r in range(7) for g, v in draw(r, 120)]
    df = spark.createDataFrame(values, "g string, day int, v long")
    got = rows(percentiles(df, PERCENTS, {"day": -1}).filter("day = -1").drop("day"))
    assert got == brute([(g, v) for g, _, v in values], PERCENTS)
    single = rows(percentiles(df, PERCENTS))
    assert rows(percentiles(df, PERCENTS, {"day": -1}).filter("day >= 0")) == single


def test_empty_ties_and_clashing_names(spark, rows):
    df = spark.createDataFrame([("g", 7, 1, "x", 2)] * 5, "g string, x long, n int, v string, part int")
    assert rows(percentiles(value_counts(df, ["g"], "x"), [50])) == [("g", 5, 50, 7)]
    assert percentiles(value_counts(df.limit(0), ["g"], "x"), [50]).count() == 0
    assert percentiles(value_counts(df.selectExpr("g", "cast(null as long) x"), ["g"], "x"), [50]).count() == 0
