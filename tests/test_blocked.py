import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from fenceline.functions.blocked import blocked_lag, blocked_lead, blocked_running


def frame(spark, n=300, seed=1):
    r = random.Random(seed)
    values = [(r.choice("ab"), i // r.choice([10, 10, 10]), i, r.choice([None, *range(9)])) for i in range(n)]
    return spark.createDataFrame(values, "k string, b long, i long, v long")


def test_lag_and_lead_equal_plain_windows(spark, rows):
    df, w = frame(spark), Window.partitionBy("k").orderBy("i")
    got = blocked_lag(df, ["k"], "b", [F.col("i")], {"p": "v", "j": "i"})
    assert rows(got.select("i", "p", "j")) == rows(df.select("i", F.lag("v").over(w), F.lag("i").over(w)))
    got = blocked_lead(df, ["k"], "b", [F.col("i")], {"p": "v"})
    assert rows(got.select("i", "p")) == rows(df.select("i", F.lead("v").over(w)))


def test_running_values_equal_plain_windows(spark, rows):
    df = frame(spark, seed=2)
    for current, end in ((True, 0), (False, -1)):
        w = Window.partitionBy("k").orderBy("i").rowsBetween(Window.unboundedPreceding, end)
        take = {"mx": ("max", "v"), "mn": ("min", "v"), "sm": ("sum", "v"), "n": ("count", "v"), "l": ("last", "v")}
        got = blocked_running(df, ["k"], "b", [F.col("i")], take, current)
        want = df.select("i", F.max("v").over(w), F.min("v").over(w), F.coalesce(F.sum("v").over(w), F.lit(0)), F.count("v").over(w), F.last("v", ignorenulls=True).over(w))
        assert rows(got.select("i", *take)) == rows(want)


def test_empty(spark):
    df = frame(spark).limit(0)
    assert blocked_lag(df, ["k"], "b", [F.col("i")], {"p": "v"}).count() == 0
    assert blocked_running(df, ["k"], "b", [F.col("i")], {"p": ("max", "v")}).count() == 0
