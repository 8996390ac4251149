from datetime import datetime, timedelta

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from fenceline.operators.intervals import merge_intervals, periods_and_gaps

T0 = datetime(2025, 1, 1)
SCHEMA = "e string, a timestamp_ntz, b timestamp_ntz"


def at(hours):
    return None if hours is None else T0 + timedelta(hours=hours)


def brute(values):
    out = []
    for e in {v[0] for v in values if v[0] is not None}:
        mine = sorted((a, b) for x, a, b in values if x == e and a is not None and b is not None and b > a)
        merged = []
        for a, b in mine:
            if merged and a <= merged[-1][1]:
                merged[-1] = (merged[-1][0], max(merged[-1][1], b), merged[-1][2] + 1)
            else:
                merged.append((a, b, 1))
        out += [(e, "period", at(a), at(b), n) for a, b, n in merged]
        out += [(e, "gap", at(x[1]), at(y[0]), 0) for x, y in zip(merged, merged[1:])]
    return sorted(out, key=repr)


def run(spark, rows, values, **extra):
    df = spark.createDataFrame([(e, at(a), at(b)) for e, a, b in values], SCHEMA)
    return rows(periods_and_gaps(df, "e", "a", "b", **extra))


hours = st.one_of(st.none(), st.integers(0, 400), st.sampled_from([0, 24, 48, 168, 336]))


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.sampled_from(["x", "y", None]), hours, hours), max_size=25), st.sampled_from([1.0, 7.0]))
def test_equals_brute_force(spark, rows, values, block):
    assert run(spark, rows, values, block_days=block) == brute(values)


def test_touching_nested_repeated_and_long(spark, rows):
    values = [("x", 0, 1), ("x", 1, 2), ("x", 0, 2000), ("x", 5, 6), ("x", 300, 301), ("x", 300, 301), ("x", 2000, 2001), ("x", 2002, 2003), ("y", 3, 3), ("y", 5, 4)]
    assert run(spark, rows, values, block_days=1.0) == brute(values)


def test_a_millisecond_apart_is_apart(spark, rows):
    a = T0 + timedelta(hours=1)
    df = spark.createDataFrame([("x", T0, a), ("x", a + timedelta(microseconds=1), a + timedelta(hours=1))], SCHEMA)
    assert merge_intervals(df, "e", "a", "b").count() == 2


def test_empty_and_clashing_names(spark):
    df = spark.createDataFrame([("x", at(0), at(5), 1, "z", 2)], SCHEMA + ", n int, w string, period_start int")
    assert [tuple(r) for r in merge_intervals(df, "e", "a", "b").collect()] == [("x", at(0), at(5), 1)]
    assert periods_and_gaps(df.limit(0), "e", "a", "b").count() == 0


def test_hot_entity(spark):
    values = spark.range(20000).selectExpr("'hot' e", "timestamp_ntz'2025-01-01' + make_dt_interval(0, 0, id * 2) a", "timestamp_ntz'2025-01-01' + make_dt_interval(0, 0, id * 2 + 1) b")
    got = merge_intervals(values, "e", "a", "b", 1.0)
    assert got.count() == 20000
    assert merge_intervals(values.selectExpr("e", "a", "a + interval 2 minutes as b"), "e", "a", "b", 1.0).select("n_members").collect()[0][0] == 20000
