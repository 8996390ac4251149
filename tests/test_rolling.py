from datetime import date, datetime, timedelta

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from fenceline.operators.rolling import trailing_totals

D0 = date(2025, 1, 1)
SCHEMA = "e string, t timestamp_ntz, v long"


def brute(values, windows):
    out = []
    for e in {x[0] for x in values if x[0]}:
        by, n = {}, {}
        for x, d, v in values:
            if x == e and d is not None:
                by[d] = by.get(d, 0) + max(v or 0, 0)
                n[d] = n.get(d, 0) + 1
        longest = max(windows)
        for d in sorted({a + i for a in by for i in range(longest)}):
            totals = [sum(by.get(d - i, 0) for i in range(w)) for w in windows]
            out.append((e, D0 + timedelta(days=d), n.get(d, 0), *totals, *[t / w for t, w in zip(totals, windows)]))
    return sorted(out, key=repr)


def run(spark, rows, values, windows):
    df = spark.createDataFrame([(e, None if d is None else datetime(2025, 1, 1, 13) + timedelta(days=d), v) for e, d, v in values], SCHEMA)
    return rows(trailing_totals(df, "e", "t", "v", windows))


@settings(max_examples=10, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.sampled_from(["x", "y", None]), st.one_of(st.none(), st.integers(-80, 200)), st.one_of(st.none(), st.integers(-5, 50))), max_size=20))
def test_equals_brute_force(spark, rows, values):
    assert run(spark, rows, values, (7, 30)) == brute(values, (7, 30))


def test_dense_days_and_other_windows(spark, rows):
    values = [("x", d, d % 11) for d in range(100)] * 2
    assert run(spark, rows, values, (1, 2, 13)) == brute(values, (1, 2, 13))


def test_empty_and_clashing_names(spark):
    df = spark.createDataFrame([("x", datetime(2025, 1, 1), 4, 1, 2, 3)], SCHEMA + ", d int, n int, shown int")
    assert trailing_totals(df, "e", "t", "v").count() == 30
    assert trailing_totals(df.limit(0), "e", "t", "v").count() == 0
