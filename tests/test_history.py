from datetime import datetime, timedelta

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from fenceline.operators.history import bitemporal_ledger, versions

T0 = datetime(2025, 1, 1)
SCHEMA = "e string, s timestamp_ntz, l timestamp_ntz, r long, v string, w long"


def day(n):
    return None if n is None else T0 + timedelta(days=n)


def frame(spark, values):
    return spark.createDataFrame([(e, day(s), day(t), i, v, w) for i, (e, s, t, v, w) in enumerate(values)], SCHEMA)


def ledger(spark, values, block=7.0):
    return bitemporal_ledger(frame(spark, values), "e", "s", "l", "r", ["v", "w"], block)


def believed(values, e, when):
    """What the snapshots recorded up to `when` say about e: {valid_from: (valid_to, values)}."""
    known = {}
    order = sorted((t if t is not None else -(10**6), i, s, v, w) for i, (x, s, t, v, w) in enumerate(values) if x == e and s is not None)
    for t, _, s, v, w in order:
        if t <= when:
            known[s] = (v, w)
    starts = sorted(known)
    return {day(s): (day(n), *known[s]) for s, n in zip(starts, [*starts[1:], None])}


day_numbers = st.integers(0, 40)
snapshot = st.tuples(
    st.sampled_from(["x", "y", None]), st.one_of(st.none(), day_numbers), st.one_of(st.none(), day_numbers), st.sampled_from(["p", "q", None]), st.sampled_from([1, None])
)


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(snapshot, max_size=25), st.sampled_from([1.0, 7.0, 100.0]))
def test_ledger_tells_what_was_believed_at_any_time(spark, values, block):
    got = [tuple(r) for r in ledger(spark, values, block).collect()]
    for e in ("x", "y"):
        for when in range(-1, 42):
            seen = {}
            for x, valid_from, valid_to, since, until, v, w in got:
                if x == e and (since is None or since <= day(when)) and (until is None or until > day(when)):
                    assert valid_from not in seen
                    seen[valid_from] = (valid_to, v, w)
            assert seen == believed(values, e, when)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(snapshot, max_size=25))
def test_versions(spark, values):
    got = sorted((tuple(r) for r in versions(ledger(spark, values, 3.0), "e", ["v", "w"], 5.0).collect()), key=repr)
    want = []
    for e in ("x", "y"):
        now = believed(values, e, 10**5)
        starts = [s for i, s in enumerate(sorted(now)) if not i or now[s][1:] != now[sorted(now)[i - 1]][1:]]
        want += [(e, s, n, *now[s][1:]) for s, n in zip(starts, [*starts[1:], None])]
    assert got == sorted(want, key=repr)


def test_late_update_splits_and_supersedes(spark, rows):
    values = [("x", 0, 0, "p", 1), ("x", 10, 10, "q", 1), ("x", 5, 12, "r", 1)]
    assert rows(ledger(spark, values)) == sorted(
        [
            ("x", day(0), None, day(0), day(10), "p", 1),
            ("x", day(0), day(10), day(10), day(12), "p", 1),
            ("x", day(0), day(5), day(12), None, "p", 1),
            ("x", day(10), None, day(10), None, "q", 1),
            ("x", day(5), day(10), day(12), None, "r", 1),
        ],
        key=repr,
    )


def test_same_correction_says_nothing_new(spark):
    assert ledger(spark, [("x", 0, 0, "p", 1), ("x", 0, 3, "p", 1), ("x", 0, 3, "p", 1)]).count() == 1


def test_empty_and_clashing_names(spark):
    df = frame(spark, [("x", 0, 0, "p", 1)]).selectExpr("*", "1 as b", "2 as step", "3 as valid_from")
    assert bitemporal_ledger(df, "e", "s", "l", "r", ["v", "w"]).count() == 1
    assert bitemporal_ledger(df.limit(0), "e", "s", "l", "r", ["v", "w"]).count() == 0


def test_newest_first_is_a_row_or_two_a_block(spark, rows):
    from fenceline.operators.history import _block_minima

    values = [("x", s, 100 - s, "p", s % 3) for s in range(60)]
    raw = frame(spark, values).selectExpr("e", "floor(datediff(s, '2025-01-01') / 7) as b", "l", "r", "s")
    assert _block_minima(raw).count() <= 2 * 9
    got = [tuple(r) for r in ledger(spark, values).collect()]
    assert {(r[1], r[2]) for r in got if r[4] is None} == {(day(s), day(s + 1) if s < 59 else None) for s in range(60)}
    assert len(got) == len(values)  # the next one is known before, so nothing is ever replaced
    in_order = [("x", s, s, "p", s % 3) for s in range(60)]
    assert ledger(spark, in_order).count() == 2 * 60 - 1
    mixed = [("x", 0, 0, "p", 1), *values[1:]]  # one old snapshot listens to all that comes
    assert sum(r[1] == day(0) for r in ledger(spark, mixed).collect()) == 60
