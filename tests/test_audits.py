import random
from datetime import datetime, timedelta

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from fenceline.functions.blocked import blocked_recent_max, blocked_running
from fenceline.operators import audit
from fenceline.operators.replay import COMMANDS, OUTCOMES, replay

S = 1_000_000
CLEAN = [
    ("j", 1, 1 * S, "ACQUIRE", True, 0, 0, "FREE", 0, "HELD", 1, "a", "r", 11 * S),
    ("j", 2, 5 * S, "RENEW", True, 1, 1, "HELD", 11 * S, "HELD", 1, "a", "r", 15 * S),
    ("j", 3, 6 * S, "SAVE", True, 1, 1, "HELD", 15 * S, "HELD", 1, "a", "r", 15 * S),
    ("j", 4, 7 * S, "SAVE", False, 0, 1, "HELD", 15 * S, "HELD", 1, "a", "r", 15 * S),
    ("j", 5, 20 * S, "ACQUIRE", True, 1, 1, "HELD", 15 * S, "HELD", 2, "b", "r", 30 * S),
    ("j", 6, 21 * S, "RELEASE", False, 1, 2, "HELD", 30 * S, "HELD", 2, "b", "r", 30 * S),
    ("j", 7, 22 * S, "CLEAR_LOCK", True, 2, 2, "HELD", 30 * S, "FREE", 0, "", "r", 30 * S),
]
BREAKS = {
    "token_falls": ("j", 8, 40 * S, "RELEASE", True, 2, 2, "HELD", 50 * S, "FREE", 1, "b", "r", 50 * S),
    "double_holding": ("j", 8, 40 * S, "ACQUIRE", True, 2, 2, "HELD", 50 * S, "HELD", 3, "c", "r", 50 * S),
    "two_holders": ("j", 8, 60 * S, "ACQUIRE", True, 1, 1, "HELD", 50 * S, "HELD", 2, "c", "r", 70 * S),
    "revived_leases": ("j", 8, 60 * S, "RENEW", True, 2, 2, "HELD", 50 * S, "HELD", 2, "b", "r", 70 * S),
    "zombie_writes": ("j", 8, 40 * S, "SAVE", True, 1, 2, "HELD", 50 * S, "HELD", 2, "b", "r", 50 * S),
    "stolen_unmarked": ("j", 8, 40 * S, "RELEASE", True, 1, 2, "HELD", 50 * S, "FREE", 2, "b", "r", 50 * S),
}


@pytest.mark.parametrize("rule", [None, *BREAKS])
def test_each_rule_finds_its_break_and_no_other(spark, rule):
    log = CLEAN + ([BREAKS[rule]] if rule else [])
    got = {r["rule"]: r["n"] for r in audit.invariant_breaks(spark.createDataFrame(log, OUTCOMES)).collect()}
    assert got == {name: int(name == rule) for name in BREAKS}


def test_rules_on_no_log_and_on_a_replay(spark):
    assert {r["n"] for r in audit.invariant_breaks(spark.createDataFrame([], OUTCOMES)).collect()} == {0}
    r = random.Random(9)
    log = [(f"j{r.randrange(3)}", i, i * S, r.choice(["ACQUIRE", "RENEW", "RELEASE", "SAVE"]), f"p{i % 3}", r.choice([2, 30]) * S, None, r.choice([0, 0, 1]), f"c{i}") for i in range(400)]
    assert {x["n"] for x in audit.invariant_breaks(replay(spark.createDataFrame(log, COMMANDS))).collect()} == {0}


def at(n):
    return datetime(2025, 1, 1) + timedelta(hours=n)


def test_faults_corrupt_only_the_ledger_without_a_guard(spark):
    """Rounds of two writers; in a faulty one the first writes once more after the second took over. Seed and rate are fixed."""
    r = random.Random(42)
    writes, faulty = [], set()
    for n in range(150):
        writes += [(f"round-{n}", 2 * n, 1, at(n)), (f"round-{n}", 2 * n + 1, 2, at(n + 1))]
        if r.random() < 0.2:
            faulty.add(f"round-{n}")
            writes.append((f"round-{n}", 1000 + n, 1, at(n + 2 + 200 * (n % 3))))  # also blocks of time later
    df = spark.createDataFrame([*writes, ("round-0", 5000, None, at(1)), ("round-0", 5001, 9, None)], "e string, id long, token long, t timestamp_ntz")
    got = audit.ledgers(df, "e", "t", "id", "token").collect()
    assert len(got) == 150 and {x["e"] for x in got if x["final"] != x["expected"]} == faulty and 0 < len(faulty) < 60
    assert all(x["guarded_final"] == x["expected"] == 2 for x in got)
    refused = audit.guarded(df.filter("token is not null and t is not null"), "e", "t", "id", "token").filter("not accepted")
    assert {x["e"] for x in refused.collect()} == faulty


def test_progress_that_goes_back_or_is_made_twice(spark, rows):
    log = [
        ("good", "r", 1, "a", at(0)), ("good", "r", 2, "b", at(1)), ("good", "q", 3, "a", at(2)),
        ("back", "r", 1, "b", at(0)), ("back", "r", 2, "a", at(400)), ("twice", "r", 1, "b", at(0)), ("twice", "r", 2, "b", at(400)), ("none", "r", 1, None, at(0)),
    ]
    df = spark.createDataFrame(log, "job string, run string, id long, item string, t timestamp_ntz")
    assert rows(audit.progress_findings(df, "job", ["run"], "item", "t", "id")) == [("back", 1, 0), ("good", 0, 0), ("twice", 0, 1)]


values = st.lists(st.tuples(st.sampled_from("ab"), st.integers(0, 60), st.one_of(st.none(), st.integers(0, 9))), max_size=40)


@settings(max_examples=10, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(values, st.integers(1, 4), st.integers(1, 9))
def test_recent_max_and_wider_blocks_equal_plain_windows(spark, rows, found, recent, width):
    numbered = [(k, i, t, v) for i, (k, t, v) in enumerate(found)]
    df = spark.createDataFrame(numbered, "k string, id long, t long, v long").selectExpr("*", f"t div {width} b", f"t div {width * 3} b2", f"t div {width * 9} b3")
    order = [F.col("t"), F.col("id")]
    peak = {r["id"]: r["peak"] for r in blocked_recent_max(df, ["k"], "b", order, "v", "peak", recent).collect()}
    take = {"n": ("count", "v"), "top": ("max", "v"), "held": ("last", "v")}
    run = {r["id"]: (r["n"], r["top"], r["held"]) for r in blocked_running(df, ["k"], "b", order, take, wider=("b2", "b3")).collect()}
    for k in "ab":
        mine = sorted((t, i, v) for key, i, t, v in numbered if key == k)
        for n, (_, i, _) in enumerate(mine):
            so_far = [v for _, _, v in mine[: n + 1] if v is not None]
            near = [v for _, _, v in mine[max(0, n + 1 - recent) : n + 1] if v is not None]
            assert peak[i] == max(near, default=None)
            assert run[i] == (len(so_far), max(so_far, default=None), so_far[-1] if so_far else None)
    assert len(peak) == len(run) == len(found)
