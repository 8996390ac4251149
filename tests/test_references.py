import random
from datetime import datetime, timedelta

import pytest

from fenceline.operators import references
from fenceline.operators.references import References, orphan_counts, orphan_rows

T0 = datetime(2025, 1, 20)


def day(n):
    return None if n is None else T0 + timedelta(days=n)


def make(spark, rows, targets, gone):
    return References(
        spark.createDataFrame([(i, k, day(t)) for i, (k, t) in enumerate(rows)], "rec_id long, k string, at timestamp_ntz"),
        spark.createDataFrame([(k, day(t)) for k, t in targets], "k string, at timestamp_ntz"),
        spark.createDataFrame([(k,) for k in gone], "k string"),
        ("k",),
    )


def brute(rows, targets, gone):
    first, there = {}, set()
    for k, t in targets:
        there.add(k)
        if t is not None:
            first[k] = min(first.get(k, t), t)
    out = []
    for i, (k, t) in enumerate(rows):
        if k is None:
            continue
        if k not in there:
            out.append((i, "deleted" if k in gone else "missing", t))
        elif t is not None and k in first and t < first[k]:
            out.append((i, "late", t))
    return out


def cases(seed, n=400):
    r = random.Random(seed)
    keys = [*"abcdefgh", None]
    pick = lambda: "hot" if r.random() < 0.4 else r.choice(keys)
    return (
        [(pick(), r.choice([None, *range(60)])) for _ in range(n)],
        [(r.choice(["hot", "a", "b", "c", None]), r.choice([None, *range(10, 50)])) for _ in range(6)] + [("d", None)],
        ["e", "a", None, "e"],
    )


@pytest.mark.parametrize("heavy", [10**9, 20])
@pytest.mark.parametrize("seed", [1, 2, 3])
def test_rows_and_counts_equal_brute_force(spark, rows, monkeypatch, heavy, seed):
    monkeypatch.setattr(references, "HEAVY_LEAST", heavy)
    data = cases(seed)
    refs, want = make(spark, *data), brute(*data)
    assert rows(orphan_rows(refs).select("rec_id", "orphan_kind")) == sorted(((i, k) for i, k, _ in want), key=repr)
    counted = {}
    for _, kind, t in want:
        key = (None if t is None else day(t).strftime("%Y-%m"), kind)
        counted[key] = counted.get(key, 0) + 1
    assert rows(orphan_counts(refs)) == sorted(((p, k, n) for (p, k), n in counted.items()), key=repr)


def test_empty_tables(spark):
    rows, targets, gone = cases(1)
    assert orphan_rows(make(spark, [], targets, gone)).count() == 0
    assert orphan_rows(make(spark, rows, [], [])).count() == sum(k is not None for k, _ in rows)
    assert orphan_counts(make(spark, [], [], [])).count() == 0


def test_clashing_columns_are_returned(spark):
    refs = make(spark, [("x", 1)], [], [])
    wide = References(refs.rows.selectExpr("*", "1 as n", "2 as lo", "3 as there"), refs.targets.selectExpr("*", "1 as n"), refs.deletions, ("k",))
    assert orphan_rows(wide).select("rec_id", "n", "lo", "there", "orphan_kind").first()[1:] == (1, 2, 3, "missing")


def test_rows_of_a_hot_key_are_not_shuffled(spark):
    """A third of all references have one key: no exchange of the plan gets more than the others and a row a key and month."""
    n = 3000
    df = spark.range(n).selectExpr("id as rec_id", "case when id % 3 = 0 then 'hot' else concat('k', id % 50) end as k", "timestamp_ntz'2025-01-20' + make_dt_interval(0, 0, int(id)) as at")
    targets = spark.createDataFrame([(f"k{i}", day(0)) for i in range(40)], "k string, at timestamp_ntz")
    refs = References(df, targets, spark.createDataFrame([], "k string"), ("k",))
    heavy = references._heavy_keys(refs, references._per_key_and_period(refs))
    assert heavy is None  # 1000 rows are no burden yet
    monkey = references.HEAVY_LEAST
    try:
        references.HEAVY_LEAST = 100
        heavy = references._heavy_keys(refs, references._per_key_and_period(refs))
        assert [r["k"] for r in heavy.collect()] == ["hot"]
        many, others = references._split(df, ["k"], heavy)
        assert many.count() == n // 3 and others.count() == n - n // 3
        found = orphan_rows(refs)
        plan = found._jdf.queryExecution().executedPlan()
        assert found.count() == n // 3 + sum(1 for i in range(n) if i % 3 and i % 50 >= 40)
        found.collect()
        assert max(shuffled(plan)) <= n - n // 3
    finally:
        references.HEAVY_LEAST = monkey


def shuffled(node):
    """Records written by each exchange of an executed plan."""
    name = node.getClass().getSimpleName()
    if name == "AdaptiveSparkPlanExec":
        return shuffled(node.executedPlan())
    if "QueryStageExec" in name:
        return shuffled(node.plan())
    out = [node.metrics().apply("shuffleRecordsWritten").value()] if name == "ShuffleExchangeExec" else []
    children = node.children()
    return out + [x for i in range(children.size()) for x in shuffled(children.apply(i))]
