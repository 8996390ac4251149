import random

import pytest

pytest.importorskip("fenceline.llm")

from pyspark.sql import functions as F  # noqa: E402

from fenceline.llm.mixing import Target, largest_budget, mix, place, read_targets, shares  # noqa: E402
from fenceline.llm.tokens import with_token_counts  # noqa: E402


def docs(spark, n=3000, seed=1):
    r = random.Random(seed)
    source = lambda: r.choices([" Hot", "b\t", "C", "other", None, " "], [6, 3, 0.3, 2, 0.2, 0.2])[0]
    values = [(i, source(), r.choice([None, "", "a b", "one two three " * r.randrange(1, 40)])) for i in range(n)]
    return spark.createDataFrame(values, "doc_id long, source string, text string").selectExpr("*", "1 as n_tokens", "2 as copies", "3 as place").cache()


def targets(spark, values):
    return spark.createDataFrame(values, "source string, target_share double, max_repeats int")


TARGETS = [("hot", 0.5, 1), ("B", 0.3, 2), ("c", 0.15, 4), ("nothing", 0.05, 3)]


def test_shares_and_caps(spark):
    d = docs(spark)
    mixture, plan, total = mix(d, targets(spark, TARGETS), budget=40_000)
    have = {r["doc_id"]: r for r in with_token_counts(d.select("doc_id", "text"), ["doc_id"]).collect()}
    got = mixture.collect()
    assert len({r["doc_id"] for r in got}) == len(got)
    biggest = max(r["n_tokens"] for r in have.values())
    for source, share, cap in TARGETS:
        mine = [r for r in got if r["source"] == source.lower()]
        given = sum(r["n_tokens"] * r["copies"] for r in mine)
        possible = sum(have[r["doc_id"]]["n_tokens"] for r in d.collect() if (r["source"] or "").strip().lower() == source.lower()) * cap
        want = min(share * 40_000, possible)
        assert abs(given - want) <= biggest and all(1 <= r["copies"] <= cap for r in mine)
        assert all(r["n_tokens"] == have[r["doc_id"]]["n_tokens"] for r in mine)
        assert not mine or max(r["copies"] for r in mine) - min(r["copies"] for r in mine) <= 1
    report = {r["source"]: r for r in shares(mixture, plan, total).collect()}
    assert report["nothing"]["given_tokens"] == 0 and sum(r["actual_share"] for r in report.values()) == pytest.approx(1)
    assert report["hot"]["given_tokens"] == sum(r["n_tokens"] * r["copies"] for r in got if r["source"] == "hot")


def test_thresholds_equal_a_sort(spark):
    """The documents drawn are the first by place whose tokens come nearest to the budget."""
    d = docs(spark, 800, 2)
    mixture, plan, _ = mix(d, targets(spark, [("hot", 1.0, 3)]), budget=9_000, seed=5)
    counted = with_token_counts(d.filter("trim(source) = 'Hot'"), ["doc_id"]).withColumn("place", place("doc_id", 5)).orderBy("place").collect()
    rest = 9_000 - plan[0].full_copies * sum(r["n_tokens"] for r in counted)
    assert 0 <= rest < sum(r["n_tokens"] for r in counted)
    extra, so_far = set(), 0
    for r in counted:
        if so_far + r["n_tokens"] > rest and so_far + r["n_tokens"] - rest >= rest - so_far:
            break
        extra.add(r["doc_id"])
        so_far += r["n_tokens"]
        if so_far > rest:
            break
    copies = {r["doc_id"]: r["copies"] for r in mixture.collect()}
    assert {k for k, c in copies.items() if c == plan[0].full_copies + 1} == extra


def test_budgets_are_nested(spark):
    d = docs(spark, 500)
    small, large = ({r["doc_id"]: r["copies"] for r in mix(d, targets(spark, TARGETS), budget=b)[0].collect()} for b in (3_000, 8_000))
    assert all(large.get(k, 0) >= c for k, c in small.items())


def test_largest_budget():
    make = lambda *x: [Target(str(i), s, r, t) for i, (s, r, t) in enumerate(x)]
    assert largest_budget(make((0.5, 1, 100), (0.5, 2, 100)), 0.0) == 200
    assert largest_budget(make((0.5, 1, 100), (0.4, 9, 900), (0.1, 1, 0)), 0.05) == 200
    assert largest_budget(make((0.97, 1, 970), (0.03, 1, 0)), 0.05) == 1021  # 0.05 of it lacks: 0.03 and 0.02
    assert largest_budget(make((0.5, 1, 0)), 0.05) == 0


def test_odd_targets_and_empty_tables(spark):
    found = read_targets(targets(spark, [(" A", 0.2, None), ("a ", None, 3), (None, 0.5, 1), ("  ", 0.1, 1), ("b", -1.0, -2)]))
    assert [(t.source, t.share, t.max_repeats) for t in found] == [("a", 0.2, 3), ("b", 0.0, 0)]
    d = docs(spark, 30)
    assert mix(d.limit(0), targets(spark, TARGETS))[0].count() == 0
    mixture, plan, total = mix(d, targets(spark, TARGETS).limit(0))
    assert mixture.count() == 0 and total == 0
    assert shares(*mix(d.limit(0), targets(spark, TARGETS))).agg(F.sum("actual_share")).first()[0] == 0


def test_same_key_is_drawn_together(spark):
    d = spark.createDataFrame([(1, "hot", "a b c")] * 50, "doc_id long, source string, text string")
    mixture, _, _ = mix(d, targets(spark, [("hot", 1.0, 2)]), budget=150)
    assert {r["copies"] for r in mixture.collect()} == {1} and mixture.count() == 50
