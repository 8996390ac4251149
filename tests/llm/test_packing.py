import random
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

pytest.importorskip("fenceline.llm")

from fenceline.llm.packing import LongPatterns, fill, nonnegative_fit, pack, packing_audit, patterns, plan_packing  # noqa: E402
from fenceline.llm.tokens import with_token_counts  # noqa: E402


def checked(counts, capacity, **extra):
    plan = plan_packing(counts, capacity, **extra)
    used, load, ranks = Counter(), Counter(), Counter()
    for n, first_rank, many, first, per, _ in plan.slots:
        assert ranks[n] == first_rank  # ranks of a length follow on each other
        ranks[n] += many
        used[n] += many
        for i in range(many):
            load[first + i // per] += n
    assert used == Counter({n: c for n, c in counts.items() if c > 0})
    assert len(load) == plan.containers and max(load.values(), default=0) <= capacity
    return plan


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 63), st.integers(0, 40), max_size=30), st.sampled_from([4, 16, 64]))
def test_plans_place_every_item_once(counts, classes):
    plan = checked(counts, 64, classes=classes)
    least = -(-sum(n * c for n, c in counts.items()) // 64)
    assert plan.containers >= least


def test_plans_are_tight():
    r = random.Random(1)
    for counts in (Counter(r.randrange(1, 512) for _ in range(20_000)), Counter(min(511, int(r.expovariate(1 / 90)) + 1) for _ in range(20_000)), {200: 3000, 312: 2900, 100: 50}):
        plan = checked(dict(counts), 512)
        assert sum(n * c for n, c in counts.items()) / (plan.containers * 512) > 0.985


def test_patterns():
    found = {tuple(p) for p in patterns(6, np.array([0, 1, 1, 1, 1, 0, 1], dtype=bool))}
    assert found == {(6, 0, 0), (4, 2, 0), (3, 3, 0), (4, 1, 1), (3, 2, 1), (2, 2, 2)}
    assert len(patterns(6, np.zeros(7, dtype=bool))) == 0


def gradient(counts, fitted):
    """Of the weighted squares, by class, and the weighted counts that it starts from."""
    used = np.zeros(len(counts))
    for pattern, x in fitted.items():
        assert x >= 0 and sum(pattern) == len(counts) - 1
        np.add.at(used, list(pattern), x)
    weight = np.arange(len(counts))
    return weight * (used - counts), weight * counts


@pytest.mark.parametrize("classes", [12, 256])
def test_nonnegative_fit_is_the_least_squares_optimum(classes):
    r = np.random.default_rng(3)
    counts = r.integers(0, 100, classes + 1).astype(float)
    counts[0] = 0
    fitted = nonnegative_fit(counts, tolerance=1e-4)
    slope, start = gradient(counts, fitted)
    scale = start[patterns(classes, counts > 0)].sum(axis=1).max()
    # no pattern of any kind improves the fit, and those in it are at their best
    assert slope[patterns(classes, counts > 0)].sum(axis=1).min() >= -2e-4 * scale
    assert LongPatterns(classes, counts > 0, 24).best(-slope)[0] <= 2e-4 * scale
    assert max(abs(slope[list(p)].sum()) for p in fitted) < 1e-5 * scale


def test_the_best_long_pattern_is_the_best_of_all():
    r = np.random.default_rng(5)
    for _ in range(20):
        gain = np.concatenate([[0], r.normal(size=12)])
        present = r.random(13) < 0.7
        every = []

        def extend(pattern, rest):
            if not rest:
                every.append(pattern)
            elif len(pattern) < 5:
                for c in range(1, min(rest, pattern[-1] if pattern else rest) + 1):
                    if present[c]:
                        extend((*pattern, c), rest - c)

        extend((), 12)
        value, best = LongPatterns(12, present, 5).best(gain)
        if not every:
            assert best == ()
        else:
            assert best in every and abs(value - max(gain[list(p)].sum() for p in every)) < 1e-9


def real_lengths():
    """Lengths spread as those of texts are: few short ones, a long tail."""
    r = np.random.default_rng(11)
    return np.maximum(20, np.exp(r.normal(6.45, 1.0, 10_000))).astype(int)


@pytest.mark.parametrize("capacity", [512, 2048, 8192])
def test_patterns_place_most_items(capacity):
    counts = Counter(int(n) % capacity for n in real_lengths() if n % capacity)
    plan = checked(dict(counts), capacity)
    least = -(-sum(n * c for n, c in counts.items()) // capacity)
    by_pattern = sum(many for _, _, many, _, _, by in plan.slots if by)
    assert by_pattern >= 0.8 * sum(counts.values())
    assert plan.containers <= 1.01 * least


TEXTS = [None, "", "one", "two words", "a b c d e f g h", "word " * 40, "x y " * 333]
SPECS = [("small", 8), ("large", 64), ("none", None), ("zero", 0)]


def frames(spark, repeat=1):
    docs = spark.createDataFrame([(i, t, 1, "c") for i, t in enumerate(TEXTS * repeat)], "doc_id long, text string, n_tokens int, container_id string")
    return docs, spark.createDataFrame(SPECS + SPECS[:1], "spec_name string, capacity_tokens int")


def test_every_token_is_in_one_container(spark):
    docs, specs = frames(spark, 12)
    sizes = {r["doc_id"]: r["n_tokens"] for r in with_token_counts(docs.select("doc_id", "text"), ["doc_id"]).collect()}
    packed = pack(docs, specs)
    got = packed.collect()
    for name, capacity in SPECS[:2]:
        mine = [r for r in got if r["spec_name"] == name]
        load = Counter()
        parts = {}
        for r in mine:
            load[r["container_id"]] += r["n_tokens"]
            parts.setdefault(r["doc_id"], []).append((r["first_token"], r["n_tokens"]))
            assert (r["placed_by"] == "full") == (r["n_tokens"] == capacity)
        assert max(load.values()) <= capacity
        assert set(parts) == {d for d, n in sizes.items() if n}
        for d, p in parts.items():
            at = 0
            for first, n in sorted(p):
                assert first == at
                at += n
            assert at == sizes[d] and (len(p) == 1 or sizes[d] > capacity)
    assert {r["spec_name"] for r in got} == {"small", "large"}
    totals = {r["spec_name"]: r for r in fill(packed).collect()}
    assert totals["large"]["n_tokens"] == sum(sizes.values()) and totals["large"]["fullest"] <= 64
    held = with_token_counts(docs.select("doc_id", "text"), ["doc_id"])
    some = sum(n > 0 for n in sizes.values())
    assert sorted(tuple(r) for r in packing_audit(packed, held, specs.filter("capacity_tokens > 0")).collect()) == [("large", some, 0, 0, 0), ("small", some, 0, 0, 0)]
    # the audit sees a lost part, a repeated one and a container too full
    lost = packed.filter("not (spec_name = 'large' and doc_id = 5 and part_no = 0)")
    assert {r["spec_name"]: r["not_whole"] for r in packing_audit(lost, held, specs.filter("capacity_tokens > 0")).collect()} == {"large": 1, "small": 0}
    twice = packed.unionByName(packed.filter("spec_name = 'small' and placed_by = 'full'"))
    seen = {r["spec_name"]: r for r in packing_audit(twice, held, specs.filter("capacity_tokens > 0")).collect()}
    assert seen["small"]["overfull"] > 0 and seen["small"]["not_whole"] > 0 and seen["large"]["overfull"] == 0


@pytest.mark.parametrize("key", [None, 7])
def test_no_container_is_too_full_whatever_the_keys(spark, key):
    docs = spark.createDataFrame([(key, "word " * 1000, "a"), (key, "word " * 1000, "b"), (key, "one", "c")] * 2, "doc_id long, text string, spec string")
    specs = spark.createDataFrame([("a", 512), ("a", 256)], "spec_name string, capacity_tokens int")
    got = pack(docs, specs).collect()
    for capacity in (512, 256):
        load = Counter()
        for r in got:
            if r["capacity_tokens"] == capacity:
                load[r["container_id"]] += r["n_tokens"]
        assert max(load.values()) == capacity and sum(load.values()) == sum(r["n_tokens"] for r in got) / 2


def test_many_items_of_one_length(spark):
    docs = spark.range(5000).selectExpr("id as doc_id", "case when id % 3 = 0 then 'one two three' else repeat('a b ', 1 + int(id % 40)) end as text")
    got = pack(docs, spark.createDataFrame([("s", 64)], "spec_name string, capacity_tokens int"))
    assert got.count() == got.select("doc_id", "part_no").distinct().count()
    assert got.groupBy("container_id").agg({"n_tokens": "sum"}).filter("`sum(n_tokens)` > 64").count() == 0
    assert got.select("doc_id").distinct().count() == 5000


def test_empty_tables(spark):
    docs, specs = frames(spark)
    assert pack(docs.limit(0), specs).count() == 0
    assert pack(docs, specs.limit(0)).count() == 0
    assert pack(docs.filter("doc_id < 2"), specs).count() == 0
