"""Mixing sources to target weights by hash thresholds."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.keys import clean_name
from ..session import written
from .tokens import VOCABULARY, with_token_counts

#: A document's place in the draw has LEVELS groups of BUCKET_BITS binary digits. Documents of one place, which among 2 ** 30
#: documents about one pair has, are drawn together.
BUCKET_BITS = 12
LEVELS = 5

_PLACE_BITS = BUCKET_BITS * LEVELS


@dataclass
class Target:
    """One source of a mixture; tokens and docs are what it has, budget what it shall give."""

    source: str
    share: float
    max_repeats: int
    tokens: int = 0
    docs: int = 0
    budget: int = 0
    full_copies: int = 0
    #: Documents whose place is below this get one copy more.
    threshold: int = 0


def read_targets(targets: DataFrame) -> list[Target]:
    """The targets by clean name; entries that name the same source add their shares, the larger cap holds. A null or
    negative share counts as 0, a null cap as 1."""
    found: dict[str, Target] = {}
    for r in targets.select(clean_name("source").alias("source"), "target_share", "max_repeats").collect():
        if r["source"] is None:
            continue
        share, cap = max(0.0, r["target_share"] or 0.0), 1 if r["max_repeats"] is None else max(0, r["max_repeats"])
        known = found.get(r["source"])
        found[r["source"]] = Target(r["source"], share + (known.share if known else 0.0), max(cap, known.max_repeats if known else 0))
    return sorted(found.values(), key=lambda t: t.source)


def largest_budget(targets: list[Target], shortfall: float) -> int:
    """The largest total for which at most a part `shortfall` of it can't be given by the sources it is asked from.

    If sources without any documents miss more than that alone, the largest total that all the others can give their share
    of.
    """
    some = [(t.tokens * t.max_repeats, t.share) for t in targets if t.share > 0]
    full = [cap / share for cap, share in some if cap]
    if not full:
        return 0
    if sum(share for cap, share in some if not cap) >= shortfall:
        return int(min(full))
    low, high = min(full), sum(cap for cap, _ in some) / (1 - shortfall) + 1
    for _ in range(200):
        mid = (low + high) / 2
        short = sum(max(0.0, share - cap / mid) for cap, share in some)
        low, high = (mid, high) if short <= shortfall else (low, mid)
    return int(low)


def place(key: str, seed: int) -> Column:
    """A document's place in the draw: a whole number from 0, spread evenly, always the same for a key."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col(key)), 64 - _PLACE_BITS)


def _set_thresholds(spark: SparkSession, placed: DataFrame, targets: list[Target]) -> None:
    """Find for each target the place below which documents sum to what its full copies leave of its budget.

    Tokens are summed by source and bucket of the place; only the bucket in which the sum passes the budget is cut into
    finer ones, level by level. At most targets * 2 ** BUCKET_BITS sums come to the driver at a time.
    """
    open_ = {}
    for t in targets:
        rest = t.budget - t.full_copies * t.tokens
        if rest >= t.tokens or t.full_copies >= t.max_repeats:
            t.threshold = 0
        elif rest > 0:
            open_[t.source] = (t, rest, 0)
    for level in range(LEVELS):
        if not open_:
            return
        shift = _PLACE_BITS - BUCKET_BITS * (level + 1)
        borders = spark.createDataFrame([(s, prefix) for s, (_, _, prefix) in open_.items()], "source string, prefix long")
        prefix = F.shiftright("place", shift + BUCKET_BITS) if level else F.lit(0).cast("long")
        inside = placed.withColumn("prefix", prefix).join(F.broadcast(borders), ["source", "prefix"])  # a row a target
        sums = inside.groupBy("source", F.shiftright("place", shift).alias("bucket")).agg(F.sum("n_tokens").alias("n"), F.count(F.lit(1)).alias("docs"))
        found: dict[str, list] = {s: [] for s in open_}
        for r in sums.collect():
            found[r["source"]].append((r["bucket"], r["n"], r["docs"]))
        for source, (t, rest, _) in list(open_.items()):
            for bucket, n, docs in sorted(found[source]):
                if n > rest:
                    t.threshold = bucket << shift
                    open_[source] = (t, rest, bucket)
                    if docs == 1 or rest == 0:
                        if n - rest < rest:  # closer with this document than without
                            t.threshold = (bucket + 1) << shift
                        del open_[source]
                    break
                rest -= n
                t.threshold = (bucket + 1) << shift
            else:
                del open_[source]


def mix(docs: DataFrame, targets: DataFrame, key: str = "doc_id", budget: int | None = None, shortfall: float = 0.0, seed: int = 0, vocabulary: str = VOCABULARY) -> tuple[DataFrame, list[Target], int]:
    """Draw documents so that each source gives its target share of all tokens: (mixture, targets with budgets, total).

    mixture: (key, source, n_tokens, copies), copies from 1 to the source's max_repeats. A source gives share * budget
    tokens, to the nearest document, or, where it has too little, all it has max_repeats times; what it then lacks isn't
    made up by others. Without a budget it is the largest for which at most `shortfall` of it lacks (see
    largest_budget): by default every source that has documents gives its share, and the least able one bounds the total. Thresholds are nested: with the same seed a smaller budget draws a subset. Sources are compared
    trimmed and ignoring case. Documents without a source, or with one that has no target, are not drawn; null and empty
    texts have 0 tokens and add nothing; copies of a text are documents of their own, rows with the same key are drawn
    together. Empty tables give an empty mixture.

    Tokens are counted once, into a written table. Sums by (source, bucket) are pre-aggregated, so a source with a third
    of all documents is no more than its buckets; documents are filtered in place, without a sort or a shuffle.
    """
    spark = docs.sparkSession
    wanted = read_targets(targets)
    named = docs.withColumn("_source", clean_name("source")).filter(F.col("_source").isin([t.source for t in wanted]))
    counted = written(with_token_counts(named, [key, "_source"], vocabulary=vocabulary), "mix-tokens")
    placed = counted.select(F.col(key).alias("k"), F.col("_source").alias("source"), "n_tokens", place(key, seed).alias("place"))
    have = {r["source"]: r for r in placed.groupBy("source").agg(F.sum("n_tokens").alias("n"), F.count(F.lit(1)).alias("docs")).collect()}
    for t in wanted:
        if t.source in have:
            t.tokens, t.docs = have[t.source]["n"], have[t.source]["docs"]
    total = largest_budget(wanted, shortfall) if budget is None else budget
    for t in wanted:
        t.budget = min(int(t.share * total), t.tokens * t.max_repeats)
        t.full_copies = min(t.budget // t.tokens, t.max_repeats) if t.tokens else 0
    _set_thresholds(spark, placed, wanted)
    plan = spark.createDataFrame([(t.source, t.full_copies, t.threshold) for t in wanted], "source string, full_copies int, threshold long")
    copies = F.col("full_copies") + (F.col("place") < F.col("threshold")).cast("int")
    mixture = placed.join(F.broadcast(plan), "source").withColumn("copies", copies).filter("copies > 0")  # plan: a row a target
    return mixture.select(F.col("k").alias(key), "source", "n_tokens", "copies"), wanted, total


def shares(mixture: DataFrame, targets: list[Target], total: int) -> DataFrame:
    """What each source was asked for and what it gives, counted from the mixture itself."""
    spark = mixture.sparkSession
    asked = spark.createDataFrame(
        [(t.source, t.share, t.max_repeats, t.docs, t.tokens, int(t.share * total)) for t in targets],
        "source string, target_share double, max_repeats int, n_docs long, n_tokens long, asked_tokens long",
    )
    given = mixture.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("copies")).alias("given_tokens"), F.count(F.lit(1)).alias("docs_used"), F.max("copies").alias("most_copies"))
    joined = asked.join(given, "source", "left").na.fill(0, ["given_tokens", "docs_used", "most_copies"])
    everything = given.agg(F.sum("given_tokens").alias("all_tokens"))
    joined = joined.withColumn("one", F.lit(1)).join(F.broadcast(everything.withColumn("one", F.lit(1))), "one", "left")  # one row
    share = F.when(F.col("all_tokens") > 0, F.col("given_tokens") / F.col("all_tokens")).otherwise(F.lit(0.0))
    return joined.withColumn("actual_share", share).drop("one", "all_tokens")


def mixture_audit(mixture: DataFrame, targets: list[Target], docs: DataFrame, sizes: DataFrame, key: str = "doc_id") -> DataFrame:
    """(source, n_docs, too_often, not_theirs, off_budget) of each target: the documents it has, and three counts that must be 0.

    sizes: (key, n_tokens); keys are unique. too_often: documents used more than max_repeats times; not_theirs: documents drawn
    that are of another source; off_budget: 1 if what the source gives is off its budget by more than half of its longest document.
    """
    spark = mixture.sparkSession
    asked = spark.createDataFrame([(t.source, t.max_repeats, t.budget) for t in targets], "source string, max_repeats int, budget long")
    own = docs.select(F.col(key), clean_name("source").alias("own")).join(sizes, key)
    has = own.groupBy(F.col("own").alias("source")).agg(F.count(F.lit(1)).alias("n_docs"), F.max("n_tokens").alias("longest"))
    drawn = mixture.join(own.select(key, "own"), key).join(F.broadcast(asked), "source")  # asked: a row a target
    given = drawn.groupBy("source").agg(
        F.sum(F.col("n_tokens") * F.col("copies")).alias("given"),
        F.count(F.when(F.col("copies") > F.col("max_repeats"), 1)).alias("too_often"),
        F.count(F.when(~F.col("own").eqNullSafe(F.col("source")), 1)).alias("not_theirs"),
    )
    both = asked.join(has, "source", "left").join(given, "source", "left").na.fill(0)
    off = (F.abs(F.col("given") - F.col("budget")) * 2 > F.col("longest")).cast("int")
    return both.select("source", "n_docs", "too_often", "not_theirs", off.alias("off_budget"))
