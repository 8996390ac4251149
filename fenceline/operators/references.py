"""References to records that are missing, were deleted or arrive later."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import written

#: A key is heavy with more than one in so many of all reference rows, so there are fewer heavy keys than this.
HEAVY_ONE_IN = 1000

#: And with more rows than this: fewer are no burden for a task.
HEAVY_LEAST = 1000


@dataclass(frozen=True)
class References:
    """What refers to what. All three have the key columns; rows with a null key refer to nothing and are left out.

    rows: one row for each reference, with `at`, the time it was loaded, and any columns to return. targets: the records
    referred to, with `at`, the time each was loaded. deletions: keys that were deleted.
    """

    rows: DataFrame
    targets: DataFrame
    deletions: DataFrame
    key: tuple[str, ...]


def _known(df: DataFrame, key: tuple[str, ...]) -> DataFrame:
    return df.na.drop(subset=list(key))


def _per_key_and_period(refs: References) -> DataFrame:
    rows = _known(refs.rows, refs.key).withColumn("period", F.date_format("at", "yyyy-MM"))
    return rows.groupBy(*refs.key, "period").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("lo"), F.max("at").alias("hi"))


def _heavy_keys(refs: References, grouped: DataFrame) -> DataFrame | None:
    """The heavy keys as a local table of fewer than HEAVY_ONE_IN rows."""
    least = max(HEAVY_LEAST, refs.rows.count() // HEAVY_ONE_IN)
    heavy = grouped.groupBy(*refs.key).agg(F.sum("n").alias("n")).filter(F.col("n") > least).select(*refs.key)
    found = heavy.collect()
    return grouped.sparkSession.createDataFrame(found, heavy.schema) if found else None


def _split(df: DataFrame, key: list[str], heavy: DataFrame | None) -> tuple[DataFrame | None, DataFrame]:
    """(rows of heavy keys, the others), told apart where they are."""
    if heavy is None:
        return None, df
    few = F.broadcast(heavy)
    return df.join(few, key, "left_semi"), df.join(few, key, "left_anti")


@dataclass(frozen=True)
class _Verdicts:
    """(key, orphan_kind, first_at) of the keys that have an orphan reference; a late key's orphans are those before first_at."""

    heavy: DataFrame | None
    rest: DataFrame


def _verdicts(refs: References, grouped: DataFrame, heavy: DataFrame | None) -> _Verdicts:
    """Heavy keys are checked against the targets by broadcast, the others by a shuffled join.

    It is the anti-join and the look-up of the first load in one: keys without a target stay, and those with one that came late. A heavy key's targets and deletions are aggregated where they are, to one row a key, so all that is joined for them is
    smaller than HEAVY_ONE_IN rows.
    """
    key = list(refs.key)
    first = lambda df: df.groupBy(*key).agg(F.min("at").alias("_first_at"), F.lit(True).alias("there"))
    low = lambda df: df.groupBy(*key).agg(F.min("lo").alias("lo"))
    seen, gone = _known(refs.targets, refs.key).select(*key, "at"), _known(refs.deletions, refs.key).select(*key)
    parts = [_split(df, key, heavy) for df in (grouped, seen, gone)]
    (many, keyed), (many_seen, seen), (many_gone, gone) = parts
    out = {"heavy": None}
    for name, mine, there, deleted, hint in (("heavy", many, many_seen, many_gone, F.broadcast), ("rest", keyed, seen, gone, lambda df: df)):
        if mine is None:
            continue
        found = low(mine).join(hint(first(there)), key, "left").join(hint(deleted.distinct().withColumn("gone", F.lit(True))), key, "left")
        kind = F.when(F.col("there").isNull(), F.when(F.col("gone"), "deleted").otherwise("missing")).when(F.col("lo") < F.col("_first_at"), "late")
        out[name] = found.withColumn("orphan_kind", kind).filter("orphan_kind is not null").select(*key, "orphan_kind", "_first_at")
    return _Verdicts(**out)


def _of_keys(rows: DataFrame, wanted: _Verdicts, key: list[str], heavy: DataFrame | None) -> DataFrame:
    """rows joined with the verdicts on their keys: those of heavy keys by broadcast, their rows staying where they are, the rest by shuffle."""
    many, others = _split(rows, key, heavy)
    rest = others.join(wanted.rest, key)
    return rest if many is None else many.join(F.broadcast(wanted.heavy), key).unionByName(rest)  # fewer than HEAVY_ONE_IN rows


def orphan_rows(refs: References) -> DataFrame:
    """Each orphan reference: the columns of refs.rows and orphan_kind, 'missing', 'deleted' or 'late'.

    A reference is an orphan if no target has its key ('deleted' if the key was deleted, else 'missing'), or if the first
    target with its key was loaded after the reference itself ('late'). A null load time is never late and makes nothing
    late. Repeated rows are returned each. Without targets every reference is an orphan; without references there is none.
    Other columns of targets and deletions are ignored.

    References are pre-aggregated by key and period into a written table, so that targets are looked up once a key. Heavy
    keys are checked by broadcast, the others by a shuffled anti-join (see _verdicts); rows are then taken by the keys that
    have orphans: those of heavy keys where they are, by a broadcast of less than HEAVY_ONE_IN rows, the others by a shuffled
    join; both are put together.
    """
    key = list(refs.key)
    grouped = written(_per_key_and_period(refs), "references")
    heavy = _heavy_keys(refs, grouped)
    hits = _of_keys(_known(refs.rows, refs.key), _verdicts(refs, grouped, heavy), key, heavy)
    return hits.filter("orphan_kind <> 'late' or at < _first_at").drop("_first_at")


def orphan_counts(refs: References) -> DataFrame:
    """(period, orphan_kind, n_orphans) for each month of the references' load time; null for a null time.

    Counted from the sums by key and period, those of heavy keys and of the others each by their verdicts, both put together;
    only months in which a key's first target arrives are counted by row.
    """
    key = list(refs.key)
    grouped = written(_per_key_and_period(refs), "references")
    heavy = _heavy_keys(refs, grouped)
    verdicts = _verdicts(refs, grouped, heavy)
    judged = _of_keys(grouped, verdicts, key, heavy)
    late = F.col("orphan_kind") == "late"
    whole = judged.filter(~late | (F.col("hi") < F.col("_first_at"))).select("period", "orphan_kind", "n")
    straddles = late & (F.col("lo") < F.col("_first_at")) & (F.col("hi") >= F.col("_first_at"))

    def months(part: DataFrame | None, verdict: DataFrame | None) -> DataFrame | None:
        if part is None:
            return None
        return part.join(verdict, key).filter(straddles).select(*key, "orphan_kind", F.col("period").alias("_p"), "_first_at")

    many, others = _split(grouped, key, heavy)
    split = _Verdicts(months(many, verdicts.heavy), months(others, verdicts.rest))
    rows = _known(refs.rows, refs.key).select(*key, "at")
    part = _of_keys(rows, split, key, heavy).filter(F.col("_p").eqNullSafe(F.date_format("at", "yyyy-MM")) & (F.col("at") < F.col("_first_at")))
    # a late key's rows without a time are in no month and never late
    counts = whole.unionByName(part.select(F.col("_p").alias("period"), "orphan_kind", F.lit(1).cast("long").alias("n")))
    return counts.groupBy("period", "orphan_kind").agg(F.sum("n").alias("n_orphans"))
