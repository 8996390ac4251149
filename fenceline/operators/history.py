"""Full history of changing attributes: a bitemporal ledger from snapshots, and the versions now believed."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Callable, Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.blocked import blocked_lag, blocked_lead
from ..functions.keys import block_of
from ..session import written

#: Days of valid time that one sweep holds of one entity. See block_days_for.
BLOCK_DAYS = 7.0

#: Output rows collected before a batch is handed on.
_BATCH = 20_000


def bitemporal_ledger(
    snapshots: DataFrame, entity: str, valid_at: str, recorded_at: str, tiebreak: str, attributes: list[str], block_days: float = BLOCK_DAYS
) -> DataFrame:
    """Every belief about the attributes: (entity, valid_from, valid_to, recorded_from, recorded_to, attributes).

    A snapshot says what holds from its valid time to the entity's next snapshot. Snapshots are taken in the order in
    which they were recorded (then by tiebreak; a null time comes first). One that arrives late splits the interval it
    falls into: the earlier row ends its recorded period, nothing is overwritten, and new rows are recorded for both
    parts. One for a known valid time supersedes that row, unless it says the same. valid_to is null for what holds until
    further notice, recorded_to for what is believed now: exactly one row for each entity and valid time. A belief
    replaced in the instant of its recording is not kept. Rows without entity or valid time say nothing and are left out.
    Attributes are compared as they are, null being a value. Other columns are ignored; an empty input gives an empty
    ledger.

    Everything runs by (entity, block of valid time), so a hot entity is spread over its blocks and a task holds one block.
    What lies beyond a block's end reaches it as the few moments at which the first snapshot known there changes; these come
    from a sweep over the blocks' running minima, a row or two a block where snapshots are recorded in order or newest first.
    Blocks whose snapshots were recorded in order of valid time, one for each time, are told by two windows. Only the
    others, with late, repeated or corrected snapshots, are swept row by row, over sorted partitions.
    """
    rows = snapshots.select(
        F.col(entity).alias("e"),
        block_of(valid_at, block_days).alias("b"),
        F.col(recorded_at).alias("l"),
        F.col(tiebreak).alias("r"),
        F.col(valid_at).alias("s"),
        F.struct(*[F.col(a) for a in attributes]).alias("v"),
    ).filter("e is not null and s is not null")
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    steps = (
        _block_minima(rows)
        .repartition("e")
        .sortWithinPartitions("e", "l", "r", "b")
        .mapInArrow(_first_beyond, f"e {kinds['e']}, b bigint, l {kinds['l']}, r {kinds['r']}, s {kinds['s']}")
    )
    events = rows.withColumn("step", F.lit(False)).unionByName(steps.withColumns({"step": F.lit(True), "v": F.lit(None).cast(rows.schema["v"].dataType)}))
    by_time = Window.partitionBy("e", "b").orderBy("step", "s", "l", "r")
    recorded = F.struct("l", "r")
    before = F.lag(F.struct("step", "s", recorded.alias("at"))).over(by_time)
    amiss = before["step"] | (before["s"] == F.col("s")) | (before["at"] >= recorded)
    events = events.withColumns({"amiss": F.coalesce(amiss, F.lit(False)), "after": F.lead(F.struct("s", "l")).over(by_time)})
    events = written(events.withColumn("swept", F.max("amiss").over(Window.partitionBy("e", "b"))).drop("amiss"), "history")
    spans = "valid_from {s}, valid_to {s}, recorded_from {l}, recorded_to {l}, v {v}".format(**kinds)
    ordered = events.filter("not swept and not step").select("e", F.inline(_told_in_order(kinds["s"], kinds["l"])))
    late = events.filter("swept").select("e", "b", "l", "r", "s", "v", "step")
    swept = late.repartition("e", "b").sortWithinPartitions("e", "b", "l", "r", F.desc("step")).mapInArrow(_sweep, f"e {kinds['e']}, {spans}")
    both = ordered.select(*swept.columns).unionByName(swept)
    return both.select(F.col("e").alias(entity), "valid_from", "valid_to", "recorded_from", "recorded_to", *[F.col("v")[a].alias(a) for a in attributes])


def _told_in_order(valid: str, recorded: str) -> Column:
    """The beliefs about one snapshot when the next one, if any, was recorded after it: until further notice, then up to the next."""
    none = lambda kind: F.lit(None).cast(kind)
    row = lambda *columns: F.struct(*[c.alias(n) for c, n in zip(columns, ("valid_from", "valid_to", "recorded_from", "recorded_to", "v"))])
    s, l, v, after = F.col("s"), F.col("l"), F.col("v"), F.col("after")  # noqa: E741
    first = row(s, none(valid), l, after["l"], v)
    now = row(s, after["s"], F.when(after.isNull(), l).otherwise(after["l"]), none(recorded), v)
    replaced = after.isNotNull() & after["l"].isNotNull() & (l.isNull() | (l < after["l"]))
    return F.when(replaced, F.array(first, now)).otherwise(F.array(now))


def _block_minima(rows: DataFrame) -> DataFrame:
    """(e, b, l, r, s): for each block the moments at which its first known snapshot changes, as far as anything before it listens.

    The first of a block is always among them. Of those recorded before any earlier block of the entity had a snapshot only
    the last counts, so snapshots recorded newest first have two rows a block.
    """
    recorded = Window.partitionBy("e", "b").orderBy("l", "r", "s")
    low = F.min("s").over(recorded.rowsBetween(Window.unboundedPreceding, -1))
    minima = rows.select("e", "b", "l", "r", "s", low.alias("low")).filter("low is null or s < low")
    minima = minima.withColumn("until", F.lead(F.struct("l", "r")).over(recorded))
    earlier = Window.partitionBy("e").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    heard = rows.groupBy("e", "b").agg(F.min(F.struct("l", "r")).alias("at")).select("e", "b", F.min("at").over(earlier).alias("heard"))
    kept = F.col("low").isNull() | (F.col("heard").isNotNull() & (F.col("until").isNull() | (F.col("until") >= F.col("heard"))))
    return minima.join(heard, ["e", "b"]).filter(kept).select("e", "b", "l", "r", "s")


def versions(ledger: DataFrame, entity: str, attributes: list[str], block_days: float = BLOCK_DAYS) -> DataFrame:
    """Versions now believed: successive rows of equal attributes as one (entity, valid_from, valid_to, attributes).

    valid_to is the start of the entity's next version, null for its last.
    """
    now = ledger.filter("recorded_to is null").select(entity, "valid_from", *attributes).withColumn("_b", block_of("valid_from", block_days))
    now = written(now.withColumn("_v", F.struct(*attributes)), "believed-now")
    order = [F.col("valid_from")]
    before = blocked_lag(now, [entity], "_b", order, {"_was": "_v"})
    starts = written(before.filter(F.col("_was").isNull() | ~F.col("_was").eqNullSafe(F.col("_v"))).drop("_was", "_v"), "version-starts")
    return blocked_lead(starts, [entity], "_b", order, {"valid_to": "valid_from"}).select(entity, "valid_from", "valid_to", *attributes)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Rows as tuples, times as integers (null as None)."""
    for batch in batches:
        columns = [c.cast(pa.int64()) if pa.types.is_timestamp(c.type) else c for c in batch.columns]
        yield from zip(*[c.to_pylist() for c in columns])


def _batched(rows: Iterator[tuple], types: Callable[[], list[tuple[str, pa.DataType]]]) -> Iterator[pa.RecordBatch]:
    def made(some: list[tuple]) -> pa.RecordBatch:
        arrays = []
        for values, (_, kind) in zip(zip(*some), types()):
            time = kind is not None and pa.types.is_timestamp(kind)
            arrays.append(pa.array(values, pa.int64()).cast(kind) if time else pa.array(values, kind))
        return pa.RecordBatch.from_arrays(arrays, [name for name, _ in types()])

    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) >= _BATCH:
            yield made(held)
            held = []
    if held:
        yield made(held)


def _typed(batches: Iterator[pa.RecordBatch], sweep: Callable[[Iterator[tuple]], Iterator[tuple]], columns: list[tuple[str, str]]) -> Iterator[pa.RecordBatch]:
    """Run sweep over the rows; columns: name and the input column whose type it has."""
    known: dict[str, pa.DataType] = {}

    def watched() -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not known:
                known.update(zip(batch.schema.names, batch.schema.types))
            yield batch

    yield from _batched(sweep(_rows(watched())), lambda: [(name, known[of]) for name, of in columns])


def _before(a: int | None, b: int | None) -> bool:
    """Whether recorded time a is before b; null comes first."""
    return b is not None and (a is None or a < b)


def _block_steps(rows: Iterator[tuple]) -> Iterator[tuple]:
    """For each block the moments at which the first snapshot known beyond it changes."""
    entity, blocks, first = None, [], {}
    for e, b, at, r, s in rows:
        if e != entity:
            entity, blocks, first = e, [], {}
        i = bisect_left(blocks, b)
        if b not in first:
            if i < len(blocks):
                yield e, b, at, r, first[blocks[i]]
            blocks.insert(i, b)
        first[b] = s
        if i:
            yield e, blocks[i - 1], at, r, s


def _beliefs(rows: Iterator[tuple]) -> Iterator[tuple]:
    """Sweep each (entity, block) in recorded order."""
    group, known, beyond = None, {}, None
    order: list[int] = []

    def replaced(s: int, at: int | None, values: object, until: int | None) -> Iterator[tuple]:
        old_values, since, old_until = known[s]
        if _before(since, at):
            yield group[0], s, old_until, since, at, old_values
        known[s] = (values, at, until)

    def kept() -> Iterator[tuple]:
        for s in order:
            values, since, until = known[s]
            yield group[0], s, until, since, None, values

    for e, b, at, _, s, values, step in rows:
        if (e, b) != group:
            yield from kept()
            group, known, order, beyond = (e, b), {}, [], None
        if step:
            beyond = s
            if order and (known[order[-1]][2] is None or known[order[-1]][2] > s):
                yield from replaced(order[-1], at, known[order[-1]][0], s)
        elif s in known:
            if known[s][0] != values:
                yield from replaced(s, at, values, known[s][2])
        else:
            i = bisect_left(order, s)
            if i:
                yield from replaced(order[i - 1], at, known[order[i - 1]][0], s)
            known[s] = (values, at, order[i] if i < len(order) else beyond)
            order.insert(i, s)
    if group:
        yield from kept()


_first_beyond = partial(_typed, sweep=_block_steps, columns=[(c, c) for c in "eblrs"])
_sweep = partial(
    _typed,
    sweep=_beliefs,
    columns=[("e", "e"), ("valid_from", "s"), ("valid_to", "s"), ("recorded_from", "l"), ("recorded_to", "l"), ("v", "v")],
)
