"""Resumable, ordered processing: stages that run once, and iteration over items from a stored cursor."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field
from enum import Enum

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.blocked import blocked_running
from ..sources.stores import Checkpoint, CheckpointStore, LeaseStore
from .validate import check_value, type_name, value_from_json, value_to_json

#: Lease that a check of the lock renews for, in microseconds.
RENEWAL = 300_000_000


class LockStolen(RuntimeError):
    """A write was made under a token that is no longer the lock's."""


def remaining(items: DataFrame, item_id: str, cursor: str | None) -> DataFrame:
    """Items after the cursor, ids compared as text; all of them without a cursor."""
    return items if cursor is None else items.filter(F.col(item_id) > F.lit(cursor))


def page(items: DataFrame, item_id: str, cursor: str | None, size: int) -> DataFrame:
    """The next items after the cursor, by a keyset: a top-k, not a sort of everything."""
    return remaining(items, item_id, cursor).orderBy(item_id).limit(size)


def pages(items: DataFrame, item_id: str, size: int, block: Column) -> DataFrame:
    """items with their page number in order of the id. block: a column that doesn't decrease in that order and keeps blocks small.

    Items are numbered inside blocks, blocks by their sizes; no task sees the whole order.
    """
    ranked = blocked_running(items.withColumns({"_b": block, "_one": F.lit(1), "_all": F.lit(0)}), ["_all"], "_b", [F.col(item_id)], {"_rank": ("count", "_one")})
    return ranked.withColumn("page", F.floor((F.col("_rank") - 1) / F.lit(size))).drop("_b", "_one", "_all", "_rank")


def fold(
    items: DataFrame, key: list[str], order: list[str], value: str, start: object, step: Callable[[object, object], object], kind: str = "long", stored: DataFrame | None = None
) -> DataFrame:
    """(key, state): the ordered left fold of a key's items, state = step(state, value), from start or from a stored state.

    step is Python, as the fold's steps depend on each other; kind is the state's type. stored: (key, state) to go on from; its
    keys are returned even without new items. Items with a null in key belong to nothing. Rows are sorted by key and order
    inside partitions and streamed: a task holds one state, not a key's items. Sums, minima, maxima and the like are
    blocked_running's, which splits a hot key too.
    """
    first = items.select(*key, *order, F.col(value).alias("_value"), F.lit(None).cast(kind).alias("_state"), F.lit(1).alias("_side"))
    if stored is not None:
        nothing = [F.lit(None).cast(items.schema[c].dataType).alias(c) for c in order]
        before = stored.select(*key, *nothing, F.lit(None).cast(items.schema[value].dataType).alias("_value"), F.col("state").cast(kind).alias("_state"), F.lit(0).alias("_side"))
        first = first.unionByName(before)
    for c in key:
        first = first.filter(F.col(c).isNotNull())
    rows = first.repartition(*key).sortWithinPartitions(*key, "_side", *order).select(*key, "_side", "_state", "_value")
    fields = [*[(f.name, f.dataType.simpleString()) for f in rows.schema.fields[: len(key)]], ("state", kind)]
    names, n = [name for name, _ in fields], len(key)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types: list[pa.DataType] = []
        done: list[tuple] = []
        now, state = None, None

        def made() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done), types)], names)
            done.clear()
            return out

        for batch in batches:
            types = [*batch.schema.types[:n], batch.schema.types[n + 1]]
            for row in zip(*[c.to_pylist() for c in batch.columns]):
                if row[:n] != now:
                    if now is not None:
                        done.append((*now, state))
                    now, state = row[:n], start
                state = step(state, row[n + 2]) if row[n] else row[n + 1]
            if len(done) >= 10_000:
                yield made()
        if now is not None:
            done.append((*now, state))
            yield made()

    return rows.mapInArrow(run, ", ".join(f"`{name}` {kind}" for name, kind in fields))


@dataclass
class JobContext:
    """What a job's code gets: its run, its token, and stages whose progress outlives a crash.

    Every write is fenced: it raises LockStolen unless the token is the lock's. An item's action runs before its progress
    is saved, so after a crash in between it runs again; its idempotency key is the same then.
    """

    job_name: str
    run_id: str
    token: int
    leases: LeaseStore
    checkpoints: CheckpointStore
    now: Callable[[], int]
    method: str | None = None
    key_prefix: str = "fl"
    items_processed: int = 0
    #: Told after each item ("on_item_processed") and each stored checkpoint ("on_checkpoint_saved").
    tell: Callable[..., None] = lambda event, *args: None
    is_resume: bool = field(init=False)
    item_id: str | None = field(default=None, init=False)

    def __post_init__(self) -> None:
        self.is_resume = self.checkpoints.any(self.job_name, self.run_id)

    def idempotency_key(self) -> str | None:
        """Key of the item being processed; None outside an item."""
        if self.item_id is None:
            return None
        parts = [self.key_prefix, self.run_id or str(self.token), self.item_id]
        return "_".join(parts + ([self.method] if self.method else []))

    def step(self, stage: Enum | str, supplier: Callable[[], object] | None = None) -> object:
        """Run once; later give the stored value back without running."""
        name = stage_name(stage)
        known = self.checkpoints.load(self.job_name, self.run_id, name)
        if known and known.status == "COMPLETE":
            return value_from_json(known.stored_value, known.value_type)
        value = supplier() if supplier else None
        check_value(value)
        self._save(name, "COMPLETE", value_to_json(value), type_name(value))
        return value

    def for_each(self, stage: Enum | str, items: Iterable, id_of: Callable[[object], str], action: Callable[[object], None]) -> None:
        """action for each item after the stored cursor; items are in order of their ids."""
        self._walk(stage, items, id_of, lambda item, state: (action(item), state)[1], None, False)

    def fold_each(self, stage: Enum | str, items: Iterable, id_of: Callable[[object], str], start: object, action: Callable[[object, object], object]) -> object:
        """A left fold over the items after the cursor from the stored state; a finished fold gives its state back."""
        return self._walk(stage, items, id_of, action, start, True)

    def for_each_page(self, stage: Enum | str, load: Callable[[str | None], list], id_of: Callable[[object], str], action: Callable[[object], None]) -> None:
        """Pages from load(cursor) until one is empty. The loader alone decides what comes after a cursor."""
        self._pages(stage, load, id_of, lambda item, state: (action(item), state)[1], None, False)

    def fold_each_page(self, stage: Enum | str, load: Callable[[str | None], list], id_of: Callable[[object], str], start: object, action: Callable[[object, object], object]) -> object:
        return self._pages(stage, load, id_of, action, start, True)

    def is_stage_complete(self, stage: Enum | str) -> bool:
        known = self.checkpoints.load(self.job_name, self.run_id, stage_name(stage))
        return bool(known) and known.status == "COMPLETE"

    def complete_stage(self, stage: Enum | str) -> None:
        self._save(stage_name(stage), "COMPLETE", None, None)

    def assert_still_held(self) -> None:
        if not self.leases.renew(self.job_name, self.token, self.now(), RENEWAL):
            raise LockStolen(f"{self.job_name}: the lock is no longer held under token {self.token}")

    def _progress(self, name: str) -> tuple[bool, str | None, str | None, str | None]:
        """Whether the stage is complete, its cursor, and its state with the state's type."""
        known = self.checkpoints.load(self.job_name, self.run_id, name)
        if not known:
            return False, None, None, None
        stored = json.loads(known.stored_value) if known.stored_value else {}
        state = stored.get("state")
        return known.status == "COMPLETE", stored.get("lastId"), None if state is None else json.dumps(state), stored.get("stateType")

    def _one(self, item: object, item_id: str, action: Callable, state: object) -> object:
        self.item_id = item_id
        try:
            state = action(item, state)
        finally:
            self.item_id = None
        self.items_processed += 1
        self.tell("on_item_processed", self.job_name)
        return state

    def _store(self, name: str, status: str, last: str | None, state: object, folds: bool) -> None:
        doc: dict = {"lastId": last}
        if folds:
            check_value(state)
            doc |= {"state": json.loads(value_to_json(state) or "null"), "stateType": type_name(state)}
        self._save(name, status, json.dumps(doc) if folds or status != "COMPLETE" else None, type_name(state) if folds else None)

    def _walk(self, stage: Enum | str, items: Iterable, id_of: Callable, action: Callable, state: object, folds: bool) -> object:
        name = stage_name(stage)
        complete, last, stored, kind = self._progress(name)
        if stored is not None and folds:
            state = value_from_json(stored, kind)
        if complete:
            return state
        for item in items:
            item_id = id_of(item)
            if last is not None and item_id <= last:
                continue
            state = self._one(item, item_id, action, state)
            last = item_id
            self._store(name, "IN_PROGRESS", last, state, folds)
        self._store(name, "COMPLETE", last, state, folds)
        return state

    def _pages(self, stage: Enum | str, load: Callable, id_of: Callable, action: Callable, state: object, folds: bool) -> object:
        name = stage_name(stage)
        complete, last, stored, kind = self._progress(name)
        if stored is not None and folds:
            state = value_from_json(stored, kind)
        while not complete:
            some = load(last)
            if not some:
                break
            for item in some:
                last = id_of(item)
                state = self._one(item, last, action, state)
                self._store(name, "IN_PROGRESS", last, state, folds)
        if not complete:
            self._store(name, "COMPLETE", last, state, folds)
        return state

    def _save(self, stage: str, status: str, stored: str | None, kind: str | None) -> None:
        if self.leases.token(self.job_name) != self.token:
            raise LockStolen(f"{self.job_name}: {self.token} is not the lock's token")
        if self.checkpoints.save(Checkpoint(self.job_name, self.run_id, stage, status, stored, kind, self.token, self.now())):
            self.tell("on_checkpoint_saved", self.job_name)


def stage_name(stage: Enum | str) -> str:
    return f"{type(stage).__name__}.{stage.name}" if isinstance(stage, Enum) else stage
