"""Filling containers of fixed capacity by length patterns."""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections import defaultdict
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import written
from .tokens import VOCABULARY, with_token_counts

#: Length classes in which patterns are fitted.
CLASSES = 256

#: Documents that one pattern holds at most.
MOST_ITEMS = 24

#: The fit ends when no pattern would improve it by more than this part of what the first one did.
TOLERANCE = 1e-3

#: Items of one length are numbered in so many parts, so that a length isn't one task's.
SALTS = 64

#: A plan with more rows isn't broadcast. Plans are bounded by the capacity, not by the number of items.
BROADCAST_ROWS = 500_000


@dataclass
class Plan:
    """Where the items of each length go: (length, first rank, ranks, first container, items of it in a container, by pattern)."""

    slots: list[tuple[int, int, int, int, int, bool]] = field(default_factory=list)
    containers: int = 0


def patterns(classes: int, present: np.ndarray) -> np.ndarray:
    """All ways in which one, two or three classes that are present sum to `classes`: (n, 3), 0 for no item."""
    sizes = np.flatnonzero(present)
    sizes = sizes[sizes > 0]
    here = np.zeros(classes + 1, dtype=bool)
    here[sizes] = True
    out = [(classes, 0, 0)] if here[classes] else []
    for a in sizes:
        rest = classes - a
        if 0 < rest <= a and here[rest]:
            out.append((a, rest, 0))
        b = sizes[(sizes <= a) & (sizes < rest) & (sizes >= (rest + 1) // 2)]
        c = rest - b
        fits = here[c] & (c <= b)
        out += zip([a] * int(fits.sum()), b[fits], c[fits])
    return np.array(out, dtype=np.int64).reshape(-1, 3)


class LongPatterns:
    """The patterns of more documents, too many to list: finds the best of all by the gains of their classes."""

    def __init__(self, classes: int, present: np.ndarray, most_items: int) -> None:
        self.sizes = np.flatnonzero(present)
        self.sizes = self.sizes[self.sizes > 0]
        rest = np.arange(classes + 1)[:, None] - self.sizes[None, :]
        self.rest, self.fits = np.maximum(rest, 0), rest >= 0
        self.classes, self.most_items = classes, most_items

    def best(self, gain: np.ndarray) -> tuple[float, tuple[int, ...]]:
        """The pattern of at most most_items classes with the highest sum of gains: best sum by total and number of items."""
        own = np.where(self.fits, gain[self.sizes], -np.inf)
        value = np.full(self.classes + 1, -np.inf)
        value[0] = 0.0
        picks, ends = [], []
        for _ in range(self.most_items):
            sums = value[self.rest] + own
            pick = sums.argmax(axis=1)
            value = sums[np.arange(len(sums)), pick]
            picks.append(pick)
            ends.append(value[self.classes])
        items = int(np.argmax(ends)) + 1
        if not len(self.sizes) or ends[items - 1] == -np.inf:
            return -np.inf, ()
        out, total = [], self.classes
        for pick in reversed(picks[:items]):
            out.append(int(self.sizes[pick[total]]))
            total -= out[-1]
        return float(ends[items - 1]), tuple(sorted(out, reverse=True))


def nonnegative_fit(counts: np.ndarray, most_items: int = MOST_ITEMS, tolerance: float = TOLERANCE, most_rounds: int = 3000) -> dict[tuple[int, ...], float]:
    """How often to repeat each pattern so that the classes used come close to counts: least squares without negatives.

    The active-set method: the pattern that improves the fit most joins the set, the set is fitted freely, and what turns
    negative leaves it at the first zero on the way. It ends when no pattern is left that improves the fit. Patterns of up to
    three classes are listed; longer ones are looked for when none of these helps. Classes are weighted by length, as that
    is what is left unused.
    """
    classes = len(counts) - 1
    weight = np.sqrt(np.arange(classes + 1, dtype=float))
    target = counts * weight
    listed = patterns(classes, counts > 0)
    longer = LongPatterns(classes, counts > 0, most_items)
    names: list[tuple[int, ...]] = []
    matrix, x = np.zeros((classes + 1, 0)), np.zeros(0)
    floor, barred = None, set()
    for _ in range(most_rounds):
        gain = weight * (target - matrix @ x)
        value, name = -np.inf, ()
        if len(listed):
            k = int((sums := gain[listed].sum(axis=1)).argmax())
            value, name = float(sums[k]), tuple(int(u) for u in listed[k] if u)
        if floor is None or value <= floor or name in barred:
            value, name = longer.best(gain)
            if floor is None:
                floor = max(tolerance * value, 1e-9)
        if value <= floor or name in barred:
            break
        column = np.zeros(classes + 1)
        np.add.at(column, list(name), 1.0)
        names, matrix, x = [*names, name], np.column_stack([matrix, column * weight]), np.append(x, 0.0)
        while len(x):
            inner = matrix.T @ matrix
            inner[np.diag_indices_from(inner)] *= 1 + 1e-10
            solved = np.linalg.solve(inner, matrix.T @ target)
            bad = solved <= 0
            if not bad.any():
                x = solved
                break
            step = np.min(x[bad] / (x[bad] - solved[bad] + 1e-300))
            x = np.maximum(x + step * (solved - x), 0.0)
            stays = ~(bad & (x <= 1e-9))
            if not stays[-1]:
                barred.add(name)  # takes no part, by the limits of the arithmetic: not tried again
            names, matrix, x = [n for n, s in zip(names, stays) if s], matrix[:, stays], x[stays]
    return dict(zip(names, x))


def plan_packing(counts: dict[int, int], capacity: int, classes: int = CLASSES) -> Plan:
    """Containers for counts[length] items of each length up to capacity.

    Lengths are rounded to the nearest of equal classes, patterns of classes that fill a container are fitted to the classes'
    counts, and repeat counts are rounded. The items of a pattern are taken from its classes, but for the last one, which
    is the longest item left that fits: so lengths need not be those of the classes to fill a container. The items that no
    pattern takes are packed by length, longest first, each into the fullest container that still has room. All containers of
    a kind are made at a time, so the work is bounded by the capacity, whatever the counts.
    """
    plan = Plan()
    whole = min(classes, capacity)
    stock = _Stock({n: c for n, c in counts.items() if 0 < n <= capacity and c > 0}, capacity, whole)
    rooms: list[tuple[int, int, int]] = []
    fitted = nonnegative_fit(stock.per_class.astype(float)) if stock.lengths else {}
    for pattern, repeats in sorted(fitted.items(), key=lambda p: (-p[1], p[0])):
        taken = pattern[:-1] or pattern
        often = min(int(repeats + 0.5), *[int(stock.per_class[u]) // taken.count(u) for u in taken])
        if often <= 0:
            continue
        runs = [(plan.containers, often, capacity)]
        for u in taken:
            runs = _fill_runs(plan, stock, runs, u)
        if len(pattern) > 1:
            runs = _fill_runs(plan, stock, runs)
        plan.containers += often
        rooms += [(room, first, many) for first, many, room in runs]
    _pack_rest(stock.left, stock.taken, capacity, plan, rooms)
    return plan


class _Stock:
    """The items not yet placed, by length and class."""

    def __init__(self, counts: dict[int, int], capacity: int, whole: int) -> None:
        self.left, self.taken = dict(counts), dict.fromkeys(counts, 0)
        self.lengths = sorted(counts)
        self.class_of = {n: max(1, (2 * n * whole + capacity) // (2 * capacity)) for n in counts}
        self.per_class = np.zeros(whole + 1, dtype=np.int64)
        self._by_class: dict[int, list[int]] = defaultdict(list)
        for n in self.lengths:  # the longest last
            self.per_class[self.class_of[n]] += counts[n]
            self._by_class[self.class_of[n]].append(n)

    def take(self, n: int, most: int) -> tuple[int, int, int]:
        """(length, first rank, items), at most so many."""
        some, first = min(most, self.left[n]), self.taken[n]
        self.left[n] -= some
        self.taken[n] += some
        self.per_class[self.class_of[n]] -= some
        if not self.left[n]:
            self.lengths.pop(bisect_left(self.lengths, n))
        return n, first, some

    def get(self, need: int, room: int, u: int | None = None) -> tuple[int, int, int] | None:
        """The longest of a class, or, where that doesn't fit or no class is asked for, the longest of all that fits."""
        if u is not None:
            lengths = self._by_class[u]
            while lengths and not self.left[lengths[-1]]:
                lengths.pop()
            if lengths and lengths[-1] <= room:
                return self.take(lengths[-1], need)
        i = bisect_right(self.lengths, room)
        return self.take(self.lengths[i - 1], need) if i else None


def _fill_runs(plan: Plan, stock: _Stock, runs: list[tuple[int, int, int]], u: int | None = None) -> list[tuple[int, int, int]]:
    """One item more, of class u if possible, in each container of runs (first container, how many, room in each) that has room; the runs after."""
    out = []
    for first, many, room in runs:
        while many:
            got = stock.get(many, room, u)
            if got is None:
                out.append((first, many, room))
                break
            n, rank, some = got
            plan.slots.append((n, rank, some, first, 1, True))
            out.append((first, some, room - n))
            first, many = first + some, many - some
    return out


def _pack_rest(left: dict[int, int], taken: dict[int, int], capacity: int, plan: Plan, known: list[tuple[int, int, int]]) -> None:
    """Longest first into the fullest container with room. open_: by room left, runs (first container, how many) alike."""
    open_: dict[int, list[tuple[int, int]]] = defaultdict(list)
    rooms: list[int] = []

    def add(room: int, first: int, many: int) -> None:
        if room > 0 and many > 0:
            if not open_[room]:
                insort(rooms, room)
            open_[room].append((first, many))

    for room, first, many in known:
        add(room, first, many)
    for n in sorted(left, reverse=True):
        count = left[n]
        while count > 0:
            i = bisect_left(rooms, n)
            if i == len(rooms):
                each = capacity // n
                full, rest = divmod(count, each)
                for many, items in ((full, each), (1 if rest else 0, rest)):
                    if many:
                        plan.slots.append((n, taken[n], many * items, plan.containers, items, False))
                        taken[n] += many * items
                        add(capacity - items * n, plan.containers, many)
                        plan.containers += many
                break
            room = rooms[i]
            first, many = open_[room].pop()
            if not open_[room]:
                rooms.pop(i)
            each = min(room // n, max(1, count // many))
            if count < many:
                add(room, first + count, many - count)
                many = count
            plan.slots.append((n, taken[n], many * each, first, each, False))
            taken[n] += many * each
            count -= many * each
            add(room - each * n, first, many)


def _plan_tables(spark: SparkSession, specs: list[tuple[str, int]], counts: dict[int, dict[int, int]]) -> tuple[DataFrame, DataFrame]:
    """(spec, n_tokens, step) and (spec, n_tokens, bucket, slot...): the plans, with ranks in buckets of step, as many as slots.

    A slot is listed in each bucket that it meets, so the ranks of a length meet two rows each on average, however many slots
    the length has.
    """
    steps, rows = [], []
    for i, (_, capacity) in enumerate(specs):
        plan = plan_packing({n: c for n, c in counts[i].items() if n < capacity}, capacity)
        by_length: dict[int, list[tuple]] = defaultdict(list)
        for n, rank, many, first, per, by_pattern in plan.slots:
            by_length[n].append((rank, rank + many, first, per, "pattern" if by_pattern else "residual"))
        if full := counts[i].get(capacity):
            by_length[capacity] = [(0, full, 0, 1, "full")]
        for n, slots in by_length.items():
            step = -(-slots[-1][1] // len(slots))
            steps.append((i, n, step))
            rows += [(i, n, b, *slot) for slot in slots for b in range(slot[0] // step, (slot[1] - 1) // step + 1)]
    step_table = spark.createDataFrame(steps, "spec int, n_tokens long, step long")
    plan_table = spark.createDataFrame(rows, "spec int, n_tokens long, bucket long, rank_from long, rank_to long, first long, per long, placed_by string")
    return F.broadcast(step_table), F.broadcast(plan_table) if len(rows) <= BROADCAST_ROWS else plan_table  # step_table: the lengths up to each capacity


def pack(docs: DataFrame, specs: DataFrame, key: str = "doc_id", vocabulary: str = VOCABULARY) -> DataFrame:
    """(spec_name, capacity_tokens, container_id, key, part_no, first_token, n_tokens, placed_by): every token of every document in one container.

    For each specification (spec_name, capacity_tokens) all documents are packed anew; one name with two capacities is two
    specifications. A document of at most the capacity is one item; a longer one is cut into items of the capacity, each a
    container by itself, and the rest, if any. Null and empty texts have no tokens and are in no container; specifications
    without a name or a positive capacity are left out. Rows with the same or no key are packed each: no container holds more
    than its capacity. Empty tables give an empty result. placed_by says how an item came to its container: 'full' for
    items of the capacity, 'pattern', or 'residual' for what no pattern took.

    Tokens are counted once, into a written table. The driver gets the number of items of each length, at most the
    capacity's rows a specification, and plans from that; items are then numbered inside their length and looked up in
    the plan. A length is numbered in SALTS parts, so one with a third of all items isn't one task's.
    """
    spark = docs.sparkSession
    named = specs.select("spec_name", "capacity_tokens").distinct().filter("spec_name is not null and capacity_tokens > 0")
    wanted = sorted((r["spec_name"], r["capacity_tokens"]) for r in named.collect())
    if not wanted:
        columns = f"spec_name string, capacity_tokens long, container_id string, `{key}` {docs.schema[key].dataType.simpleString()}"
        return spark.createDataFrame([], columns + ", part_no long, first_token long, n_tokens long, placed_by string")
    sizes = written(with_token_counts(docs, [key], vocabulary=vocabulary), "pack-tokens").select(F.col(key).alias("k"), F.col("n_tokens").alias("size"))
    each = F.explode(F.array(*[F.struct(F.lit(i).alias("spec"), F.lit(c).cast("long").alias("capacity")) for i, (_, c) in enumerate(wanted)]))
    asked = sizes.filter("size > 0").select("k", "size", each.alias("s")).select("k", "size", "s.*")
    parts = asked.select("*", F.explode(F.expr("sequence(0L, (size - 1) div capacity)")).alias("part_no"))
    items = parts.select("spec", "k", "part_no", (F.col("part_no") * F.col("capacity")).alias("first_token"), F.expr("least(capacity, size - part_no * capacity)").alias("n_tokens"))
    counts: dict[int, dict[int, int]] = {i: {} for i in range(len(wanted))}
    for r in items.groupBy("spec", "n_tokens").agg(F.count(F.lit(1)).alias("n")).collect():
        counts[r["spec"]][r["n_tokens"]] = r["n"]
    steps, plan = _plan_tables(spark, wanted, counts)
    of = ["spec", "n_tokens"]
    ranked = _ranked(items).join(steps, of).withColumn("bucket", F.expr("rank div step")).join(plan, [*of, "bucket"]).filter("rank >= rank_from and rank < rank_to")
    number = F.expr("first + (rank - rank_from) div per").cast("string")
    kind = F.when(F.col("placed_by") == "full", "full").otherwise("mixed")
    name, capacity = (F.element_at(F.array(*[F.lit(x) for x in column]), F.col("spec") + 1) for column in zip(*wanted))
    return ranked.select(
        name.alias("spec_name"), capacity.cast("long").alias("capacity_tokens"), F.concat_ws("-", kind, number).alias("container_id"), F.col("k").alias(key), "part_no", "first_token", "n_tokens", "placed_by"
    )


def _ranked(items: DataFrame) -> DataFrame:
    """Number the items of each (specification, length) from 0: inside parts by a hash, and on from the sizes of the parts before."""
    keys = ["spec", "n_tokens"]
    salted = items.withColumn("salt", F.pmod(F.xxhash64("k", "part_no"), F.lit(SALTS)).cast("int"))
    number = F.row_number().over(Window.partitionBy(*keys, "salt").orderBy("k", "part_no"))
    before = Window.partitionBy(*keys).orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    sizes = salted.groupBy(*keys, "salt").agg(F.count(F.lit(1)).alias("n"))
    offsets = sizes.select(*keys, "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    counted = salted.withColumn("number", number).join(offsets, [*keys, "salt"])
    return counted.withColumn("rank", F.col("number") - 1 + F.col("before")).drop("salt", "number", "before")


def fill(packed: DataFrame) -> DataFrame:
    """Per specification: containers, items, those placed by patterns, tokens, the part of the room that is used, and the containers that any packing needs."""
    by_pattern = F.count(F.when(F.col("placed_by") == "pattern", 1))
    used = packed.groupBy("spec_name", "capacity_tokens", "container_id").agg(F.sum("n_tokens").alias("n"), F.count(F.lit(1)).alias("items"), by_pattern.alias("by_pattern"))
    total = used.groupBy("spec_name", "capacity_tokens").agg(
        F.count(F.lit(1)).alias("n_containers"), F.sum("items").alias("n_items"), F.sum("by_pattern").alias("n_by_pattern"), F.sum("n").alias("n_tokens"), F.max("n").alias("fullest")
    )
    room = F.col("n_containers") * F.col("capacity_tokens")
    least = F.ceil(F.col("n_tokens") / F.col("capacity_tokens"))
    return total.withColumns({"used": F.col("n_tokens") / room, "least_containers": least})


def packing_audit(packed: DataFrame, sizes: DataFrame, specs: DataFrame, key: str = "doc_id") -> DataFrame:
    """(spec_name, n_documents, overfull, wrongly_split, not_whole): what is packed, and three counts that must be 0.

    sizes: (key, n_tokens), the keys unique. overfull: containers with more than their capacity; wrongly_split: documents of at
    most the capacity in several parts; not_whole: documents whose parts don't follow on each other from 0 to their size, or that
    are missing.
    """
    of = ["spec_name", "capacity_tokens"]
    loads = packed.groupBy(*of, "container_id").agg(F.sum("n_tokens").alias("n")).groupBy(*of)
    over = loads.agg(F.count(F.when(F.col("n") > F.col("capacity_tokens"), 1)).alias("overfull"))
    parts = F.count(F.lit(1)).alias("parts")
    got = packed.groupBy(*of, key).agg(parts, F.sum("n_tokens").alias("got"), F.min("first_token").alias("low"), F.max(F.col("first_token") + F.col("n_tokens")).alias("high"), F.countDistinct("first_token").alias("starts"))
    wanted = [F.struct(F.lit(r["spec_name"]).alias("spec_name"), F.lit(r["capacity_tokens"]).alias("capacity_tokens")) for r in specs.select(*of).distinct().collect()]
    asked = sizes.filter("n_tokens > 0").select("*", F.inline(F.array(*wanted)))
    both = asked.join(got, [*of, key], "left")
    whole = (F.col("got") == F.col("n_tokens")) & (F.col("low") == 0) & (F.col("high") == F.col("n_tokens")) & (F.col("starts") == F.col("parts"))
    docs = both.groupBy(*of).agg(
        F.count("parts").alias("n_documents"),
        F.count(F.when((F.col("parts") > 1) & (F.col("n_tokens") <= F.col("capacity_tokens")), 1)).alias("wrongly_split"),
        F.count(F.when(~F.coalesce(whole, F.lit(False)), 1)).alias("not_whole"),
    )
    return docs.join(over, of).select("spec_name", "n_documents", "overfull", "wrongly_split", "not_whole")
