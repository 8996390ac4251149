"""Which values a checkpoint can hold, and how they are written; checks of schemas and of job definitions."""

from __future__ import annotations

import dataclasses
import json
from datetime import date, datetime
from enum import Enum
from uuid import UUID

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, DataType, DecimalType, MapType, StructType

SCALARS = (bool, int, float, str, UUID, date, datetime)

_registered: dict[str, type] = {f"{t.__module__}.{t.__qualname__}": t for t in SCALARS}


def checkpoint_type(kind: type) -> type:
    """Register an enum or a dataclass, as a decorator, so that checkpoints may hold its values.

    A stored type name is data: it is looked up among the scalars and what is registered, and nothing else is ever made of it.
    """
    if not isinstance(kind, type) or not (issubclass(kind, Enum) or dataclasses.is_dataclass(kind)):
        raise CheckpointTypeError(f"{kind!r} is neither an enum nor a dataclass")
    _registered[f"{kind.__module__}.{kind.__qualname__}"] = kind
    return kind


class CheckpointTypeError(TypeError):
    """A value that can't be stored, or a stored one whose type is missing or unknown."""


def check_type(kind: DataType, path: str = "$root") -> None:
    """Raise for column types that no checkpoint value may have, naming the path; structs are walked."""
    if isinstance(kind, StructType):
        for f in kind.fields:
            check_type(f.dataType, f"{path}.{f.name}")
    elif isinstance(kind, (ArrayType, MapType, BinaryType, DecimalType)) or kind.typeName() == "udt":
        raise CheckpointTypeError(f"{path}: {kind.simpleString()} can't be stored in a checkpoint")


def check_value(value: object, path: str = "$root") -> None:
    """The same for Python values: scalars, and registered enums and dataclasses of those; None is allowed."""
    if value is None or type(value) in SCALARS:
        return
    if type_name(value) not in _registered:
        raise CheckpointTypeError(f"{path}: {type(value).__name__} can't be stored in a checkpoint; enums and dataclasses must be registered")
    if isinstance(value, Enum):
        return
    if dataclasses.is_dataclass(value):
        for f in dataclasses.fields(value):
            check_value(getattr(value, f.name), f"{path}.{f.name}")
        return
    raise CheckpointTypeError(f"{path}: {type(value).__name__} can't be stored in a checkpoint")


def type_name(value: object) -> str | None:
    return None if value is None else f"{type(value).__module__}.{type(value).__qualname__}"


def value_to_json(value: object) -> str | None:
    if value is None:
        return None

    def plain(x: object) -> object:
        if isinstance(x, Enum):
            return x.name
        if dataclasses.is_dataclass(x):
            return {f.name: plain(getattr(x, f.name)) for f in dataclasses.fields(x)}
        return x.isoformat() if isinstance(x, date) else str(x) if isinstance(x, UUID) else x

    return json.dumps(plain(value))


def value_from_json(text: str | None, kind: str | None) -> object:
    """The stored value; raises where its type is missing or not registered, or the value isn't one of it."""
    if text is None:
        return None
    if not kind or not kind.strip():
        raise CheckpointTypeError("the stored value has no type")
    if kind not in _registered:
        raise CheckpointTypeError(f"unknown type {kind}")
    try:
        return _made(_registered[kind], json.loads(text))
    except (KeyError, TypeError, ValueError) as e:
        raise CheckpointTypeError(f"{text[:80]} is no {kind}") from e


def _made(kind: type, raw: object) -> object:
    if issubclass(kind, Enum):
        return kind[raw]
    if dataclasses.is_dataclass(kind):
        hints = {f.name: f.type for f in dataclasses.fields(kind)}
        known = {t.__name__: t for t in _registered.values()}
        made = {n: (t if isinstance(t, type) else known.get(t)) for n, t in hints.items()}
        return kind(**{n: _made(made[n], x) if made[n] and x is not None else x for n, x in raw.items()})
    if kind in (date, datetime):
        return kind.fromisoformat(raw)
    if kind is not UUID and type(raw) is not kind and not (kind is float and type(raw) is int):
        raise TypeError(f"{raw!r} is no {kind.__name__}")
    return kind(raw)


def definition_findings(jobs: DataFrame) -> DataFrame:
    """(job_name, severity, code) for job definitions (job_name, cron, fixed_rate_ms, ttl_seconds, exactly_once, returns_value).

    Of these columns may be added, and are looked at if there: `stages` and `stored_stages` (arrays of names), `transactional` and
    `checks_lock` (booleans).

    Errors: a name that is blank or defined twice, a lease of 0 s or less, neither or both of cron and rate, an exactly-once
    method that returns something, a transaction around the whole job, which would hide its checkpoints until its end. Warnings: a
    lease under 60 s, within reach of a heartbeat that starts late; no stages declared; stored stages that aren't declared any
    more; an exactly-once job that never checks its lock, as a stop is only noticed where the code looks.
    """
    checks = [
        ("ERROR", "BLANK_NAME", "job_name is null or trim(job_name) = ''"),
        ("ERROR", "TTL_NOT_POSITIVE", "ttl_seconds <= 0"),
        ("WARNING", "TTL_SHORT", "ttl_seconds > 0 and ttl_seconds < 60"),
        ("ERROR", "NO_SCHEDULE", "cron is null and coalesce(fixed_rate_ms, -1) <= 0"),
        ("ERROR", "TWO_SCHEDULES", "cron is not null and coalesce(fixed_rate_ms, -1) > 0"),
        ("ERROR", "EXACTLY_ONCE_RETURNS", "exactly_once and returns_value"),
    ]
    optional = [
        (("transactional",), ("ERROR", "TRANSACTION_AROUND_JOB", "transactional")),
        (("stages",), ("WARNING", "NO_STAGES", "coalesce(size(stages), 0) = 0")),
        (("stages", "stored_stages"), ("WARNING", "STALE_STAGES", "size(array_except(stored_stages, stages)) > 0")),
        (("checks_lock",), ("WARNING", "NEVER_CHECKS_LOCK", "exactly_once and not checks_lock")),
    ]
    checks += [check for needs, check in optional if set(needs) <= set(jobs.columns)]
    found = F.filter(F.array(*[F.when(F.expr(c), F.struct(F.lit(s).alias("severity"), F.lit(code).alias("code"))) for s, code, c in checks]), lambda x: x.isNotNull())
    single = jobs.select("job_name", F.inline(found))
    twice = jobs.filter("trim(job_name) <> ''").groupBy("job_name").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    return single.unionByName(twice.select("job_name", F.lit("ERROR").alias("severity"), F.lit("DUPLICATE_NAME").alias("code")))
