"""Comparable forms of names, ids and times."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters that count as surrounding whitespace.
BLANKS = " \t\n\r\x0b\x0c"

#: What may stand around or inside a written UUID.
UUID_NOISE = BLANKS + "{}-"

_EPOCH = "timestamp_ntz'1970-01-01 00:00:00'"

#: Keeps the key of a text that is no UUID longer than the 16 bytes of one.
_TEXT_MARK = "not-a-uuid-text:"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def clean_name(c: Column | str) -> Column:
    """Trimmed, lower-case form; null where nothing is left."""
    text = F.lower(F.btrim(col(c), F.lit(BLANKS)))
    return F.when(text != "", text)


def run_key(c: Column | str) -> Column:
    """Binary key of a run id: the 16 bytes of a UUID however it is written, else its trimmed text; null for blank.

    Sixteen random bytes shuffle at half the size of the hexadecimal text.
    """
    text = F.lower(col(c))
    bare = F.translate(text, UUID_NOISE, "")
    other = F.btrim(text, F.lit(BLANKS))
    return F.coalesce(
        F.when(F.length(bare) == 32, F.unhex(bare)),
        F.when(other != "", F.encode(F.concat(F.lit(_TEXT_MARK), other), "UTF-8")),
    )


def micros(c: Column | str) -> Column:
    """Microseconds since 1970 of a zone-less timestamp."""
    return F.timestamp_diff("MICROSECOND", F.expr(_EPOCH), col(c))


def time_text(c: Column | str) -> Column:
    """YYYY-MM-DD HH:MM:SS.mmm"""
    return F.date_format(col(c), "yyyy-MM-dd HH:mm:ss.SSS")


def block_of(c: Column | str, days: float) -> Column:
    """Number of the time block of so many days that holds c."""
    return F.floor(micros(c) / F.lit(max(1, int(days * 86_400_000_000)))).cast("long")


def run_text(c: Column | str) -> Column:
    """Readable form of run_key: 32 hexadecimal digits, or t: and the trimmed text."""
    text = F.lower(col(c))
    bare = F.translate(text, UUID_NOISE, "")
    other = F.btrim(text, F.lit(BLANKS))
    return F.coalesce(F.when((F.length(bare) == 32) & F.unhex(bare).isNotNull(), bare), F.when(other != "", F.concat(F.lit("t:"), other)))


def millis_between(start: Column | str, end: Column | str) -> Column:
    """Whole milliseconds from start to end; null if either is."""
    return F.timestamp_diff("MILLISECOND", col(start), col(end))


def idempotency_key(stable_id: Column, item: Column, method: Column | None = None, prefix: str = "fl") -> Column:
    """prefix_id_item[_method]; null if a part is null."""
    parts = [F.lit(prefix), stable_id, item, *([method] if method is not None else [])]
    joined = [x for p in parts for x in (F.lit("_"), p)][1:]
    return F.concat(*joined)


def stable_id(run_id: Column, token: Column) -> Column:
    """The run id where there is one, so that the key survives a takeover; else the token."""
    return F.coalesce(run_id, token.cast("string"))


def key_headers(key: Column, names: tuple[str, ...] = ("Idempotency-Key", "X-Idempotency-Key")) -> Column:
    """The headers that carry a key to a receiver; null without a key."""
    return F.when(key.isNotNull(), F.create_map(*[x for n in names for x in (F.lit(n), key)]))


def stage_key(kind: Column | str, constant: Column | str) -> Column:
    return F.concat_ws(".", col(kind), col(constant))


def run_stage_key(run_id: Column | str, stage: Column | str) -> Column:
    """One sort key for a run's stages; a run's rows are those that start with 'run#'."""
    return F.concat_ws("#", col(run_id), col(stage))


def of_run(key: Column | str, run_id: Column | str) -> Column:
    """Whether a key made by run_stage_key is one of the run's."""
    return F.startswith(col(key), F.concat(col(run_id), F.lit("#")))


def progress_json(last_id: Column, state: Column | None = None, state_type: Column | None = None) -> Column:
    fields = [last_id.alias("lastId")]
    if state is not None:
        fields += [state.alias("state"), state_type.alias("stateType")]
    return F.to_json(F.struct(*fields), {"ignoreNullFields": "false"})


def parse_progress(c: Column | str) -> Column:
    """Struct (lastId, state, stateType) of a progress document; null where it is no whole JSON object."""
    parsed = F.from_json(col(c), "lastId string, state string, stateType string, _bad string", {"columnNameOfCorruptRecord": "_bad"})
    whole = parsed.isNotNull() & parsed["_bad"].isNull() & F.startswith(F.ltrim(col(c)), F.lit("{"))
    return F.when(whole, F.struct(parsed["lastId"].alias("lastId"), parsed["state"].alias("state"), parsed["stateType"].alias("stateType")))
