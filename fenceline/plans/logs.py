"""Queries on the coordination tables: busy periods, rolling totals, orphan references, lock history."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.blocked import block_days_for
from ..functions.keys import clean_name, run_key, time_text
from ..operators.history import bitemporal_ledger, versions
from ..operators.intervals import gap_micros, merge_intervals, periods_and_gaps, with_next_period
from ..operators.references import References, orphan_counts, orphan_rows
from ..operators.rolling import trailing_totals
from ..operators.runs import current_runs

HOUR = 3_600_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _blocks(spark: SparkSession, sf_dir: str, name: str) -> float:
    return block_days_for(table(spark, sf_dir, name).count())


def _timed_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return current_runs(table(spark, sf_dir, "job_runs"), "started_at", "finished_at")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Periods of at least two runs, and gaps of at least 48 hours and less than 28 days."""
    days = _blocks(spark, sf_dir, "job_runs")
    periods = merge_intervals(_timed_runs(spark, sf_dir), "job_name", "started_at", "finished_at", days)
    spans = with_next_period(periods, "job_name", days)
    period = F.struct(F.lit("period").alias("span_kind"), time_text("period_start").alias("from_ts"), time_text("period_end").alias("to_ts"))
    gap = F.struct(F.lit("gap").alias("span_kind"), time_text("period_end").alias("from_ts"), time_text("next_start").alias("to_ts"))
    shown = F.array_compact(
        F.array(
            F.when(F.col("n_members") >= 2, period),
            F.when((gap_micros() >= 48 * HOUR) & (gap_micros() < 28 * 24 * HOUR), gap),
        )
    )
    return spans.select("job_name", F.inline(shown))


def p2_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All busy periods and all idle gaps of each job, with the number of runs."""
    spans = periods_and_gaps(_timed_runs(spark, sf_dir), "job_name", "started_at", "finished_at", _blocks(spark, sf_dir, "job_runs"))
    return spans.select("job_name", "span_kind", time_text("from_at").alias("from_ts"), time_text("to_at").alias("to_ts"), F.col("n_members").alias("n_runs"))


def p3_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals and averages of items over the last 7 and 30 days, for every day whose last 30 days hold a run."""
    runs = current_runs(table(spark, sf_dir, "job_runs"), "started_at", "items_processed")
    totals = trailing_totals(runs, "job_name", "started_at", "items_processed")
    return totals.select(
        "job_name", F.date_format("on_day", "yyyy-MM-dd").alias("on_day"), "n_rows", "total_7", "total_30", F.round("avg_7", 6).alias("avg_7"), F.round("avg_30", 6).alias("avg_30")
    )


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days on which the last 7 days hold at least twice what the 23 days before them hold, and those hold something."""
    runs = current_runs(table(spark, sf_dir, "job_runs"), "started_at", "items_processed")
    totals = trailing_totals(runs, "job_name", "started_at", "items_processed")
    earlier = F.col("total_30") - F.col("total_7")
    return totals.filter((earlier > 0) & (F.col("total_7") >= 2 * earlier)).select("job_name", F.date_format("on_day", "yyyy-MM-dd").alias("on_day"))


def _references(spark: SparkSession, sf_dir: str) -> dict[str, References]:
    job, run, at = clean_name("job_name").alias("job"), run_key("run_id").alias("run"), F.col("loaded_at").alias("at")
    checkpoints, runs = (table(spark, sf_dir, t) for t in ("job_checkpoints", "job_runs"))
    purges, locks = (table(spark, sf_dir, t) for t in ("run_purges", "job_locks"))
    whole_job = clean_name("run_id").isNull()
    return {
        "job_checkpoints": References(checkpoints.select("rec_id", job, run, at), runs.select(job, run, at), purges.select(job, run), ("job", "run")),
        "job_runs": References(runs.select("rec_id", job, at), locks.select(job, at), purges.filter(whole_job).select(job), ("job",)),
    }


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of job_checkpoints without their run and of job_runs without their lock."""
    parts = [orphan_rows(refs).select(F.lit(name).alias("src_table"), "rec_id", "orphan_kind") for name, refs in _references(spark, sf_dir).items()]
    return parts[0].unionByName(parts[1])


def p4_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orphan references by table, month of loading and kind."""
    parts = [orphan_counts(refs).select(F.lit(name).alias("src_table"), "period", "orphan_kind", "n_orphans") for name, refs in _references(spark, sf_dir).items()]
    return parts[0].unionByName(parts[1])


LOCK_ATTRIBUTES = ["holder", "status", "token"]


def _lock_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    snapshots = table(spark, sf_dir, "lock_snapshots")
    clean = snapshots.select(
        clean_name("job_name").alias("job_name"), "snap_at", "loaded_at", "rec_id", clean_name("holder").alias("holder"), clean_name("status").alias("status"), "token"
    )
    return bitemporal_ledger(clean, "job_name", "snap_at", "loaded_at", "rec_id", LOCK_ATTRIBUTES, _blocks(spark, sf_dir, "lock_snapshots"))


def _lock_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return versions(_lock_ledger(spark, sf_dir), "job_name", LOCK_ATTRIBUTES, _blocks(spark, sf_dir, "lock_snapshots"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The period in which each version of a job's lock was valid, as believed now."""
    held = _lock_versions(spark, sf_dir)
    return held.select("job_name", time_text("valid_from").alias("valid_from"), F.coalesce(time_text("valid_to"), F.lit("open")).alias("valid_to"))


def p5_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The versions of p5_found with their holder, status and token."""
    held = _lock_versions(spark, sf_dir)
    return held.select(
        "job_name", time_text("valid_from").alias("valid_from"), F.coalesce(time_text("valid_to"), F.lit("open")).alias("valid_to"), *LOCK_ATTRIBUTES
    )


def p5_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every belief about every lock, with the time for which and the time during which it was held."""
    return _lock_ledger(spark, sf_dir).select(
        "job_name",
        *[time_text(c).alias(c) for c in ("valid_from", "valid_to", "recorded_from", "recorded_to")],
        *LOCK_ATTRIBUTES,
    )


QUERIES = {f.__name__: f for f in (p2_found, p2_spans, p3_found, p3_totals, p4_found, p4_counts, p5_found, p5_versions, p5_ledger)}

_BLANKS = "(' ' || chr(9) || chr(10) || chr(13) || chr(11) || chr(12))"


def _name(c: str) -> str:
    return f"nullif(lower(trim({c}, {_BLANKS})), '')"


def _run(c: str) -> str:
    bare = f"translate(lower({c}), {_BLANKS} || '{{}}-', '')"
    return f"case when regexp_full_match({bare}, '[0-9a-f]{{32}}') then {bare} else nullif('t:' || {_name(c)}, 't:') end"


def _text(c: str) -> str:
    return f"strftime({c}, '%Y-%m-%d %H:%M:%S.%g')"


CURRENT_RUNS = f"""
named as (select {_name('job_name')} as job_name, {_run('run_id')} as run, started_at, finished_at, items_processed, loaded_at, rec_id from job_runs),
cur as (
  select * from named where job_name is not null
  qualify row_number() over (partition by job_name, run order by (finished_at is not null) desc, loaded_at desc nulls last, rec_id desc) = 1
)"""

_SPANS = f"""{CURRENT_RUNS},
iv as (select job_name, started_at as s, finished_at as t from cur where finished_at > started_at),
marked as (
  select *, case when s <= max(t) over (partition by job_name order by s, t rows between unbounded preceding and 1 preceding) then 0 else 1 end as fresh from iv
),
numbered as (select *, sum(fresh) over (partition by job_name order by s, t rows unbounded preceding) as k from marked),
period as (select job_name, k, min(s) as s, max(t) as t, count(*) as n from numbered group by job_name, k),
nexts as (select *, lead(s) over (partition by job_name order by s) as nxt from period)"""

_DAYS = f"""{CURRENT_RUNS},
daily as (
  select job_name, started_at::date as d, sum(greatest(coalesce(items_processed, 0), 0)) as v, count(*) as n
  from cur where started_at is not null group by 1, 2
),
spread as (
  select job_name, d, v, n, least(coalesce(date_diff('day', d, lead(d) over (partition by job_name order by d)), 30), 30) as k from daily
),
dense as (
  select job_name, d + i::int as d, case when i = 0 then v else 0 end as v, case when i = 0 then n else 0 end as n from (select *, unnest(range(k)) as i from spread)
),
rolled as (
  select job_name, d, n,
    sum(v) over (partition by job_name order by d range between interval 6 days preceding and current row) as t7,
    sum(v) over (partition by job_name order by d range between interval 29 days preceding and current row) as t30
  from dense
)"""

_ORPHANS = f"""
cp as (select rec_id, {_name('job_name')} as job, {_run('run_id')} as run, loaded_at from job_checkpoints),
rn as (select rec_id, {_name('job_name')} as job, {_run('run_id')} as run, loaded_at from job_runs),
pg as (select {_name('job_name')} as job, {_run('run_id')} as run from run_purges),
lk as (select {_name('job_name')} as job, min(loaded_at) as first_at from job_locks group by 1),
first_run as (select job, run, min(loaded_at) as first_at from rn where job is not null and run is not null group by 1, 2),
gone_run as (select distinct job, run from pg where job is not null and run is not null),
gone_job as (select distinct job from pg where job is not null and run is null),
orphan as (
  select 'job_checkpoints' as src_table, cp.rec_id, cp.loaded_at,
    case when f.job is null then case when g.job is not null then 'deleted' else 'missing' end when f.first_at > cp.loaded_at then 'late' end as orphan_kind
  from cp left join first_run f on f.job = cp.job and f.run = cp.run left join gone_run g on g.job = cp.job and g.run = cp.run
  where cp.job is not null and cp.run is not null
  union all
  select 'job_runs', rn.rec_id, rn.loaded_at,
    case when lk.job is null then case when g.job is not null then 'deleted' else 'missing' end when lk.first_at > rn.loaded_at then 'late' end
  from rn left join lk on lk.job = rn.job left join gone_job g on g.job = rn.job
  where rn.job is not null
)"""

_VERSIONS = f"""
snap as (
  select {_name('job_name')} as job_name, snap_at, {_name('holder')} as holder, {_name('status')} as status, token from lock_snapshots
  where {_name('job_name')} is not null and snap_at is not null
  qualify row_number() over (partition by {_name('job_name')}, snap_at order by loaded_at desc nulls last, rec_id desc) = 1
),
changed as (
  select *, row(holder, status, token) is distinct from lag(row(holder, status, token)) over w or lag(snap_at) over w is null as fresh
  from snap window w as (partition by job_name order by snap_at)
),
ver as (select *, lead(snap_at) over (partition by job_name order by snap_at) as nxt from changed where fresh)"""

SQL = {
    "p2_found": f"""with {_SPANS}
select job_name, 'period' as span_kind, {_text('s')} as from_ts, {_text('t')} as to_ts from nexts where n >= 2
union all
select job_name, 'gap', {_text('t')}, {_text('nxt')} from nexts where nxt - t >= interval 48 hours and nxt - t < interval 672 hours""",
    "p2_spans": f"""with {_SPANS}
select job_name, 'period' as span_kind, {_text('s')} as from_ts, {_text('t')} as to_ts, n as n_runs from nexts
union all
select job_name, 'gap', {_text('t')}, {_text('nxt')}, 0 from nexts where nxt is not null""",
    "p3_found": f"""with {_DAYS}
select job_name, strftime(d, '%Y-%m-%d') as on_day from rolled where t30 - t7 > 0 and t7 >= 2 * (t30 - t7)""",
    "p3_totals": f"""with {_DAYS}
select job_name, strftime(d, '%Y-%m-%d') as on_day, n::bigint as n_rows, t7::bigint as total_7, t30::bigint as total_30, round(t7 / 7, 6) as avg_7, round(t30 / 30, 6) as avg_30 from rolled""",
    "p4_found": f"""with {_ORPHANS}
select src_table, rec_id, orphan_kind from orphan where orphan_kind is not null""",
    "p4_counts": f"""with {_ORPHANS}
select src_table, strftime(loaded_at, '%Y-%m') as period, orphan_kind, count(*) as n_orphans from orphan where orphan_kind is not null group by 1, 2, 3""",
    "p5_found": f"""with {_VERSIONS}
select job_name, {_text('snap_at')} as valid_from, coalesce({_text('nxt')}, 'open') as valid_to from ver""",
    "p5_versions": f"""with {_VERSIONS}
select job_name, {_text('snap_at')} as valid_from, coalesce({_text('nxt')}, 'open') as valid_to, holder, status, token from ver""",
    "p5_ledger": f"""with sn as (
  select {_name('job_name')} as job_name, snap_at as s, loaded_at as l, row({_name('holder')}, {_name('status')}, token) as v,
    row_number() over (partition by {_name('job_name')} order by loaded_at nulls first, rec_id, snap_at) as o
  from lock_snapshots where {_name('job_name')} is not null and snap_at is not null
),
-- what is said about a moment itself, and the next moments that become known, each before all those known so far
own as (select job_name, s, o, l, v, null::timestamp as nxt, v is distinct from lag(v) over w or lag(o) over w is null as tells from sn window w as (partition by job_name, s order by o)),
known as (select job_name, s, min(o) as since from sn group by 1, 2),
later as (
  select k.job_name, k.s, y.o, y.l, y.s as nxt, min(y.s) over (partition by k.job_name, k.s order by y.o rows between unbounded preceding and 1 preceding) as low
  from known k join sn y on y.job_name = k.job_name and y.s > k.s
),
told as (
  select job_name, s, o, l, v, nxt, tells from own
  union all select job_name, s, o, l, null, nxt, true from later where low is null or nxt < low
),
state as (
  select job_name, s, o, l, tells, last_value(v ignore nulls) over w as v, min(nxt) over w as nxt from told
  window w as (partition by job_name, s order by o rows unbounded preceding)
),
belief as (
  select job_name, s, l, v, nxt, lead(l) over w as until, lead(o) over w is not null as replaced
  from state join known using (job_name, s) where o >= since and tells window w as (partition by job_name, s order by o)
)
select job_name, {_text('s')} as valid_from, {_text('nxt')} as valid_to, {_text('l')} as recorded_from, {_text('until')} as recorded_to, v[1] as holder, v[2] as status, v[3] as token
from belief where not replaced or (until is not null and (l is null or l < until))""",
}
