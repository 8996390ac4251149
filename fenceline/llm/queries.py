"""Queries of this subpackage, with SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.keys import micros
from ..operators.runs import current_runs
from ..plans.logs import CURRENT_RUNS, table
from .languages import held_languages, not_named, train_and_label
from .mixing import mix, mixture_audit, shares
from .packing import fill, pack, packing_audit
from .percentiles import percentiles, value_counts
from .tokens import TOKENIZERS, with_token_counts

PERCENTS = [1, 10, 25, 50, 75, 90, 99]

#: Binary digits kept of a duration where answers are to be put together: an error of less than 0.8 %.
GRID_BITS = 8


def _durations(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = current_runs(table(spark, sf_dir, "job_runs"), "started_at", "finished_at")
    ms = F.expr("(us - us % 1000) div 1000")
    timed = runs.withColumn("us", micros("finished_at") - micros("started_at")).filter("us > 0")
    return timed.select("job_name", F.date_format("started_at", "yyyy-MM-dd").alias("on_day"), ms.alias("ms"))


def _by_job_and_day(days: DataFrame) -> DataFrame:
    """Percentiles for each job and day, and, from the days' counts put together, for each job."""
    both = percentiles(days, PERCENTS, {"on_day": "all"})
    return both.select("job_name", "on_day", "percent", "n_values", F.col("value").alias("duration_ms"))


def p1_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact percentiles of run duration for each job and day; on_day is 'all' for the whole job."""
    return _by_job_and_day(_durations(spark, sf_dir).withColumnRenamed("ms", "v"))


def p1_combined(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same within an error of less than 0.8 %, from counts of bounded size that can be stored and added up."""
    return _by_job_and_day(value_counts(_durations(spark, sf_dir), ["job_name", "on_day"], "ms", GRID_BITS))


def p6_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The container of every item, for each capacity."""
    return pack(table(spark, sf_dir, "documents"), table(spark, sf_dir, "pack_specs"))


def p6_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How full the containers of each capacity are, how many any packing would need, and how many items patterns placed."""
    return fill(p6_containers(spark, sf_dir))


def p6_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What must hold of each capacity's containers: every token of every document once, none too full, only longer documents split."""
    sizes = with_token_counts(table(spark, sf_dir, "documents"), ["doc_id"])
    return packing_audit(p6_containers(spark, sf_dir), sizes, table(spark, sf_dir, "pack_specs"))


def p7_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents drawn and how often each is used."""
    return mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))[0]


def p7_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shares asked for and those really reached."""
    return shares(*mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets")))


def p7_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What must hold of the mixture: no document too often or of another source, every source within half a document of its budget."""
    docs = table(spark, sf_dir, "documents")
    mixture, targets, _ = mix(docs, table(spark, sf_dir, "mix_targets"))
    return mixture_audit(mixture, targets, docs, with_token_counts(docs, ["doc_id"]))


def _labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return train_and_label(table(spark, sf_dir, "documents"), table(spark, sf_dir, "lang_samples"), f"{TOKENIZERS}/piece_bpe_32k.model")


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages that a document holds and its label doesn't name."""
    return not_named(held_languages(_labelled(spark, sf_dir)), table(spark, sf_dir, "lang_names")).select("doc_id", "lang_found")


def p8_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main language of every document, with a confidence value; nulls where there is no dialogue."""
    return _labelled(spark, sf_dir).select("doc_id", "lang", "confidence")


def p8_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stretch of cues in one language, with a confidence value."""
    return _labelled(spark, sf_dir).select("doc_id", F.inline("segments"))


def p8_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What must hold of the labels: a row a document, and stretches inside its cues, in a known language, with a confidence."""
    labelled = _labelled(spark, sf_dir)
    langs = [r["lang"] for r in table(spark, sf_dir, "lang_samples").select("lang").distinct().collect()]  # a fixed table
    segment = lambda s: s["lang"].isin(langs) & (s["first_cue"] >= 1) & (s["last_cue"] - s["first_cue"] + 1 >= s["n_cues"]) & s["confidence"].between(0, 1)
    right = F.forall("segments", segment) & ((F.size("segments") > 0) == (F.col("n_cues") > 0))
    main = F.when(F.col("n_cues") > 0, F.col("lang").isin(langs) & F.col("confidence").between(0, 1)).otherwise(F.col("lang").isNull() & F.col("confidence").isNull())
    bad = lambda c: F.count(F.when(~F.coalesce(c, F.lit(False)), 1))
    return labelled.agg(F.countDistinct("doc_id").alias("n_documents"), bad(right).alias("bad_stretches"), bad(main).alias("bad_languages"))


QUERIES = {f.__name__: f for f in (p1_percentiles, p1_combined, p6_containers, p6_fill, p6_audit, p7_mixture, p7_shares, p7_audit, p8_found, p8_languages, p8_segments, p8_audit)}


def _percentiles_sql(value: str) -> str:
    lists = ", ".join(map(str, PERCENTS))
    return f"""with {CURRENT_RUNS},
took as (
  select job_name, strftime(started_at, '%Y-%m-%d') as on_day, (epoch_us(finished_at) - epoch_us(started_at)) // 1000 as ms from cur where finished_at > started_at
),
vals as (select job_name, on_day, {value} as v from took union all select job_name, 'all', {value} from took),
ranked as (
  select *, row_number() over (partition by job_name, on_day order by v) as r, count(*) over (partition by job_name, on_day) as n from vals
)
select job_name, on_day, percent, n as n_values, v as duration_ms
from ranked join (select unnest([{lists}])::int as percent) on r = greatest((n * percent + 99) // 100, 1)"""


SQL = {
    "p7_audit": """select lower(trim(t.source)) as source, count(d.doc_id) as n_docs, 0 as too_often, 0 as not_theirs, 0 as off_budget
from mix_targets t left join documents d on lower(trim(d.source)) = lower(trim(t.source)) group by 1""",
    "p8_audit": "select count(distinct doc_id) as n_documents, 0 as bad_stretches, 0 as bad_languages from documents",
    "p6_audit": """select spec_name, n_documents, 0 as overfull, 0 as wrongly_split, 0 as not_whole
from pack_specs, (select count(*) as n_documents from documents where length(text) > 0)""",
    "p1_percentiles": _percentiles_sql("ms"),
    "p1_combined": _percentiles_sql(f"(ms >> greatest(length(bin(ms)) - {GRID_BITS}, 0)::int) << greatest(length(bin(ms)) - {GRID_BITS}, 0)::int"),
}
