"""Session settings and the shared folder for written intermediate tables."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Settings that hold at any scale; sizes and counts are left to the cluster and to AQE.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def local_session(cpus: int = 8, app: str = "fenceline", **extra: str) -> SparkSession:
    """A session in one JVM, for tests and the benchmark."""
    builder = SparkSession.builder.master(f"local[{cpus}]").appName(app)
    conf = DEFAULTS | {"spark.sql.shuffle.partitions": str(cpus), "spark.ui.enabled": "false"} | extra
    return builder.config(map=conf).getOrCreate()


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Where it is unset, a temporary one in a single process, else an error."""
    known = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not known:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError(f"set spark.checkpoint.dir to a folder that all executors of {master} share")
        known = "file://" + tempfile.mkdtemp(prefix="fenceline-")
        spark.conf.set("spark.checkpoint.dir", known)
    return known.rstrip("/")


def written(df: DataFrame, label: str) -> DataFrame:
    """Write df to the shared folder and read it back: cuts the lineage and outlives executors.

    The files are removed by discard, at the end of a scratch block, or when the Python process ends.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    _paths[path] = spark
    back._written_at = path
    return back


def discard(df: DataFrame) -> None:
    """Remove a written table that nothing will read any more."""
    path = getattr(df, "_written_at", None)
    if path in _paths:
        _remove(path)


@contextmanager
def scratch() -> Iterator[None]:
    """Remove at the end what was written inside; results that read it must have been used by then."""
    before = set(_paths)
    try:
        yield
    finally:
        for path in [p for p in _paths if p not in before]:
            _remove(path)


_paths: dict[str, SparkSession] = {}


def _remove(path: str) -> None:
    spark = _paths.pop(path)
    try:
        jvm = spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    except Exception:  # the session may be gone already
        pass


@atexit.register
def _remove_all() -> None:
    for path in list(_paths):
        _remove(path)
