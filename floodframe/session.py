"""Session settings the library relies on, and the shared scratch folder."""

import uuid
from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager
from contextvars import ContextVar, copy_context

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings every job here expects."""
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """Folder all executors can reach: ``spark.checkpoint.dir``, else one under the warehouse, which on a cluster may not be machine-local."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path
    warehouse = spark.conf.get("spark.sql.warehouse.dir").rstrip("/")
    check_shared(spark.sparkContext.master, warehouse)
    return f"{warehouse}/_scratch"


def check_shared(master: str, folder: str) -> None:
    """Refuse a folder that each machine of a cluster has for itself."""
    if not master.startswith("local") and ("://" not in folder or folder.startswith("file:")):
        raise ValueError(f"set spark.checkpoint.dir to a folder all executors share; {folder} is local to a machine")


#: Open scopes, per thread.
_SCOPES: ContextVar[tuple[str, ...]] = ContextVar("scopes", default=())


@contextmanager
def scratch(spark: SparkSession):
    """Scope for intermediate tables: what is written inside it is deleted at its end, so write or collect results before."""
    base = f"{shared_dir(spark).rstrip('/')}/scope-{uuid.uuid4().hex}"
    opened = _SCOPES.set((*_SCOPES.get(), base))
    try:
        yield base
    finally:
        _SCOPES.reset(opened)
        where = spark._jvm.org.apache.hadoop.fs.Path(base)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path under the open scope, or under the shared folder."""
    scopes = _SCOPES.get()
    base = scopes[-1] if scopes else shared_dir(spark).rstrip("/")
    return f"{base}/{label}-{uuid.uuid4().hex}"


def cut_lineage(spark: SparkSession, df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back, so iterations stay short and survive lost executors."""
    path = scratch_path(spark, "step")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(spark: SparkSession, df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """``df``, written, in partitions of about ``rows`` rows by ``keys``: for small rows that a next step multiplies.

    Adaptive execution sizes partitions by their bytes and would give such rows to a few tasks. Runs a job.
    """
    df = cut_lineage(spark, df)
    return df.repartition(max(1, -(-df.count() // rows)), *keys)


#: Jobs run at the same time by ``side_by_side``.
AT_ONCE = 4


def side_by_side(spark: SparkSession, jobs: Sequence[Callable], at_once: int = AT_ONCE) -> list:
    """Results of the jobs, in order; up to ``at_once`` run at a time, each in a scheduler pool of its own and in the caller's scratch scope."""
    jobs = list(jobs)
    if at_once < 2 or len(jobs) < 2:
        return [job() for job in jobs]

    def pooled(number, job):
        spark.sparkContext.setLocalProperty("spark.scheduler.pool", f"side-{number % at_once}")
        return job()

    with ThreadPoolExecutor(at_once) as pool:
        started = [pool.submit(copy_context().run, inheritable_thread_target(spark)(pooled), number, job) for number, job in enumerate(jobs)]
        return [s.result() for s in started]
