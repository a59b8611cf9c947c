"""Shared by the text operators: session settings, scratch tables, size-checked joins."""

from pyspark.sql import DataFrame, SparkSession, functions as F

from floodframe.session import configure, cut_lineage, scratch_path

#: Rows of an id-only side that may be broadcast; a bigger side is joined by shuffle.
BROADCAST_ROWS = 1_000_000

__all__ = ["BROADCAST_ROWS", "bounded", "cut_lineage", "prepare", "scratch_path", "table"]


def prepare(spark: SparkSession) -> SparkSession:
    """Library settings, and Arrow batches bounded by bytes so long texts don't pile up in a worker."""
    configure(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(2 << 20))
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def bounded(ids: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """``ids`` marked for broadcast if counting shows at most ``limit`` rows, else as it is. Runs a count; ``ids`` must be narrow."""
    return F.broadcast(ids) if ids.limit(limit + 1).count() <= limit else ids
