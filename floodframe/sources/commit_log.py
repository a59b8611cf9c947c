"""Half-month chunks committed through a ledger.

A run writes its chunks to a folder of its own and then appends one ledger row per chunk. Only rows of the run a chunk's ledger row names
are read, so what a killed run leaves behind is never seen and a resumed run makes no doubles.
"""

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from floodframe.operators.chunks import complete_months
from floodframe.session import cut_lineage

CHUNK = ["year", "month", "part"]
_LEDGER = "year int, month int, part int, run string, n_rows long"


def _has(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def ledger(spark: SparkSession, path: str) -> DataFrame:
    """``year month part run n_rows`` of the committed chunks; the first commit of a chunk counts."""
    folder = f"{path.rstrip('/')}/ledger"
    rows = spark.read.schema(_LEDGER + ", at timestamp").parquet(folder) if _has(spark, folder) else spark.createDataFrame([], _LEDGER + ", at timestamp")
    return rows.groupBy(*CHUNK).agg(F.min(F.struct("at", "run", "n_rows")).alias("c")).select(*CHUNK, "c.run", "c.n_rows")


def write_staged(df: DataFrame, path: str) -> str:
    """Write ``df`` with its ``year month part`` under a new run, uncommitted; gives the run."""
    run = uuid.uuid4().hex
    df.hint("rebalance", *[F.col(c) for c in CHUNK]).write.partitionBy(*CHUNK).parquet(f"{path.rstrip('/')}/parts/run={run}")
    return run


def commit(spark: SparkSession, path: str, run: str) -> None:
    """One ledger row per chunk of a staged run; nothing of it can be read before."""
    staged = spark.read.parquet(f"{path.rstrip('/')}/parts/run={run}")
    rows = staged.groupBy(*[F.col(c).cast("int").alias(c) for c in CHUNK]).agg(F.count(F.lit(1)).alias("n_rows"))
    rows.select(*CHUNK, F.lit(run).alias("run"), "n_rows", F.current_timestamp().alias("at")).coalesce(1).write.mode("append").parquet(f"{path.rstrip('/')}/ledger")


def committed_rows(spark: SparkSession, path: str, whole_months: bool = False) -> DataFrame | None:
    """Rows of committed chunks, of months with both halves only if asked; None before the first commit."""
    done = ledger(spark, path)
    chosen = complete_months(done) if whole_months else done
    if not _has(spark, f"{path.rstrip('/')}/ledger"):
        return None
    # one row per chunk, so that runs and chunks prune the folders read
    chosen = cut_lineage(spark, chosen.select("run", *CHUNK))
    return spark.read.option("basePath", f"{path.rstrip('/')}/parts").option("mergeSchema", "true").parquet(f"{path.rstrip('/')}/parts").join(
        F.broadcast(chosen) if chosen.count() < 100_000 else chosen, ["run", *CHUNK], "left_semi").drop("run")
