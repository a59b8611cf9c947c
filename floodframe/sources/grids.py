"""Gridded inputs as Parquet tables with a schema contract."""

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

GRID_SCHEMAS = {
    "obs": "source STRING, cell_id BIGINT, latitude DOUBLE, longitude DOUBLE, ts TIMESTAMP_NTZ, variable STRING, value DOUBLE",
    "static": "source STRING, cell_id BIGINT, grid_row INT, grid_col INT, latitude DOUBLE, longitude DOUBLE, variable STRING, value DOUBLE",
    "forecast": "cell_id BIGINT, latitude DOUBLE, longitude DOUBLE, ts TIMESTAMP_NTZ, product STRING, member INT, variable STRING, value DOUBLE",
}


def read_grid(spark: SparkSession, path: str, kind: str = "obs") -> DataFrame:
    """A grid table; its columns have to match the contract, partition columns may be extra."""
    contract = T.StructType.fromDDL(GRID_SCHEMAS[kind])
    df = spark.read.parquet(path)
    missing = [f.name for f in contract if f.name not in df.columns]
    if missing:
        raise ValueError(f"{path} lacks the grid columns {missing}")
    typed = [F.col(f.name).cast(f.dataType).alias(f.name) if df.schema[f.name].dataType != f.dataType else F.col(f.name) for f in contract]
    return df.select(*typed, *[c for c in df.columns if c not in contract.names])


def write_grid(df: DataFrame, path: str) -> None:
    """A grid table by month, and by source where it has one, so scans prune to what a job needs."""
    keys = [c for c in ("source", "obs_month") if c == "obs_month" or c in df.columns]
    parts = df.withColumn("obs_month", F.date_format("ts", "yyyy-MM"))
    parts.hint("rebalance", *map(F.col, keys)).write.mode("overwrite").partitionBy(*keys).parquet(path)
