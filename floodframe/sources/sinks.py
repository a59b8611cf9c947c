"""Partitioned and report outputs. Partitioned writes replace only the partitions they contain."""

from pyspark.sql import DataFrame, functions as F

from floodframe.functions.dates import half_month_part


def _write(df: DataFrame, path: str, parts: list[str], fmt: str) -> None:
    # rebalance splits a partition holding much of the data over several tasks and merges small ones
    writer = df.hint("rebalance", *[F.col(p) for p in parts]).write.mode("overwrite")
    writer = writer.option("partitionOverwriteMode", "dynamic").partitionBy(*parts)
    (writer.option("header", True) if fmt == "csv" else writer).format(fmt).save(path)


def write_monthly(df: DataFrame, path: str, day: str = "flood_start_date", fmt: str = "parquet") -> None:
    """Events by year and month; undated rows are left out."""
    dated = df.where(F.col(day).isNotNull()).withColumns({"year": F.year(day), "month": F.month(day)})
    _write(dated, path, ["year", "month"], fmt)


def write_enriched(df: DataFrame, path: str, day: str = "flood_start_date", fmt: str = "parquet") -> None:
    """Enriched events by year and month; reading the folder gives the combined table."""
    write_monthly(df, path, day, fmt)


def write_half_month(df: DataFrame, path: str, day: str = "flood_start_date", fmt: str = "parquet") -> None:
    """Events by year, month and half-month part."""
    dated = df.where(F.col(day).isNotNull()).withColumns({
        "year": F.year(day), "month": F.month(day), "part": half_month_part(F.col(day)),
    })
    _write(dated, path, ["year", "month", "part"], fmt)


def write_report_table(df: DataFrame, path: str, fmt: str = "json") -> None:
    """A metrics or summary table as JSON lines or CSV with a header."""
    writer = df.write.mode("overwrite")
    (writer.option("header", True) if fmt == "csv" else writer).format(fmt).save(path)
