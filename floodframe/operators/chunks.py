"""Request plans, chunk ledgers and what is left to process."""

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from floodframe import constants as K
from floodframe.functions.dates import classify_release, half_month_part
from floodframe.operators.cleaning import filter_bad_periods

_CHUNK = ["year", "month", "part"]


def ledger_rollup(ledger: DataFrame, request: str = "request") -> DataFrame:
    """Counts, overall status and unfinished chunks per request of ``(request, chunk, status)``.

    A request's chunks are calendar pieces, so the list of unfinished ones is short.
    """
    done = F.col("status") == "completed"
    totals = ledger.groupBy(request).agg(
        F.count(F.lit(1)).alias("total_chunks"),
        F.count_if(done).alias("successful_chunks"),
        F.array_sort(F.collect_list(F.when(~F.coalesce(done, F.lit(False)), F.col("chunk")))).alias("failed_chunks"),
    )
    good, total = F.col("successful_chunks"), F.col("total_chunks")
    return totals.withColumn(
        "status", F.when(good == total, "completed").when(good > 0, "partial").otherwise("failed")
    )


def with_chunk(df: DataFrame, day: str = "flood_start_date") -> DataFrame:
    """Append the year, month and half-month part of the date."""
    d = F.col(day)
    return df.withColumns({"year": F.year(d), "month": F.month(d), "part": half_month_part(d)})


def select_days(df: DataFrame, start_day: int, end_day: int, day: str = "flood_start_date") -> DataFrame:
    return df.where(F.dayofmonth(day).between(start_day, end_day))


def expand_ranges(ranges: DataFrame) -> DataFrame:
    """One row per date of ``(start_date, end_date)`` ranges."""
    return ranges.select(F.explode(F.sequence("start_date", "end_date")).alias("day"))


def plan_requests(days: DataFrame) -> DataFrame:
    """Usable dates grouped by model and calendar month, sorted within a group."""
    usable = filter_bad_periods(days.where(F.col("day").isNotNull()), day="day").select("day").distinct()
    return (
        usable.groupBy(
            classify_release(F.col("day"))["model_name"].alias("model"),
            F.year("day").alias("year"), F.month("day").alias("month"),
        )
        .agg(F.sort_array(F.collect_list("day")).alias("days"), F.count(F.lit(1)).alias("n_days"))
    )


def needs_forecast(df: DataFrame, keys: Sequence[str], day: str = "flood_start_date") -> DataFrame:
    """Per group: whether any date falls after forecasts began."""
    return df.groupBy(*keys).agg(
        F.bool_or(F.coalesce(F.col(day) >= F.lit(K.FORECAST_START), F.lit(False))).alias("need_forecast")
    )


def pending_chunks(plan: DataFrame, done: DataFrame) -> DataFrame:
    """Planned chunks not written yet."""
    return plan.join(done.select(*_CHUNK).distinct(), _CHUNK, "left_anti")


def complete_months(parts: DataFrame) -> DataFrame:
    """Rows of the months whose two halves are both there."""
    halves = parts.select(*_CHUNK).distinct().groupBy("year", "month").agg(F.count(F.lit(1)).alias("n"))
    return parts.join(halves.where(F.col("n") == 2), ["year", "month"], "left_semi")


def continue_from(df: DataFrame, month: int, day: str = "flood_start_date") -> DataFrame:
    """Dated rows from ``month`` of the first year that has that month (else the year after the earliest) onwards."""
    dated = df.where(F.col(day).isNotNull())
    if month <= 1:
        return dated
    year, m = F.year(day), F.month(day)
    first = dated.agg(F.coalesce(F.min(F.when(m == month, year)), F.min(year) + 1)).scalar()
    return dated.where((year > first) | ((year == first) & (m >= month)))
