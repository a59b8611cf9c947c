"""Forecast features for half-month chunks of events, resumable."""

from pyspark.sql import DataFrame, functions as F

from floodframe import constants as K
from floodframe.functions.dates import parse_date_robust, pick_date_column
from floodframe.operators import chunks, cleaning, forecast
from floodframe.session import cut_lineage
from floodframe.sources import commit_log


def plan_chunks(raw: DataFrame, start_day: int = 1, end_day: int = 31) -> DataFrame:
    """Usable events of the day range with their chunk and whether it reaches into the time of forecasts."""
    day = pick_date_column(raw.columns)
    if day is None:
        raise ValueError("no start-date column found")
    dated = raw.withColumn("flood_start_date", parse_date_robust(F.col(day).cast("string"))).where(F.col("flood_start_date").isNotNull())
    usable = chunks.select_days(cleaning.filter_bad_periods(dated), start_day, end_day)
    return chunks.with_chunk(usable)


def _enriched(events: DataFrame, fc: DataFrame, domain: str) -> DataFrame:
    """Forecast features of the chunks that need them, nulls for the others."""
    needs = chunks.needs_forecast(events, commit_log.CHUNK)
    marked = events.join(needs, commit_log.CHUNK)
    with_fc = forecast.with_forecast(marked.where("need_forecast").drop("need_forecast"), fc, domain=domain)
    nothing = {c: F.lit(None).cast("double") for c in K.FORECAST_FEATURES} | {"forecast_spatial_strategy": F.lit(None).cast("string")}
    without = marked.where("NOT need_forecast").drop("need_forecast", *nothing).withColumns(nothing)
    return cleaning.drop_leaky(with_fc.unionByName(without))


def run_chunks(raw: DataFrame, fc: DataFrame, path: str, start_day: int = 1, end_day: int = 31, domain: str = "180", commits: int | None = None) -> int:
    """Enrich every chunk of ``raw`` that the ledger under ``path`` lacks, a year per commit; gives the number of commits made.

    ``commits`` stops after so many. A chunk without events is never written, as nothing could be read from it. Reads ``raw`` once.
    """
    spark = raw.sparkSession
    events = cut_lineage(spark, plan_chunks(raw, start_day, end_day))
    pending = cut_lineage(spark, chunks.pending_chunks(events.select(*commit_log.CHUNK).distinct(), commit_log.ledger(spark, path)))
    years = sorted(r["year"] for r in pending.select("year").distinct().collect())  # calendar years
    for year in years[:commits]:
        todo = events.join(pending.where(F.col("year") == year), commit_log.CHUNK, "left_semi")
        commit_log.commit(spark, path, commit_log.write_staged(_enriched(todo, fc, domain), path))
    return len(years[:commits])


def monthly_table(spark, path: str) -> DataFrame | None:
    """Events of the months both halves of which are committed."""
    return commit_log.committed_rows(spark, path, whole_months=True)
