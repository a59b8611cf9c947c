"""Event catalogue to feature table."""

from collections.abc import Mapping

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from floodframe import constants as K
from floodframe.functions.dates import date_from_parts, parse_date_robust, pick_date_column
from floodframe.functions.indices import engineer_features
from floodframe.operators import chunks, cleaning, forecast, negatives, rules, spacetime, zonal
from floodframe.session import cut_lineage
from floodframe.sources.sinks import write_enriched

STATIC_MEANS = ("elevation", "slope", "aspect", "gsw_occurrence", "merit_upa")


def load_catalogue(raw: DataFrame) -> DataFrame:
    """Typed, located and dated events from a raw catalogue."""
    columns = {c.lower(): c for c in raw.columns}
    if "start_date" in columns:
        day = parse_date_robust(F.col(columns["start_date"]))
    elif {"start year", "start month", "start day"} <= set(columns):
        day = date_from_parts(*[F.col(f"`{columns[n]}`") for n in ("start year", "start month", "start day")])
    else:
        day = parse_date_robust(F.col(pick_date_column(raw.columns) or cleaning.detect_date_column(raw)))
    located = cleaning.resolve_coords(raw.withColumn("flood_start_date", day))
    return cleaning.with_event_defaults(cleaning.filter_valid_events(located))


def training_events(positives: DataFrame) -> DataFrame:
    """Positives with their later flood days, and negatives before them; identifiers become text."""
    positives = positives.withColumn("event_id", F.col("event_id").cast("string"))
    return negatives.combine_events(
        negatives.augment_by_duration(positives), negatives.negatives_time_offset(positives)
    )


def enrich(events: DataFrame, grids: Mapping[str, DataFrame], now: Column | None = None) -> DataFrame:
    """Append rain, soil, weather, terrain and index features, repaired and checked.

    Every feature family starts from one written table of distinct anchors and the families meet on
    the anchor key, so no family repeats the work of another.

    ``grids`` may hold ``rain`` (with ``source``), ``moisture``, ``weather``, ``images``, ``static``
    and ``land_cover``; the features of a grid that is not given are left out.
    """
    anchored = spacetime.event_anchors(cleaning.with_calendar(events))
    anchors = cut_lineage(events.sparkSession, anchored.select(*spacetime.ANCHOR).distinct())
    own = F.col("buffer")
    steps = {
        "rain": lambda g: spacetime.rain_features(anchors, g, buffer=own),
        "moisture": lambda g: spacetime.moisture_features(anchors, g, buffer=own),
        "weather": lambda g: spacetime.weather_features(anchors, g, buffer=own),
        "images": lambda g: spacetime.index_features(anchors, g, buffer=own),
        "static": lambda g: zonal.zonal_mean(anchors, g, STATIC_MEANS, own),
        "land_cover": lambda g: zonal.zonal_fraction(
            zonal.zonal_mode(anchors, g, "land_cover", own), g, "land_cover", K.URBAN_CLASS, own),
    }
    parts = [step(grids[name]) for name, step in steps.items() if name in grids]
    df = anchored
    if parts:
        wide = reduce(lambda a, b: a.join(b, spacetime.ANCHOR), parts)
        df = df.join(wide, spacetime.ANCHOR, "left")
    df = df.drop("buffer")
    df = engineer_features(df)
    df = rules.null_out_of_range(rules.repair_features(df))
    return rules.quality_flags(df, now=now)


def enrich_and_write(positives: DataFrame, grids: Mapping[str, DataFrame], path: str, from_month: int = 1) -> None:
    """The whole run: training events, optional continuation, features, stamps, monthly partitions."""
    events = chunks.continue_from(training_events(positives), from_month)
    write_enriched(cleaning.with_lineage(enrich(events, grids)), path)


def attach_forecasts(raw: DataFrame, fc: DataFrame, domain: str = "180") -> DataFrame:
    """Monthly events with forecast features, without bad periods and leaking columns."""
    day = pick_date_column(raw.columns)
    if day is None:
        raise ValueError("no start-date column found")
    dated = raw.withColumn("flood_start_date", parse_date_robust(F.col(day).cast("string")))
    usable = cleaning.filter_bad_periods(dated.where(F.col("flood_start_date").isNotNull()))
    usable = cut_lineage(raw.sparkSession, usable)  # read several times below; parse the text once
    return cleaning.drop_leaky(forecast.with_forecast(usable, fc, domain=domain))
