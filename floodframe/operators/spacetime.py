"""Space-time windows: observations in a box around an event and a window before it.

The shape is always the same: per cell over time first, then the mean over cells. The plan is

1. observations -> one row per (cell, time slot), a map-side-combined aggregate done once,
2. distinct (place, date, buffer) anchors -> the cells in their boxes, by bucketed equi-join,
3. anchors' (cell, slot) marks go into the slot table and every window is read off one sorted
   pass with range frames, so no observation is copied per event,
4. marks rejoin their anchors, are averaged over cells, and anchors rejoin the events.

A cell's partition in step 3 is bounded by its number of distinct slots, whatever the number of raw
observations or events there.
"""

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from floodframe import constants as K
from floodframe.functions.flood_types import buffer_m
from floodframe.functions.geo import bbox, cells_in_boxes

_DAY = 86_400
PLACE = ["latitude", "longitude", "buffer"]
ANCHOR = ["latitude", "longitude", "flood_start_date", "buffer"]


@dataclass(frozen=True)
class WindowStat:
    """A statistic of ``series`` over slots ``[start, end)`` relative to the event.

    ``how``: ``sum``, ``max``, ``mean``, or ``peak`` (largest slot sum, an absent slot counting as 0).
    """

    name: str
    series: str
    start: int
    end: int
    how: str
    scale: float = 1.0


def event_anchors(events: DataFrame, buffer: Column | float | None = None) -> DataFrame:
    """Events with the ``buffer`` column their anchor is keyed by."""
    if buffer is None:
        buffer = buffer_m(F.col("flood_type"))
    buffer = buffer if isinstance(buffer, Column) else F.lit(buffer)
    return events.withColumn("buffer", buffer.cast("double"))


def anchor_cells(anchored: DataFrame, cells: DataFrame, step: float = 0.5) -> DataFrame:
    """Distinct anchors paired with the cells in their boxes; boxes are matched once per place, not per date."""
    anchors = anchored.select(*ANCHOR).distinct().where("latitude IS NOT NULL AND longitude IS NOT NULL")
    boxes = anchors.select(*PLACE).distinct().withColumns(bbox(F.col("latitude"), F.col("longitude"), F.col("buffer")))
    return anchors.join(cells_in_boxes(boxes, cells, step).select(*PLACE, "cell_id"), PLACE)


def cell_table(obs: DataFrame) -> DataFrame:
    """The distinct cells of an observation table."""
    return obs.select("cell_id", F.col("latitude").alias("cell_lat"), F.col("longitude").alias("cell_lon")).distinct()


def within_reach(obs: DataFrame, events: DataFrame, days_before: int, days_after: int) -> DataFrame:
    """Observations any event's window can touch.

    The bounds are scalar subqueries over the events. Of a table written by month (``obs_month``, see ``sources.grids``) only the months
    some window touches are listed and read, however far apart they lie; finding these calendar months runs a job. Elsewhere the bound
    on ``ts`` filters after the scan.
    """
    first, last = F.date_sub(F.min("flood_start_date"), days_before), F.date_add(F.max("flood_start_date"), days_after)
    ts_type = dict(obs.dtypes)["ts"]
    held = obs.where((F.col("ts") >= events.agg(first).scalar().cast(ts_type)) & (F.col("ts") < events.agg(last).scalar().cast(ts_type)))
    if "obs_month" not in obs.columns:
        return held
    day = F.col("flood_start_date")
    touched = F.sequence(F.trunc(F.date_sub(day, days_before), "month"), F.date_add(day, days_after), F.expr("INTERVAL 1 MONTH"))
    months = events.where(day.isNotNull()).select(F.explode(touched).alias("_t")).select(F.date_format("_t", "yyyy-MM")).distinct().collect()
    return held.where(F.col("obs_month").isin(sorted(r[0] for r in months)))


def _slot_of(ts: Column, seconds: int) -> Column:
    return F.floor(F.unix_seconds(ts.cast("timestamp")) / seconds).cast("long")


def _slot_table(obs, series, stats, seconds):
    needed = {"sum": ("sum",), "max": ("max",), "mean": ("sum", "n"), "peak": ("sum",)}
    parts = sorted({(s.series, p) for s in stats for p in needed[s.how]})
    make = {"sum": F.sum, "max": F.max, "n": F.count}
    keyed = obs.select(
        "cell_id", _slot_of(F.col("ts"), seconds).alias("slot"),
        *[series[name].cast("double").alias(name) for name in sorted({s for s, _ in parts})],
    )
    return keyed.groupBy("cell_id", "slot").agg(*[make[p](s).alias(f"{s}__{p}") for s, p in parts])


def _over(stat: WindowStat, by_cell) -> Column:
    frame = by_cell.rangeBetween(stat.start, stat.end - 1)
    total = F.sum(f"{stat.series}__sum").over(frame) if stat.how != "max" else None
    if stat.how == "sum":
        value = total
    elif stat.how == "max":
        value = F.max(f"{stat.series}__max").over(frame)
    elif stat.how == "mean":
        value = F.try_divide(total, F.sum(f"{stat.series}__n").over(frame))
    elif stat.how == "peak":
        peak = F.max(f"{stat.series}__sum").over(frame)
        filled = F.count(f"{stat.series}__sum").over(frame)
        value = F.when(filled < stat.end - stat.start, F.greatest(peak, F.when(peak.isNotNull(), 0.0))).otherwise(peak)
    else:
        raise ValueError(f"unknown statistic {stat.how!r}")
    return value * stat.scale if stat.scale != 1.0 else value


def window_features(
    events: DataFrame,
    obs: DataFrame,
    stats: Sequence[WindowStat],
    series: Mapping[str, Column] | None = None,
    cell_columns: Mapping[str, Column] | None = None,
    outputs: Sequence[str] | None = None,
    buffer: Column | float | None = None,
    cells: DataFrame | None = None,
    seconds: int = _DAY,
    step: float = 0.5,
) -> DataFrame:
    """Append window statistics to ``events`` (``latitude longitude flood_start_date [flood_type]``).

    ``obs``: ``cell_id latitude longitude ts value ...``. ``series`` names per-observation
    expressions (default ``value``). ``cell_columns`` are computed per cell from the statistics
    before the mean over cells. ``outputs`` picks what is averaged (default all). ``cells``
    (``cell_id cell_lat cell_lon``) spares the distinct scan where a cell table exists.
    """
    series = dict(series or {"value": F.col("value")})
    outputs = list(outputs or [s.name for s in stats] + list(cell_columns or {}))
    anchored = event_anchors(events, buffer)
    per_day = _DAY // seconds
    lo, hi = min(s.start for s in stats), max(s.end for s in stats)
    reach = within_reach(obs, events, -(lo // per_day), max(1, -(-hi // per_day)))

    pairs = anchor_cells(anchored, cell_table(reach) if cells is None else cells, step).withColumn(
        "slot", _slot_of(F.col("flood_start_date"), seconds)
    )
    marks = pairs.select("cell_id", "slot").distinct().withColumn("_mark", F.lit(True))
    slots = _slot_table(reach, series, stats, seconds)
    by_cell = Window.partitionBy("cell_id").orderBy("slot")
    rolled = (
        slots.unionByName(marks, allowMissingColumns=True)
        .select("cell_id", "slot", "_mark", *[_over(s, by_cell).alias(s.name) for s in stats])
        .where("_mark")
    )
    if cell_columns:
        rolled = rolled.withColumns(dict(cell_columns))
    rolled = rolled.select("cell_id", "slot", *outputs)
    means = pairs.join(rolled, ["cell_id", "slot"]).groupBy(*ANCHOR).agg(*[F.avg(c).alias(c) for c in outputs])
    return attach(events, anchored, means, outputs)


def attach(events: DataFrame, anchored: DataFrame, means: DataFrame, outputs: Sequence[str]) -> DataFrame:
    """Rejoin anchor-level results to the events."""
    keep = [c for c in events.columns if c not in outputs]
    return anchored.drop(*outputs).join(means, ANCHOR, "left").select(*keep, *outputs)


# ---- rain, half-hourly rates ---------------------------------------------------------------

def rain_event_day(events: DataFrame, obs: DataFrame, before: bool = False, **options) -> DataFrame:
    """Rain on the event day, or in the 24 hours up to it (``before``): total, peak and mean rate, longer-peak proxies."""
    lo, hi = (-1, 0) if before else (0, 1)
    stats = [
        WindowStat("gee_imerg_sum_24h_mm", "value", lo, hi, "sum", 0.5),
        WindowStat("gee_imerg_max_1h_intensity_mm", "value", lo, hi, "max"),
        WindowStat("imerg_mean_1h_intensity_mm", "value", lo, hi, "mean"),
    ]
    return with_peak_proxies(window_features(events, obs, stats, **options))


def with_peak_proxies(df: DataFrame, peak: str = "gee_imerg_max_1h_intensity_mm") -> DataFrame:
    return df.withColumns({
        "imerg_max_1h_intensity_mm": F.col(peak),
        "gee_imerg_max_3h_intensity_mm": F.col(peak) * 1.5,
        "gee_imerg_max_6h_intensity_mm": F.col(peak) * 2.0,
    })


def antecedent_stats(series: str = "value") -> list[WindowStat]:
    return [
        WindowStat("gee_imerg_sum_3d_before_mm", series, -3, 0, "sum", 0.5),
        WindowStat("gee_imerg_sum_7d_before_mm", series, -7, 0, "sum", 0.5),
    ]


def peak_day_stat(series: str = "value") -> WindowStat:
    return WindowStat("gee_imerg_max_daily_7d_mm", series, -7, 0, "peak", 0.5)


def with_daily_rates(df: DataFrame) -> DataFrame:
    return df.withColumns({
        f"gee_imerg_intensity_{n}d_mm_per_day": F.col(f"gee_imerg_sum_{n}d_before_mm") / float(n) for n in (3, 7)
    })


def rain_antecedent(events: DataFrame, obs: DataFrame, **options) -> DataFrame:
    """Three- and seven-day rain before the event and the daily rates."""
    return with_daily_rates(window_features(events, obs, antecedent_stats(), **options))


def rain_max_daily(events: DataFrame, obs: DataFrame, **options) -> DataFrame:
    """Wettest of the seven days before the event."""
    return window_features(events, obs, [peak_day_stat()], **options)


RAIN_COLUMNS = (
    "gee_imerg_sum_24h_mm", "gee_imerg_max_1h_intensity_mm", "imerg_mean_1h_intensity_mm",
    "imerg_max_1h_intensity_mm", "gee_imerg_max_3h_intensity_mm", "gee_imerg_max_6h_intensity_mm",
    "gee_imerg_sum_3d_before_mm", "gee_imerg_sum_7d_before_mm", "gee_imerg_max_daily_7d_mm",
    "gee_imerg_intensity_3d_mm_per_day", "gee_imerg_intensity_7d_mm_per_day",
    "imerg_data_missing", "imerg_extraction_failed", "imerg_source", "imerg_coverage_note",
)


def rain_features(events: DataFrame, obs: DataFrame, **options) -> DataFrame:
    """All rain features from two runs of one source (column ``source``: ``early`` or ``late``).

    The event day uses the early run where it exists for that date, else (or if it has no data) the
    late run; history uses the late run. Nothing found means zeros with flags. One pass over ``obs``.
    """
    runs = {name: F.when(F.col("source") == name, F.col("value")) for name in ("early", "late")}
    stats = [
        stat
        for run in runs
        for stat in (
            WindowStat(f"_{run}_sum", run, 0, 1, "sum", 0.5),
            WindowStat(f"_{run}_max", run, 0, 1, "max"),
            WindowStat(f"_{run}_mean", run, 0, 1, "mean"),
        )
    ] + antecedent_stats("late") + [peak_day_stat("late")]
    found = window_features(events, obs.where(F.col("source").isin(*runs)), stats, series=runs, **options)

    day = F.col("flood_start_date")
    before_era = day < F.lit(K.RAIN_START)
    try_early = day >= F.lit(K.RAIN_EARLY_START)
    use_early = try_early & F.col("_early_sum").isNotNull() & ~before_era
    use_late = ~use_early & F.col("_late_sum").isNotNull() & ~before_era
    late_name = F.when(try_early, "late_final").otherwise("late")
    missing = ~(F.coalesce(use_early, F.lit(False)) | F.coalesce(use_late, F.lit(False)))

    def chosen(part):
        return F.coalesce(F.when(use_early, F.col(f"_early_{part}")), F.when(use_late, F.col(f"_late_{part}")), F.lit(0.0))

    def history(name):
        return F.when(before_era, 0.0).otherwise(F.coalesce(F.col(name), F.lit(0.0)))

    filled = found.withColumns({
        "gee_imerg_sum_24h_mm": chosen("sum"),
        "gee_imerg_max_1h_intensity_mm": chosen("max"),
        "imerg_mean_1h_intensity_mm": chosen("mean"),
        **{s.name: history(s.name) for s in antecedent_stats() + [peak_day_stat()]},
        "imerg_data_missing": missing.cast("int"),
        "imerg_extraction_failed": F.when(~F.coalesce(before_era, F.lit(False)), missing.cast("int")),
        "imerg_source": F.when(day.isNull(), "unavailable").when(before_era, "none").when(use_early, "early").otherwise(late_name),
        "imerg_coverage_note": F.when(before_era, "pre_imerg_era").otherwise(""),
    })
    complete = with_daily_rates(with_peak_proxies(filled))
    return complete.select(*[c for c in events.columns if c not in RAIN_COLUMNS], *RAIN_COLUMNS)


# ---- soil moisture and weather ------------------------------------------------------------------

def moisture_features(
    events: DataFrame, obs: DataFrame, surface: str = "sm_surface", rootzone: str = "sm_rootzone",
    include_event_day: bool = True, **options,
) -> DataFrame:
    """Recent soil moisture (three days and, by default, the event day) and its anomaly against 30-60 days earlier."""
    end = 1 if include_event_day else 0
    series = {n: F.when(F.col("variable") == v, F.col("value")) for n, v in (("top", surface), ("root", rootzone))}
    stats = [
        WindowStat("gee_smap_surface_soil_moisture", "top", -3, end, "mean"),
        WindowStat("gee_smap_subsurface_soil_moisture", "root", -3, end, "mean"),
        WindowStat("_normal", "top", -60, -30, "mean"),
    ]
    found = window_features(events, obs.where(F.col("variable").isin(surface, rootzone)), stats, series=series, **options)
    return found.withColumn(
        "gee_smap_soil_moisture_anomaly", F.col("gee_smap_surface_soil_moisture") - F.col("_normal")
    ).drop("_normal")


WEATHER_VARIABLES = {
    "temperature": "temperature_2m_above_ground",
    "humidity": "relative_humidity_2m_above_ground",
    "pressure": "pressure_surface",
    "water": "precipitable_water_entire_atmosphere",
    "u": "u_component_of_wind_10m_above_ground",
    "v": "v_component_of_wind_10m_above_ground",
}


def weather_features(
    events: DataFrame, obs: DataFrame, variables: Mapping[str, str] | None = None, **options
) -> DataFrame:
    """Means over the twelve hours before the event day; wind speed from mean components per cell."""
    variables = {**WEATHER_VARIABLES, **(variables or {})}
    series = {n: F.when(F.col("variable") == v, F.col("value")) for n, v in variables.items()}
    stats = [WindowStat(f"_{n}", n, -1, 0, "mean") for n in series]
    named = {
        "gee_gfs_temp2m_celsius": F.col("_temperature") - 273.15,
        "gee_gfs_relative_humidity_pct": F.col("_humidity"),
        "gee_gfs_surface_pressure_pa": F.col("_pressure"),
        "gee_gfs_precipitable_water_kg_m2": F.col("_water"),
        "gee_gfs_wind_speed_ms": F.sqrt(F.col("_u") * F.col("_u") + F.col("_v") * F.col("_v")),
    }
    wanted = obs.where(F.col("variable").isin(*variables.values()))
    return window_features(
        events, wanted, stats, series=series, cell_columns=named, outputs=list(named), seconds=_DAY // 2, **options
    )


# ---- spectral indices -------------------------------------------------------------------------------

def pivot_bands(obs: DataFrame, bands: Sequence[str], extra: Sequence[str] = ()) -> DataFrame:
    """One row per image and cell with a column per band, from long observations."""
    return obs.where(F.col("variable").isin(*bands)).groupBy("cell_id", "latitude", "longitude", "ts", *extra).agg(
        *[F.avg(F.when(F.col("variable") == b, F.col("value"))).alias(b) for b in bands]
    )


def _contrast(a: Column, b: Column) -> Column:
    return F.try_divide(a - b, a + b + K.INDEX_EPS)


def index_features(
    events: DataFrame, obs: DataFrame,
    ndvi: str = "NDVI", green: str = "SR_B3", nir: str = "SR_B5", swir: str = "SR_B6", **options,
) -> DataFrame:
    """Thirty-day means of vegetation, built-up and water indices, each computed per image."""
    images = pivot_bands(within_reach(obs, events, 30, 1), [ndvi, green, nir, swir])
    scaled = lambda c: F.col(c) * K.SURFACE_REFLECTANCE_SCALE + K.SURFACE_REFLECTANCE_OFFSET
    series = {
        "ndvi": F.col(ndvi) * K.NDVI_SCALE,
        "ndbi": _contrast(scaled(swir), scaled(nir)),
        "ndwi": _contrast(scaled(green), scaled(nir)),
    }
    stats = [WindowStat(f"gee_{n}_mean_30d", n, -30, 0, "mean") for n in series]
    return window_features(events, images, stats, series=series, **options)


def clear_sky_index_features(
    events: DataFrame, images: DataFrame, red: str = "B4", nir: str = "B8", green: str = "B3",
    buffer: Column | float | None = None, cells: DataFrame | None = None, step: float = 0.5,
) -> DataFrame:
    """Indices of the per-cell median of clear pixels over 30 days, averaged over cells.

    ``images``: ``cell_id latitude longitude ts scene_class cloud_pct`` and one column per band. Images are gathered per cell and
    30-day period, each also into the period after its own, so one list holds all an event's window can want: an image moves twice,
    however many events want it.
    """
    span = 30
    clear = within_reach(images, events, span, 0).where(
        (F.col("cloud_pct") < K.MAX_CLOUD_PERCENT) & F.col("scene_class").isin(*K.CLEAR_SCENE_CLASSES)
    )
    bands = [red, nir, green]
    slot = _slot_of(F.col("ts"), _DAY)
    keyed = clear.select("cell_id", slot.alias("slot"), *bands).withColumn("_own", F.floor(F.col("slot") / span))
    gathered = keyed.withColumn("_period", F.explode(F.array("_own", F.col("_own") + 1))).groupBy("cell_id", "_period").agg(
        F.collect_list(F.struct("slot", *bands)).alias("_images"))
    anchored = event_anchors(events, buffer)
    pairs = anchor_cells(anchored, cell_table(clear) if cells is None else cells, step)
    day = _slot_of(F.col("flood_start_date"), _DAY)
    wanted = pairs.select("cell_id", "flood_start_date").distinct().withColumn("_day", day).withColumn(
        "_period", F.floor((F.col("_day") - 1) / span))
    first, last = F.col("_day") - span, F.col("_day") - 1
    within = F.filter("_images", lambda i: i["slot"].between(first, last))
    scaled = lambda band: F.transform("_images", lambda i: i[band] / 10_000)
    medians = (
        wanted.join(gathered, ["cell_id", "_period"]).select("cell_id", "flood_start_date", within.alias("_images"))
        .select("cell_id", "flood_start_date", *[_median(scaled(b)).alias(b) for b in bands])
    )
    ratio = lambda a, b: F.try_divide(F.col(a) - F.col(b), F.col(a) + F.col(b))
    per_cell = medians.select("cell_id", "flood_start_date", ratio(nir, red).alias("NDVI"), ratio(green, nir).alias("NDWI"))
    outputs = ["NDVI", "NDWI"]
    means = pairs.join(per_cell, ["cell_id", "flood_start_date"]).groupBy(*ANCHOR).agg(*[F.avg(c).alias(c) for c in outputs])
    return attach(events, anchored, means, outputs)


def _median(values: Column) -> Column:
    """Median of the known values of a list; null for none."""
    known = F.sort_array(F.array_compact(values))
    n = F.size(known)
    at = lambda i: F.get(known, F.floor(i).cast("int"))
    return F.when(n > 0, 0.5 * at((n - 1) / 2) + 0.5 * at(n / 2))


# ---- daily rain ------------------------------------------------------------------------------------------

def daily_rain_features(events: DataFrame, obs: DataFrame, **options) -> DataFrame:
    """Daily rain totals over 1, 3, 7 and 30 days, 3- and 7-day maxima; no data counts as 0."""
    prefix = "gee_chirps_precip"
    stats = [WindowStat(f"{prefix}_sum_{n}d_before", "value", -n, 0, "sum") for n in (1, 3, 7, 30)]
    stats += [WindowStat(f"{prefix}_max_{n}d", "value", -n, 0, "max") for n in (3, 7)]
    found = window_features(events, obs, stats, **options)
    filled = found.withColumns({s.name: F.coalesce(F.col(s.name), F.lit(0.0)) for s in stats})
    week = F.col(f"{prefix}_sum_7d_before")
    return filled.withColumn(f"{prefix}_intensity_7d_before", F.when(week > 0, week / 7.0).otherwise(0.0))


def rate_rain_features(events: DataFrame, obs: DataFrame, lookback_days: int = 30, **options) -> DataFrame:
    """Plain sums of rates one and seven days before the event window, the window's peak rate and six times it.

    ``flood_start_date`` opens the window, which lasts ``lookback_days``.
    """
    prefix = "gee_gpm_precip"
    stats = [
        WindowStat(f"{prefix}_sum_1d_before", "value", -1, 0, "sum"),
        WindowStat(f"{prefix}_sum_7d_before", "value", -7, 0, "sum"),
        WindowStat(f"{prefix}_max_rate_event_mmhr", "value", 0, lookback_days, "max"),
    ]
    found = window_features(events, obs, stats, **options)
    filled = found.withColumns({s.name: F.coalesce(F.col(s.name), F.lit(0.0)) for s in stats})
    return filled.withColumn(f"{prefix}_sum_max_6h_event_mm", F.col(stats[2].name) * 6.0)


def long_rain_features(events: DataFrame, obs: DataFrame, **options) -> DataFrame:
    """Rain totals and maxima over 30 and 90 days; windows without data stay null."""
    stats = [
        WindowStat(f"precip_{label}_{n}d", "value", -n, 0, how)
        for n in (30, 90) for label, how in (("total", "sum"), ("max", "max"))
    ]
    return window_features(events, obs, stats, **options)
