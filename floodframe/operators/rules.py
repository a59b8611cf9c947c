"""Range rules, feature repair and quality checks, all generated from rule tables."""

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, functions as F, types as T

from floodframe import constants as K
from floodframe.functions.flood_types import mentions


def null_out_of_range(df: DataFrame, rules: Mapping[str, tuple[float, float]] = K.RANGE_RULES) -> DataFrame:
    """Null a numeric value that violates any rule whose pattern occurs in the column's name."""
    replaced = {}
    for field in df.schema.fields:
        limits = [r for pattern, r in rules.items() if pattern in field.name.lower()]
        if limits and isinstance(field.dataType, T.NumericType):
            c = F.col(field.name)
            ok = F.lit(True)
            for low, high in limits:
                ok = ok & c.between(low, high)
            replaced[field.name] = F.when(ok, c)
    return df.withColumns(replaced)


def _repaired(c: Column, kind: str, low: float | None, high: float | None) -> Column:
    near = K.REPAIR_CLAMP_TOLERANCE
    tiny = K.REPAIR_ZERO_TOLERANCE
    if kind == "allow_any":
        return c
    if kind == "bounded":
        return (
            F.when(F.abs(c) < tiny, 0.0)
            .when(c.between(low, high), c)
            .when((c < low) & (c > low - near), low)
            .when((c > high) & (c < high + near), high)
        )
    if kind == "non_negative":
        return F.when(c >= low, c).when(c > low - tiny, 0.0)
    if high is None:
        return F.when(c >= low, c)
    return F.when(c.between(low, high), c)


def repair_features(df: DataFrame, rules=K.REPAIR_RULES) -> DataFrame:
    """Clamp rounding noise at the edges of a feature's domain and null real violations."""
    present = set(df.columns)
    return df.withColumns({
        name: _repaired(F.col(name).cast("double"), kind, low, high)
        for name, (kind, low, high) in rules.items()
        if name in present
    })


def _fixed(c: Column, digits: int) -> Column:
    return F.format_string(f"%.{digits}f", c)


def quality_flags(
    df: DataFrame, day: str = "flood_start_date", now: Column | None = None
) -> DataFrame:
    """Append ``data_quality_issues``, ``data_quality_warnings`` (joined by a pipe) and ``data_quality_valid``.

    ``now`` is the moment a date counts as future; default the current time.
    """
    present = set(df.columns)
    get = lambda c: F.col(c).cast("double") if c in present else F.lit(None).cast("double")
    now = F.current_timestamp() if now is None else now
    flood = F.lower(F.coalesce(F.col("flood_type"), F.lit("none")) if "flood_type" in present else F.lit("unknown"))
    d = F.col(day)
    day_text = F.date_format(d, "yyyy-MM-dd")
    peak, week = get("gee_imerg_max_1h_intensity_mm"), get("gee_imerg_sum_7d_before_mm")
    soil, temp = get("gee_smap_surface_soil_moisture"), get("gee_gfs_temp2m_celsius")
    lat, lon = F.col("latitude"), F.col("longitude")

    no_rain = (F.coalesce(get("imerg_data_missing"), F.lit(0.0)) != 0) | (peak.isNull() & week.isNull())
    flash = (
        F.when(peak == 0, "zero_precipitation_flash_flood")
        .when(peak < K.CHECK_MIN_FLASH_MM_H, F.concat(F.lit("low_intensity_flash_flood_"), _fixed(peak, 1), F.lit("mm_hr")))
    )
    river = (
        F.when(week == 0, "zero_precipitation_riverine_flood")
        .when(week < K.CHECK_MIN_RIVER_7D_MM, F.concat(F.lit("low_precip_riverine_flood_"), _fixed(week, 1), F.lit("mm_7d")))
    )
    other = F.when(
        F.coalesce(peak == 0, F.lit(False)) | F.coalesce(week == 0, F.lit(False)),
        F.concat(F.lit("zero_precipitation_"), F.when(flood == "", "unknown").otherwise(flood)),
    )
    rain = (
        F.when(no_rain, "imerg_data_unavailable")
        .when(mentions(flood, K.CHECK_FLASH_TERMS), flash)
        .when(mentions(flood, K.CHECK_RIVER_TERMS), river)
        .when(mentions(flood, K.CHECK_DRY_TERMS), F.lit(None).cast("string"))
        .otherwise(other)
    )
    intensity = F.coalesce(*[get(c) for c in K.CHECK_INTENSITY_COLUMNS])
    issues = [
        F.when(intensity.isNull(), "missing_imerg_intensity_features"),
        F.when(d.cast("timestamp") > now, F.concat(F.lit("future_event_date_"), day_text)),
        F.when(~lat.between(-90, 90), F.concat(F.lit("invalid_latitude_"), lat.cast("string"))),
        F.when(~lon.between(-180, 180), F.concat(F.lit("invalid_longitude_"), lon.cast("string"))),
    ]
    warnings = [
        rain,
        F.when(soil.isNull(), "smap_surface_soil_moisture_missing"),
        F.when(temp.isNull() & get("gee_gfs_relative_humidity_pct").isNull(), "gfs_atmospheric_missing"),
        F.when(d < F.lit(K.RAIN_START), F.concat(F.lit("pre_imerg_era_"), day_text)),
        F.when(~soil.between(*K.CHECK_MOISTURE_RANGE), F.concat(F.lit("soil_moisture_out_of_range_"), _fixed(soil, 3))),
        F.when(~temp.between(*K.CHECK_TEMPERATURE_RANGE), F.concat(F.lit("temperature_out_of_range_"), _fixed(temp, 1), F.lit("C"))),
        *[
            F.when(F.col(f.name) < 0, F.concat(F.lit(f"negative_precip_value_{f.name}_"), F.col(f.name).cast("string")))
            for f in df.schema.fields
            if "imerg" in f.name and isinstance(f.dataType, T.NumericType)
        ],
    ]
    joined = lambda parts: F.array_join(F.array_compact(F.array(*parts)), "|")
    flagged = df.withColumns({"data_quality_issues": joined(issues), "data_quality_warnings": joined(warnings)})
    return flagged.withColumn("data_quality_valid", F.col("data_quality_issues") == "")


# ---- summaries --------------------------------------------------------------------------

def quality_totals(df: DataFrame) -> DataFrame:
    """Event counts by validity and the percentage without rain data; one row."""
    missing = F.coalesce(F.col("imerg_data_missing").cast("double"), F.lit(0.0)) if "imerg_data_missing" in df.columns else F.lit(None).cast("double")
    valid = F.col("data_quality_valid") if "data_quality_valid" in df.columns else F.lit(True)
    return df.agg(
        F.count(F.lit(1)).alias("total_events"),
        F.count_if(valid).alias("valid_events"),
        F.count_if(~valid).alias("invalid_events"),
        (F.avg(missing) * 100).alias("rain_missing_pct"),
    )


def common_issues(df: DataFrame, n: int = 10, column: str = "data_quality_issues") -> DataFrame:
    """The ``n`` most frequent issues."""
    return (
        df.where(F.col(column) != "")
        .select(F.explode(F.split(column, r"\|")).alias("issue"))
        .groupBy("issue").agg(F.count(F.lit(1)).alias("n"))
        .orderBy(F.desc("n"), "issue").limit(n)
    )


def value_counts(df: DataFrame, column: str, n: int | None = None, name: str = "n") -> DataFrame:
    """Rows per value, most frequent first; ``n`` keeps the top values only."""
    counted = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias(name))
    return counted.orderBy(F.desc(name), column).limit(n) if n else counted


def quality_summary(df: DataFrame) -> dict[str, DataFrame]:
    """Totals, commonest issues and events per flood type."""
    return {
        "totals": quality_totals(df),
        "common_issues": common_issues(df),
        "flood_type_counts": value_counts(df, "flood_type"),
    }


def catalogue_profile(df: DataFrame, day: str = "flood_start_date") -> dict[str, DataFrame]:
    """Extent of a catalogue in time and space, and its ten commonest flood types."""
    extent = df.agg(
        F.count(F.lit(1)).alias("events"),
        F.min(day).alias("first_date"), F.max(day).alias("last_date"),
        F.min("latitude").alias("lat_min"), F.max("latitude").alias("lat_max"),
        F.min("longitude").alias("lon_min"), F.max("longitude").alias("lon_max"),
    )
    return {"extent": extent, "flood_types": value_counts(df, "flood_type", 10)}
