"""Hydrological indices from rain, soil, terrain and weather columns."""

from pyspark.sql import Column, DataFrame, functions as F

_EPS = 1e-6


def index_columns(present: set[str], variant: str = "event") -> dict[str, Column]:
    """Index expressions; an input column that is absent counts as null.

    ``variant="pixel"`` guards divisors with a small constant where ``"event"`` yields null.
    """
    if variant not in ("event", "pixel"):
        raise ValueError(f"unknown variant {variant!r}")
    get = lambda name: F.col(name) if name in present else F.lit(None).cast("double")
    p24, p3, p7 = (get(f"gee_imerg_sum_{w}_mm") for w in ("24h", "3d_before", "7d_before"))
    peak = get("gee_imerg_max_1h_intensity_mm")
    slope, upstream = get("gee_slope_mean"), get("gee_merit_upa_mean")
    soil = get("gee_smap_surface_soil_moisture")
    wind, water = get("gee_gfs_wind_speed_ms"), get("gee_gfs_precipitable_water_kg_m2")

    if variant == "event":
        flash_day = F.try_divide(peak, F.nullif(p24, F.lit(0.0)) / 24.0)
        flash_week = F.when(p7 > 0, peak / (p7 / 7.0 + _EPS))
    else:
        flash_day = peak / (p24 / 24.0 + _EPS)
        flash_week = peak / (p7 / 7.0 + _EPS)
    gradient = F.tan(F.coalesce(F.radians(slope), F.lit(0.0)) + 0.001)
    return {
        "gee_api_weighted_mm": 0.5 * p24 + 0.3 * p3 + 0.2 * p7,
        "gee_flashiness_index": flash_day,
        "gee_saturation_proxy": F.try_divide(soil, p7 + 1.0),
        "gee_runoff_potential": F.try_divide(p24 * slope, soil + 0.01),
        "gee_twi": F.log(F.try_divide(upstream + 1.0, gradient)),
        "gee_moisture_flux": water * wind,
        "gee_antecedent_moisture_proxy": 0.6 * p3 + 0.4 * p7,
        "gee_flashiness_index_7d": flash_week,
        "gee_precip_x_slope": p7 * slope,
    }


def engineer_features(df: DataFrame, variant: str = "event") -> DataFrame:
    """Append the index columns. The pixel variant keeps a wetness index that is already there."""
    present = set(df.columns)
    columns = index_columns(present, variant)
    if variant == "pixel":
        columns.pop("gee_moisture_flux")
        if "gee_twi" in present:
            columns.pop("gee_twi")
    return df.withColumns(columns)
