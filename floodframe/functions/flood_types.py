"""Flood-type text to extraction strategy and buffer size."""

from collections.abc import Iterable

from pyspark.sql import Column, functions as F

from floodframe import constants as K


def mentions(text: Column, terms: Iterable[str]) -> Column:
    return text.rlike("|".join(terms))


def _lowered(flood_type: Column) -> Column:
    return F.lower(F.coalesce(flood_type, F.lit("")))


def spatial_strategy(flood_type: Column) -> Column:
    """``hybrid`` for mixed types, ``nearest`` for local ones, ``mean_bbox`` for basin-wide ones."""
    text = _lowered(flood_type)
    basin = mentions(text, K.STRATEGY_MEAN_TERMS)
    mixed = text.contains("/") | text.contains("mixed") | (basin & mentions(text, K.STRATEGY_MIXED_WITH))
    return (
        F.when(mixed, "hybrid")
        .when(mentions(text, K.STRATEGY_NEAREST_TERMS), "nearest")
        .when(basin, "mean_bbox")
        .otherwise("nearest")
    )


def buffer_m(flood_type: Column, kind: str = "features") -> Column:
    """Buffer radius in metres, for feature windows or for forecast boxes."""
    text = _lowered(flood_type)
    if kind == "forecast":
        return F.when(mentions(text, K.STRATEGY_MEAN_TERMS), K.FORECAST_RIVER_BUFFER_M).otherwise(K.FORECAST_BUFFER_M)
    return (
        F.when(mentions(text, K.BUFFER_SMALL_TERMS), K.FEATURE_BUFFER_M)
        .when(mentions(text, K.BUFFER_LARGE_TERMS), K.WATERSHED_BUFFER_M)
        .otherwise(K.FEATURE_BUFFER_M)
    )
