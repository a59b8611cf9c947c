"""Distances, boxes and the bucket keys that turn spatial predicates into equi-joins."""

from pyspark.sql import Column, DataFrame, functions as F

from floodframe import constants as K
from floodframe.functions.numbers import clamp


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance in kilometres."""
    half = lambda a, b: F.pow(F.sin(F.radians(b - a) / 2.0), 2.0)
    a = half(lat1, lat2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * half(lon1, lon2)
    a = clamp(a, high=1.0)
    return F.lit(2.0 * K.EARTH_RADIUS_KM) * F.atan2(F.sqrt(a), F.sqrt(F.lit(1.0) - a))


def mercator_xy(lat: Column, lon: Column) -> tuple[Column, Column]:
    """Web-Mercator metres (latitude clipped to the projection's domain)."""
    lat = clamp(lat, -89.5, 89.5)
    x = F.lit(K.MERCATOR_RADIUS_M) * F.radians(lon)
    y = F.lit(K.MERCATOR_RADIUS_M) * F.log(F.tan(F.pi() / 4.0 + F.radians(lat) / 2.0))
    return x, y


def bbox(lat: Column, lon: Column, metres: Column, uniform: bool = False) -> dict[str, Column]:
    """Box around a point; ``uniform`` uses 111 km per degree both ways.

    Longitudes may run past +-180; the half-width is capped at the half circle near the poles.
    """
    per_lat = F.lit(111_000.0 if uniform else K.METRES_PER_DEGREE_LAT)
    per_lon = F.lit(111_000.0 if uniform else K.METRES_PER_DEGREE_LON)
    dlat = metres / per_lat
    dlon = F.least(F.abs(F.try_divide(metres.cast("double"), per_lon * F.cos(F.radians(lat)))), F.lit(180.0))
    dlon = F.when(lat.isNotNull() & lon.isNotNull(), F.coalesce(dlon, F.lit(180.0)))
    return {
        "lat_min": lat - dlat, "lat_max": lat + dlat,
        "lon_min": lon - dlon, "lon_max": lon + dlon,
    }


def wrap_lon(lon: Column, domain: str = "180") -> Column:
    """Longitude in the grid's domain: ``"360"`` for [0, 360), ``"180"`` for [-180, 180)."""
    if domain == "360":
        return F.pmod(lon + 360.0, F.lit(360.0))
    return F.pmod(lon + 180.0, F.lit(360.0)) - 180.0


def lon_between(lon: Column, lon_min: Column, lon_max: Column) -> Column:
    """Whether a longitude lies in a box that may cross the antimeridian."""
    return (
        lon.between(lon_min, lon_max)
        | (lon + 360.0).between(lon_min, lon_max)
        | (lon - 360.0).between(lon_min, lon_max)
    )


def bucket_of(value: Column, step: float) -> Column:
    return F.floor(value / F.lit(step)).cast("long")


def lon_bucket(lon: Column, step: float) -> Column:
    """Bucket of a longitude on the closed circle; ``360 / step`` has to be whole."""
    return F.pmod(bucket_of(lon, step), F.lit(circle_buckets(step)))


def circle_buckets(step: float) -> int:
    count = round(360.0 / step)
    if abs(count * step - 360.0) > 1e-9:
        raise ValueError("the bucket step has to divide 360 degrees")
    return count


def explode_box_buckets(boxes: DataFrame, step: float, lat_key: str = "_by", lon_key: str = "_bx") -> DataFrame:
    """One row per bucket a box touches, each bucket at most once."""
    around = circle_buckets(step)
    first = bucket_of(F.col("lon_min"), step)
    last = F.least(bucket_of(F.col("lon_max"), step), first + F.lit(around - 1))
    columns = F.transform(F.sequence(first, last), lambda x: F.pmod(x, F.lit(around)))
    rows = F.sequence(bucket_of(F.col("lat_min"), step), bucket_of(F.col("lat_max"), step))
    return boxes.withColumn(lat_key, F.explode(rows)).withColumn(lon_key, F.explode(columns))


def inside_box(lat: Column, lon: Column) -> Column:
    """Exact test against the box columns of :func:`bbox`."""
    return lat.between(F.col("lat_min"), F.col("lat_max")) & lon_between(lon, F.col("lon_min"), F.col("lon_max"))


def cells_in_boxes(boxes: DataFrame, cells: DataFrame, step: float = 0.5) -> DataFrame:
    """Pairs of boxes and the grid cells inside them.

    Boxes carry ``lat_min lat_max lon_min lon_max``; cells carry ``cell_id cell_lat cell_lon``.
    A bucket holds a bounded number of cells (grid spacing), so a hot bucket is hot on the box side
    only, which adaptive execution splits.
    """
    left = explode_box_buckets(boxes, step)
    right = cells.select(
        "cell_id", "cell_lat", "cell_lon",
        bucket_of(F.col("cell_lat"), step).alias("_by"),
        lon_bucket(F.col("cell_lon"), step).alias("_bx"),
    )
    return (
        left.join(right, ["_by", "_bx"])
        .where(inside_box(F.col("cell_lat"), F.col("cell_lon")))
        .drop("_by", "_bx")
    )


def point_in_ring(x: Column, y: Column, ring: Column) -> Column:
    """Even-odd test of a point against a closed ring ``ARRAY<STRUCT<x, y>>``."""
    edges = F.transform(
        F.sequence(F.lit(1), F.size(ring)),
        lambda i: F.struct(
            F.element_at(ring, i.cast("int")).alias("a"),
            F.element_at(ring, F.when(i == F.size(ring), F.lit(1)).otherwise(i + 1).cast("int")).alias("b"),
        ),
    )
    crossings = F.filter(
        edges,
        lambda e: ((e["a"]["y"] > y) != (e["b"]["y"] > y))
        & (x < e["a"]["x"] + (y - e["a"]["y"]) * F.try_divide(e["b"]["x"] - e["a"]["x"], e["b"]["y"] - e["a"]["y"])),
    )
    return F.size(crossings) % 2 == 1
