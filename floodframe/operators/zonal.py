"""Zonal statistics of static layers.

Fine grids put millions of cells in one box. Cells are first totalled per block; a block wholly
inside a box contributes its totals, and only blocks on the box's edge are opened cell by cell.
Boxes stay where their places are and take in the cells near any of them, if these are few;
many cells meet the boxes by a shuffle, so the driver never holds boxes or many cells.
"""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from floodframe.functions.geo import bbox, bucket_of, explode_box_buckets, inside_box, lon_bucket
from floodframe.operators.spacetime import PLACE as _PLACE, event_anchors
from floodframe.session import cut_lineage, spread

#: Places whose boxes one task totals.
_PLACES_AT_ONCE = 10_000
#: Cells that go to every task; more are joined by a shuffle.
_CELLS_EVERYWHERE = 200_000
#: Blocks along the side of a tile.
_TILE = 20


def _boxes(events: DataFrame, buffer, step: float) -> DataFrame:
    places = event_anchors(events, buffer).select(*_PLACE).distinct().where("latitude IS NOT NULL AND longitude IS NOT NULL")
    places = spread(events.sparkSession, places, _PLACES_AT_ONCE, *_PLACE)
    boxes = places.withColumns(bbox(F.col("latitude"), F.col("longitude"), F.col("buffer")))
    return explode_box_buckets(boxes, step)


def _cells(static: DataFrame, step: float) -> DataFrame:
    return static.select(
        F.col("variable"), F.col("value").cast("double").alias("value"),
        F.col("latitude").alias("cell_lat"), F.col("longitude").alias("cell_lon"),
        bucket_of(F.col("latitude"), step).alias("_by"), lon_bucket(F.col("longitude"), step).alias("_bx"),
    ).where("value IS NOT NULL")


def _cells_near(boxes: DataFrame, cells: DataFrame) -> DataFrame:
    """The cells in tiles (squares of blocks) that some box touches, written."""
    tiled = lambda df: df.withColumns({"_ty": F.floor(F.col("_by") / _TILE), "_tx": F.floor(F.col("_bx") / _TILE)})
    tiles = tiled(boxes).select("_ty", "_tx").distinct()
    return cut_lineage(boxes.sparkSession, tiled(cells).join(tiles, ["_ty", "_tx"], "left_semi").drop("_ty", "_tx"))


def _whole_block() -> Column:
    """All cells of the block lie in the box."""
    low, high = F.col("lon_min"), F.col("lon_max")
    across = F.lit(False)
    for turn in (0.0, 360.0, -360.0):
        across = across | ((F.col("_lon0") + turn >= low) & (F.col("_lon1") + turn <= high))
    return (F.col("_lat0") >= F.col("lat_min")) & (F.col("_lat1") <= F.col("lat_max")) & across


def _box_totals(boxes: DataFrame, cells: DataFrame, keys: Sequence[str], measures: dict[str, Column]) -> DataFrame:
    """Sums of cell-level ``measures`` per box and ``keys``, through blocks and edge cells. Runs its jobs at once."""
    keys, names = list(keys), list(measures)
    cells = _cells_near(boxes, cells)
    joinable = F.broadcast if cells.count() <= _CELLS_EVERYWHERE else lambda df: df.hint("merge")
    extent = cells.groupBy("_by", "_bx").agg(
        F.min("cell_lat").alias("_lat0"), F.max("cell_lat").alias("_lat1"),
        F.min("cell_lon").alias("_lon0"), F.max("cell_lon").alias("_lon1"),
    )
    touched = boxes.join(joinable(extent), ["_by", "_bx"])
    blocks = cells.groupBy("_by", "_bx", *keys).agg(*[F.sum(m).alias(n) for n, m in measures.items()])
    box = _PLACE
    inner = touched.where(_whole_block()).select("_by", "_bx", *box).join(joinable(blocks), ["_by", "_bx"])
    edge = (
        touched.where(~_whole_block()).select("_by", "_bx", *box, "lat_min", "lat_max", "lon_min", "lon_max")
        .join(joinable(cells), ["_by", "_bx"])
        .where(inside_box(F.col("cell_lat"), F.col("cell_lon")))
    )
    both = inner.select(*box, *keys, *names).unionByName(edge.select(*box, *keys, *[m.alias(n) for n, m in measures.items()]))
    return both.groupBy(*box, *keys).agg(*[F.sum(n).alias(n) for n in names])


def _rejoin(events: DataFrame, buffer, results: DataFrame, outputs: Sequence[str]) -> DataFrame:
    anchored = event_anchors(events, buffer)
    keep = [c for c in events.columns if c not in outputs]
    return anchored.join(results, _PLACE, "left").select(*keep, *outputs)


def zonal_mean(
    events: DataFrame, static: DataFrame, variables: Sequence[str], buffer: Column | float | None = None,
    step: float = 0.05, name: str = "gee_{}_mean", fill: float | None = None,
) -> DataFrame:
    """Append the box mean of each static variable."""
    boxes = _boxes(events, buffer, step)
    cells = _cells(static.where(F.col("variable").isin(*variables)), step)
    totals = _box_totals(boxes, cells, ["variable"], {"_sum": F.col("value"), "_n": F.lit(1)})
    outputs = [name.format(v) for v in variables]
    wide = totals.groupBy(*_PLACE).agg(*[
        F.max(F.when(F.col("variable") == v, F.try_divide("_sum", "_n"))).alias(o) for v, o in zip(variables, outputs)
    ])
    result = _rejoin(events, buffer, wide, outputs)
    return result if fill is None else result.withColumns({o: F.coalesce(F.col(o), F.lit(fill)) for o in outputs})


def _class_counts(events, static, variable, buffer, step):
    boxes = _boxes(events, buffer, step)
    cells = _cells(static.where(F.col("variable") == variable), step)
    return _box_totals(boxes, cells, ["value"], {"_n": F.lit(1)})


def zonal_mode(
    events: DataFrame, static: DataFrame, variable: str, buffer: Column | float | None = None,
    step: float = 0.05, name: str = "gee_landcover_mode",
) -> DataFrame:
    """Append the commonest class in the box; the lowest of equally common ones."""
    counts = _class_counts(events, static, variable, buffer, step)
    best = counts.groupBy(*_PLACE).agg(F.min_by("value", F.struct(-F.col("_n"), F.col("value"))).alias(name))
    return _rejoin(events, buffer, best, [name])


def zonal_fraction(
    events: DataFrame, static: DataFrame, variable: str, class_value: float,
    buffer: Column | float | None = None, step: float = 0.05, name: str = "gee_impervious_fraction",
) -> DataFrame:
    """Append the share of the box's cells in one class."""
    counts = _class_counts(events, static, variable, buffer, step)
    share = counts.groupBy(*_PLACE).agg(
        F.try_divide(F.sum(F.when(F.col("value") == class_value, F.col("_n")).otherwise(0)), F.sum("_n")).alias(name)
    )
    return _rejoin(events, buffer, share, [name])
