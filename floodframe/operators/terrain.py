"""Raster neighbourhoods on ``(grid_row, grid_col)`` tables: kernels, terrain, distances, mosaics, tiles.

Neighbourhoods are separable passes of window functions along rows and then columns, so the grid is
shuffled twice whatever the kernel size, and a window partition is one grid line.
"""

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from floodframe import constants as K


def _along_row(layer: Sequence[str]):
    return Window.partitionBy(*layer, "grid_row").orderBy("grid_col")


def _along_col(layer: Sequence[str]):
    return Window.partitionBy(*layer, "grid_col").orderBy("grid_row")


def _at(column: str, line, offset: int) -> Column:
    """Value ``offset`` grid positions away; null where that cell is absent."""
    return F.max(column).over(line.rangeBetween(offset, offset))


def convolve3x3(
    df: DataFrame, kernel: Sequence[Sequence[float]], value: str = "value", output: str = "convolved",
    cell_size: float = 1.0, layer: Sequence[str] = (),
) -> DataFrame:
    """3x3 convolution divided by the squared cell size; null unless all nine cells are present."""
    row, col = _along_row(layer), _along_col(layer)
    sides = df.withColumns({"_w": _at(value, row, -1), "_e": _at(value, row, 1)})
    lines = {}
    for i, (w0, w1, w2) in enumerate(kernel):
        lines[f"_k{i}"] = F.lit(float(w0)) * F.col("_w") + F.lit(float(w1)) * F.col(value) + F.lit(float(w2)) * F.col("_e")
    across = sides.withColumns(lines)
    total = _at("_k0", col, -1) + F.col("_k1") + _at("_k2", col, 1)
    return across.withColumn(output, total / F.lit(float(cell_size) ** 2)).drop("_w", "_e", *lines)


def curvature(df: DataFrame, value: str = "value", cell_size: float = 1.0, layer: Sequence[str] = ()) -> DataFrame:
    """Curvature, its profile and planform copies, and the Laplacian form."""
    plain = convolve3x3(df, K.CURVATURE_KERNEL, value, "curvature", cell_size, layer)
    both = convolve3x3(plain, K.LAPLACIAN_KERNEL, value, "curvature_laplacian", cell_size, layer)
    return both.withColumns({"profile_curvature": F.col("curvature"), "planform_curvature": F.col("curvature")})


def _half_widths(radius: int) -> dict[int, int]:
    """Half-width of a disc at each row offset."""
    return {d: int((radius * radius - d * d) ** 0.5) for d in range(-radius, radius + 1)}


def _with_gaps(df: DataFrame, places: DataFrame, layer: Sequence[str]) -> DataFrame:
    """Add empty cells at the given places where the grid has none, marked by a null ``_real``.

    A pass along columns reads what a pass along rows left at the crossing cell, so it must exist.
    """
    keys = [*layer, "grid_row", "grid_col"]
    types = dict(df.dtypes)
    typed = places.select(*[F.col(k).cast(types[k]).alias(k) for k in keys])
    absent = typed.join(df.select(*keys), keys, "left_anti")
    return df.withColumn("_real", F.lit(True)).unionByName(absent, allowMissingColumns=True)


def _above_and_below(df: DataFrame, radius: int, layer: Sequence[str]) -> DataFrame:
    offsets = F.array(*[F.lit(d) for d in range(-radius, radius + 1)])
    shifted = df.select(*layer, "grid_row", "grid_col", F.explode(offsets).alias("_d"))
    return shifted.select(*layer, (F.col("grid_row") + F.col("_d")).alias("grid_row"), "grid_col").distinct()


def focal_min(
    df: DataFrame, radius: int, value: str, output: str, layer: Sequence[str] = (), gaps: bool = True
) -> DataFrame:
    """Minimum over a disc of ``radius`` cells, of the cells present. ``gaps=False`` for a full rectangle of cells."""
    if gaps:
        filled = focal_min(_with_gaps(df, _above_and_below(df, radius, layer), layer), radius, value, output, layer, False)
        return filled.where("_real").drop("_real")
    widths = _half_widths(radius)
    row, col = _along_row(layer), _along_col(layer)
    across = df.withColumns({f"_m{w}": F.min(value).over(row.rangeBetween(-w, w)) for w in set(widths.values())})
    parts = [_at(f"_m{w}", col, d) for d, w in widths.items()]
    return across.withColumn(output, F.least(*parts) if len(parts) > 1 else parts[0]).drop(*[f"_m{w}" for w in set(widths.values())])


def focal_mean(
    df: DataFrame, radius: int, value: str, output: str, layer: Sequence[str] = (), gaps: bool = True
) -> DataFrame:
    """Mean over a disc of ``radius`` cells, of the cells present. ``gaps=False`` for a full rectangle of cells."""
    if gaps:
        filled = focal_mean(_with_gaps(df, _above_and_below(df, radius, layer), layer), radius, value, output, layer, False)
        return filled.where("_real").drop("_real")
    widths = _half_widths(radius)
    row, col = _along_row(layer), _along_col(layer)
    names = {}
    for w in set(widths.values()):
        frame = row.rangeBetween(-w, w)
        names[f"_s{w}"] = F.sum(value).over(frame)
        names[f"_n{w}"] = F.count(value).over(frame)
    across = df.withColumns(names)
    add = lambda p: sum((F.coalesce(_at(f"_{p}{w}", col, d), F.lit(0)) for d, w in widths.items()), F.lit(0))
    return across.withColumn(output, F.try_divide(add("s"), add("n"))).drop(*names)


def terrain_features(
    df: DataFrame, elevation: str = "elevation", cell_size: float = 30.0, layer: Sequence[str] = (),
    threshold: float = K.CHANNEL_FLOW_THRESHOLD, fill_radius: int = 1, flow_radius: int = 2, gaps: bool = True,
) -> DataFrame:
    """Slope, aspect, a flow proxy, wetness index and channel mask from an elevation grid.

    Slope and aspect come from central differences (rows run north to south); they are null at
    the grid's edge. Radii are in cells.
    """
    row, col = _along_row(layer), _along_col(layer)
    z = df.withColumns({
        "_gx": (_at(elevation, row, 1) - _at(elevation, row, -1)) / F.lit(2.0 * cell_size),
        "_gy": (_at(elevation, col, -1) - _at(elevation, col, 1)) / F.lit(2.0 * cell_size),
    })
    gx, gy = F.col("_gx"), F.col("_gy")
    sloped = z.withColumns({
        "slope": F.degrees(F.atan(F.sqrt(gx * gx + gy * gy))),
        "aspect": F.pmod(F.degrees(F.atan2(-gx, -gy)), F.lit(360.0)),
    }).drop("_gx", "_gy")
    low = focal_min(sloped, fill_radius, elevation, "_filled", layer, gaps)
    flow = focal_mean(low, flow_radius, "_filled", "flow", layer, gaps)
    steep = F.greatest(F.tan(F.radians("slope")), F.lit(0.001))
    return flow.withColumns({
        "wetness": F.when(F.col("slope").isNotNull() & (F.col("flow") > 0), F.log(F.col("flow") / steep)),
        "channel": F.when(F.col("flow") > threshold, 1),
    }).drop("_filled")


def _envelope(rows: np.ndarray, cost: np.ndarray) -> np.ndarray:
    """``min over j of (rows[i] - rows[j])**2 + cost[j]`` for each i, by the lower envelope of parabolas."""
    apex, start = [], []
    for j in np.flatnonzero(np.isfinite(cost)):
        begin = -np.inf
        while apex:
            k = apex[-1]
            begin = ((cost[j] + rows[j] ** 2) - (cost[k] + rows[k] ** 2)) / (2.0 * (rows[j] - rows[k]))
            if begin > start[-1]:
                break
            apex.pop()
            start.pop()
            begin = -np.inf
        apex.append(j)
        start.append(begin)
    if not apex:
        return np.full(len(rows), np.nan)
    nearest = np.array(apex)[np.searchsorted(np.array(start), rows, side="right") - 1]
    return (rows - rows[nearest]) ** 2 + cost[nearest]


def distance_to_nearest(
    df: DataFrame, target: str, output: str = "distance", cell_size: float = 1.0, layer: Sequence[str] = (),
    gaps: bool = True,
) -> DataFrame:
    """Straight-line distance from every cell to the nearest cell where ``target`` holds; null without any.

    Exact and linear in the number of cells: nearest target along each row by window functions,
    then a lower envelope down each column. A task holds one column of the grid. With ``gaps``, rows
    that have a target are completed to the grid's width first.
    """
    layer = list(layer)
    row = _along_row(layer)
    cells = df
    if gaps:
        width = df.groupBy(*layer).agg(F.struct(F.min("grid_col").alias("a"), F.max("grid_col").alias("b")).alias("_w"))
        lines = df.where(F.col(target).cast("boolean")).select(*layer, "grid_row").distinct()
        lines = lines.join(width, layer) if layer else lines.withColumn("_w", width.scalar())
        whole = lines.select(*layer, "grid_row", F.explode(F.sequence("_w.a", "_w.b")).alias("grid_col"))
        cells = _with_gaps(df.select(*layer, "grid_row", "grid_col", target), whole, layer)
    here = F.when(F.col(target).cast("boolean"), F.col("grid_col"))
    left = F.last(here, ignorenulls=True).over(row.rowsBetween(Window.unboundedPreceding, 0))
    right = F.first(here, ignorenulls=True).over(row.rowsBetween(0, Window.unboundedFollowing))
    along = cells.withColumn("_g", F.least(F.col("grid_col") - left, right - F.col("grid_col")).cast("double"))

    keys = layer + ["grid_row", "grid_col"]
    types = dict(df.dtypes)
    schema = ", ".join(f"`{k}` {types[k]}" for k in keys) + f", `{output}` double"

    def down(column: pd.DataFrame) -> pd.DataFrame:
        column = column.sort_values("grid_row")
        rows = column["grid_row"].to_numpy(dtype=float)
        cost = column["_g"].to_numpy(dtype=float) ** 2
        squared = _envelope(rows, np.where(np.isnan(cost), np.inf, cost))
        out = column[keys].copy()
        out[output] = np.sqrt(squared) * cell_size
        return out

    distances = along.select(*keys, "_g").groupBy(*layer, "grid_col").applyInPandas(down, schema)
    distances = distances.withColumn(output, F.nanvl(output, F.lit(None).cast("double")))
    return df.join(distances, keys, "left")


def mosaic(layers: DataFrame, bands: Sequence[str], fill: float | None = None) -> DataFrame:
    """First value per cell and band in layer order, one column per band.

    ``layers``: ``cell_id variable layer_order value``. Nulls never hide a later layer.
    """
    band = lambda b: F.when((F.col("variable") == b) & F.col("value").isNotNull(), F.col("layer_order"))
    default = F.lit(fill).cast("double")
    return layers.groupBy("cell_id").agg(*[F.coalesce(F.min_by("value", band(b)), default).alias(b) for b in bands])


def tile_grid(roi: tuple[float, float, float, float], area_km2: float, max_km2: float = 100.0) -> int:
    """Tiles per side so that no tile exceeds ``max_km2``."""
    return max(1, int(np.ceil(np.sqrt(area_km2 / max_km2))))


def assign_tiles(
    df: DataFrame, roi: tuple[float, float, float, float], area_km2: float, max_km2: float = 100.0
) -> DataFrame:
    """Rows in the region ``(lon_min, lat_min, lon_max, lat_max)`` with their tile number."""
    lon0, lat0, lon1, lat1 = map(float, roi)
    n = tile_grid(roi, area_km2, max_km2)
    index = lambda c, low, high: F.least(F.floor((F.col(c) - low) / ((high - low) / n)), F.lit(n - 1))
    return (
        df.where(F.col("longitude").between(lon0, lon1) & F.col("latitude").between(lat0, lat1))
        .withColumns({"tile_x": index("longitude", lon0, lon1), "tile_y": index("latitude", lat0, lat1)})
        .withColumn("tile_id", F.col("tile_x") * n + F.col("tile_y"))
    )
