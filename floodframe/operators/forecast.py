"""Forecast values and ensemble statistics at events.

A forecast grid has axes (latitude, longitude, time). The nearest position on an axis is found by one
sorted pass over axis and wanted values together; after that facts join by equality on cell and time.
"""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from floodframe import constants as K
from floodframe.functions.flood_types import buffer_m, spatial_strategy
from floodframe.functions.numbers import clamp
from floodframe.functions.geo import bbox, cells_in_boxes, wrap_lon
from floodframe.session import cut_lineage

_PLACE = ["latitude", "longitude", "strategy", "buffer"]


def pick_variable(fc: DataFrame, preferred: Sequence[str] = K.DISCHARGE_VARIABLES, present: DataFrame | None = None) -> DataFrame:
    """Keep one variable: the first of ``preferred`` present, else the first by name. ``present`` may state the variables there are."""
    order = F.array_position(F.array(*[F.lit(v) for v in preferred]), F.col("variable"))
    rank = F.struct(F.when(order > 0, order).otherwise(len(preferred) + 1), F.col("variable"))
    names = (fc if present is None else present).select("variable").where("variable IS NOT NULL").distinct()
    return fc.where(F.col("variable") == names.agg(F.min_by("variable", rank)).scalar())


def neighbours_on_axes(wanted: DataFrame, lines: DataFrame) -> DataFrame:
    """Each distinct ``axis, v`` of ``wanted`` with the last of the axis' ``lines`` not above it (``below``) and the first not under it (``above``).

    Lines and values are sorted together, dealt by ranges. Every range is scanned on its own; the last and the next line outside it are
    carried over from the other ranges' ends, of which there is one row per range. Nothing depends on how an axis is spaced. Runs a job.
    """
    both = lines.select("axis", "v", F.lit(True).alias("line")).unionByName(wanted.select("axis", "v", F.lit(False).alias("line")))
    points = both.where("v IS NOT NULL AND NOT isnan(v)").groupBy("axis", "v").agg(F.max("line").alias("line"), F.max(~F.col("line")).alias("wanted"))
    points = cut_lineage(wanted.sparkSession, points.repartitionByRange("axis", "v").withColumn("part", F.spark_partition_id()))
    entry = F.when(F.col("line"), F.col("v"))
    inside, across = Window.partitionBy("axis", "part"), Window.partitionBy("axis")  # one row per range across
    back, ahead = (inside.orderBy(o).rowsBetween(Window.unboundedPreceding, 0) for o in ("v", F.desc("v")))
    before, after = (across.orderBy(o).rowsBetween(Window.unboundedPreceding, -1) for o in ("part", F.desc("part")))
    scanned = points.select("axis", "v", "part", "wanted", F.last(entry, True).over(back).alias("_low"), F.last(entry, True).over(ahead).alias("_high"))
    ends = points.groupBy("axis", "part").agg(F.min(entry).alias("lo"), F.max(entry).alias("hi"))
    carried = ends.select("axis", "part", F.last("hi", True).over(before).alias("_left"), F.last("lo", True).over(after).alias("_right"))
    return scanned.where("wanted").join(carried, ["axis", "part"]).select(
        "axis", "v", F.coalesce("_low", "_left").alias("below"), F.coalesce("_high", "_right").alias("above"))


def _nearest(ties: str) -> Column:
    """The nearer of ``below`` and ``above``; ``ties`` picks of two equally near."""
    v, low, high = F.col("v"), F.col("below"), F.col("above")
    upper = (high - v <= v - low) if ties == "high" else (high - v < v - low)
    return F.when(low.isNull() | upper, high).otherwise(low)


def _on_axis(df: DataFrame, name: str, value: Column) -> DataFrame:
    return df.select(F.lit(name).alias("axis"), value.cast("double").alias("v"))


def nearest_on_axis(values: DataFrame, axis: DataFrame, column: str, output: str, ties: str = "high") -> DataFrame:
    """Append to ``values`` the nearest entry of ``axis`` (same column name); ``ties`` picks of two equally near.

    Values beyond the ends get the end; null and NaN get null. Runs a job.
    """
    near = neighbours_on_axes(_on_axis(values, column, F.col(column)), _on_axis(axis, column, F.col(column)))
    near = near.select(F.col("v").alias("_v"), _nearest(ties).alias(output))
    return values.withColumn("_v", F.col(column).cast("double")).join(near, "_v", "left").select(*values.columns, output)


def _nearest_lines(keys: DataFrame, cells: DataFrame, times: DataFrame, domain: str) -> DataFrame:
    """``latitude longitude`` and ``flood_start_date`` values of ``keys`` with their nearest grid line or time, all axes in one pass.

    Equally near lines: the southern, the eastern, the later.
    """
    lon = wrap_lon(F.col("longitude"), domain)
    wanted = _on_axis(keys, "lat", F.col("latitude")).unionByName(_on_axis(keys, "lon", lon))
    lines = _on_axis(cells, "lat", F.col("cell_lat")).unionByName(_on_axis(cells, "lon", F.col("cell_lon")))
    wanted = wanted.unionByName(_on_axis(keys, "time", _seconds(F.col("flood_start_date"))))
    lines = lines.unionByName(_on_axis(times, "time", F.col("ts_s")))
    near = neighbours_on_axes(wanted, lines)
    return near.select("axis", "v", F.when(F.col("axis") == "lat", _nearest("low")).otherwise(_nearest("high")).alias("near"))


def _with_line(df: DataFrame, near: DataFrame, axis: str, value: Column, output: str) -> DataFrame:
    line = near.where(F.col("axis") == axis).select(F.col("v").alias("_v"), F.col("near").alias(output))
    return df.withColumn("_v", value.cast("double")).join(line, "_v").drop("_v")


def nearest_grid_cells(points: DataFrame, cells: DataFrame) -> DataFrame:
    """``latitude longitude`` of ``points``, each once, with the ``cell_id`` of the cell on the nearest lines of ``cells(cell_id cell_lat cell_lon)``."""
    spots = points.select("latitude", "longitude").where("latitude IS NOT NULL AND longitude IS NOT NULL").distinct()
    wanted = _on_axis(spots, "lat", F.col("latitude")).unionByName(_on_axis(spots, "lon", F.col("longitude")))
    near = neighbours_on_axes(wanted, _on_axis(cells, "lat", F.col("cell_lat")).unionByName(_on_axis(cells, "lon", F.col("cell_lon"))))
    near = near.select("axis", "v", F.when(F.col("axis") == "lat", _nearest("low")).otherwise(_nearest("high")).alias("near"))
    lined = _with_line(_with_line(spots, near, "lat", F.col("latitude"), "cell_lat"), near, "lon", F.col("longitude"), "cell_lon")
    return lined.join(cells, ["cell_lat", "cell_lon"]).select("latitude", "longitude", "cell_id")


def _seconds(at: Column) -> Column:
    return F.unix_seconds(at.cast("timestamp"))


def forecast_lines(fc: DataFrame) -> DataFrame:
    """Cells (``is_cell``: ``cell_id cell_lat cell_lon``) and times (``ts_s``) of each variable, from one scan."""
    rows = fc.select("variable", "cell_id", F.col("latitude").alias("cell_lat"), F.col("longitude").alias("cell_lon"), _seconds(F.col("ts")).alias("ts_s"))
    cell, time = ["variable", "cell_id", "cell_lat", "cell_lon"], ["variable", "ts_s"]
    return rows.groupingSets([cell, time], *cell, "ts_s").agg((F.grouping("ts_s") == 1).alias("is_cell"))


def places_to_cells(places: DataFrame, cells: DataFrame, near: DataFrame, domain: str = "180", step: float = 0.5) -> DataFrame:
    """Cells to average per place: the nearest one, or those in the box (the nearest if the box is empty)."""
    boxed = places.where(F.col("strategy") != "nearest")
    inside = cells_in_boxes(
        boxed.withColumns(bbox(F.col("latitude"), F.col("longitude"), F.col("buffer"), uniform=True)), cells, step
    ).select(*_PLACE, "cell_id")
    lined = _with_line(_with_line(places, near, "lat", F.col("latitude"), "cell_lat"), near, "lon", wrap_lon(F.col("longitude"), domain), "cell_lon")
    single = lined.join(cells, ["cell_lat", "cell_lon"]).select(*_PLACE, F.col("cell_id").alias("near_id"))
    hit = single.join(inside, _PLACE, "left")
    return hit.select(*_PLACE, F.coalesce("cell_id", "near_id").alias("cell_id"))


def _prepared(events: DataFrame, strategy: Column) -> DataFrame:
    return events.withColumns({"strategy": strategy, "buffer": buffer_m(F.col("flood_type"), "forecast").cast("double")})


def _values_at(prepared: DataFrame, fc: DataFrame, cells: DataFrame | None, domain: str, ensemble: bool = True) -> DataFrame:
    """Control value and, if asked, ensemble statistics per place and day, at the nearest forecast time. Worked out once per set of cells and time.

    One variable is picked first. Repeated values of a cell, time, product and member are averaged. A cell's members at one time
    travel as one map, so the join and the grouping move a row per cell instead of a row per member. One scan gives variables, cells and
    times; of a table written by month (``obs_month``) only the months of the wanted times are read for values. Runs jobs at once.
    """
    spark = fc.sparkSession
    lines = cut_lineage(spark, forecast_lines(fc))
    fc, lines = pick_variable(fc, present=lines), pick_variable(lines)
    usable = prepared.where("latitude IS NOT NULL AND longitude IS NOT NULL AND flood_start_date IS NOT NULL")
    keys = cut_lineage(spark, usable.select(*_PLACE, "flood_start_date").distinct())
    cells = lines.where("is_cell").select("cell_id", "cell_lat", "cell_lon") if cells is None else cells
    near = _nearest_lines(keys, cells, lines.where("NOT is_cell"), domain)
    pairs = places_to_cells(keys.select(*_PLACE).distinct(), cells, near, domain)
    timed = _with_line(keys, near, "time", _seconds(F.col("flood_start_date")), "_ts").withColumn("_ts", F.col("_ts").cast("long"))
    timed = timed.join(pairs, _PLACE).groupBy(*_PLACE, "flood_start_date", "_ts").agg(F.array_sort(F.collect_list("cell_id")).alias("_set"))  # cells of one box
    timed = cut_lineage(spark, timed)
    sets = timed.select("_set", "_ts").distinct()
    wanted = sets.select("_set", "_ts", F.explode("_set").alias("cell_id"))
    if "obs_month" in fc.columns:
        month = lambda at: timed.agg(F.date_format(F.timestamp_seconds(at("_ts")), "yyyy-MM")).scalar()
        fc = fc.where(F.col("obs_month").between(month(F.min), month(F.max)))
    facts = fc.select("cell_id", "product", "member", "value", _seconds(F.col("ts")).alias("_ts"))
    needed = facts.join(wanted.select("cell_id", "_ts").distinct(), ["cell_id", "_ts"], "left_semi")
    single = needed.groupBy("cell_id", "_ts", "product", "member").agg(F.avg("value").alias("value"))
    perturbed = (F.col("product") == "pf") & (F.col("member") != 0) & F.col("value").isNotNull()
    by_cell = single.groupBy("cell_id", "_ts").agg(
        F.avg(F.when(F.col("product") == "cf", F.col("value"))).alias("_control"),
        F.map_from_entries(F.collect_list(F.when(perturbed, F.struct("member", "value")))).alias("_members"),
    )
    values = wanted.join(by_cell, ["cell_id", "_ts"]).groupBy("_set", "_ts").agg(
        F.avg("_control").alias("glofas_forecast_control"), F.collect_list("_members").alias("_cells"))
    values = _with_ensemble(values) if ensemble else values.drop("_cells")
    return timed.join(values, ["_set", "_ts"]).drop("_set", "_ts")


def _mean(values: Column) -> Column:
    return F.try_divide(F.aggregate(values, F.lit(0.0), lambda a, v: a + v), F.size(values))


def _quantile(ordered: Column, p: float) -> Column:
    position = F.lit(p) * (F.size(ordered) - 1)
    low = F.get(ordered, F.floor(position).cast("int"))
    high = F.get(ordered, F.ceil(position).cast("int"))
    return low + (high - low) * (position - F.floor(position))


def _with_ensemble(values: DataFrame) -> DataFrame:
    """Statistics over members of their means over cells; the lists are as long as the ensemble."""
    members = F.array_distinct(F.flatten(F.transform("_cells", lambda c: F.map_keys(c))))
    over_cells = F.transform(members, lambda m: _mean(F.filter(F.transform("_cells", lambda c: c[m]), lambda v: v.isNotNull())))
    single = F.map_values(F.element_at("_cells", 1))
    ordered = F.array_sort(F.when(F.size("_cells") == 1, single).otherwise(over_cells))
    listed = values.withColumn("_v", ordered).withColumn("glofas_forecast_mean", _mean(F.col("_v")))
    spread = F.transform("_v", lambda v: F.pow(v - F.col("glofas_forecast_mean"), F.lit(2.0)))
    return listed.withColumns({
        "glofas_forecast_median": _quantile(F.col("_v"), 0.5),
        "glofas_forecast_std_dev": F.sqrt(_mean(spread)),
        "glofas_forecast_10th_percentile": _quantile(F.col("_v"), 0.1),
        "glofas_forecast_90th_percentile": _quantile(F.col("_v"), 0.9),
    }).drop("_v", "_cells")


def _attach(prepared: DataFrame, results: DataFrame, outputs: Sequence[str]) -> DataFrame:
    keep = [c for c in prepared.columns if c not in ("strategy", "buffer") and c not in outputs]
    return prepared.join(results, _PLACE + ["flood_start_date"], "left").select(*keep, "strategy", *outputs)


def forecast_nearest(events: DataFrame, fc: DataFrame, cells: DataFrame | None = None, domain: str = "180") -> DataFrame:
    """Control forecast at the nearest cell and time."""
    return _control_only(events, fc, F.lit("nearest"), cells, domain)


def forecast_bbox_mean(events: DataFrame, fc: DataFrame, cells: DataFrame | None = None, domain: str = "180") -> DataFrame:
    """Control forecast averaged over the box at the nearest time; nearest cell if the box holds none."""
    return _control_only(events, fc, F.lit("mean_bbox"), cells, domain)


def _control_only(events, fc, strategy, cells, domain):
    prepared = _prepared(events, strategy)
    values = _values_at(prepared, fc.where(F.col("product") == "cf"), cells, domain, False)
    return _attach(prepared, values, ["glofas_forecast_control"]).drop("strategy")


def ensemble_stats(events: DataFrame, fc: DataFrame, cells: DataFrame | None = None, domain: str = "180") -> DataFrame:
    """Mean, median, spread and tails over the perturbed members (control member left out)."""
    prepared = _prepared(events, spatial_strategy(F.col("flood_type")))
    values = _values_at(prepared, fc.where(F.col("product") == "pf"), cells, domain)
    return _attach(prepared, values, K.FORECAST_FEATURES[1:]).drop("strategy")


def with_forecast(events: DataFrame, fc: DataFrame, cells: DataFrame | None = None, domain: str = "180") -> DataFrame:
    """Append the six forecast features and the strategy used; null before forecasts began."""
    covered = F.col("flood_start_date") >= F.lit(K.FORECAST_START)
    prepared = _prepared(events, F.when(covered, spatial_strategy(F.col("flood_type"))))
    values = _values_at(prepared.where(covered), fc.where(F.col("product").isin("cf", "pf")), cells, domain)
    return _attach(prepared, values, K.FORECAST_FEATURES).withColumnRenamed("strategy", "forecast_spatial_strategy")
