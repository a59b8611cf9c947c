"""Queries on space-time windows, zonal statistics, terrain and forecasts."""

from pyspark.sql import functions as F

from floodframe import constants as K
from floodframe.functions import indices
from floodframe.operators import forecast, rules, spacetime, terrain, zonal
from floodframe.plans import enrichment
from floodframe.queries.base import query, r, rounded
from floodframe.session import scratch_path
from floodframe.sources import grids

_FT = "lower(coalesce(flood_type, ''))"
_BUFFER = f"CASE WHEN regexp_matches({_FT}, 'flash|urban|local') THEN 25000.0 WHEN regexp_matches({_FT}, 'riverine|river|coastal') THEN 50000.0 ELSE 25000.0 END"


def _pairs(events="fx_anchors", cells="fx_cells"):
    """Events and the cells in their boxes."""
    return f"""pair AS (SELECT e.event_id, e.flood_start_date AS d, c.cell_id FROM (SELECT *, {_BUFFER} AS b FROM {events}) AS e JOIN {cells} AS c
  ON c.latitude BETWEEN e.latitude - b / 110540.0 AND e.latitude + b / 110540.0
  AND c.longitude BETWEEN e.longitude - b / (111320.0 * cos(radians(e.latitude))) AND e.longitude + b / (111320.0 * cos(radians(e.latitude))))"""


def _window_sql(per_cell: dict[str, str], outputs: dict[str, str], lo: int, hi: int, events="fx_anchors", obs="fx_obs", digits=4, extra=""):
    """Per cell over the window first, then the mean over cells."""
    cells = ", ".join(f"{e} AS {n}" for n, e in per_cell.items())
    means = ", ".join(f"avg({n}) AS {n}" for n in per_cell)
    final = ", ".join(f"{r(e, digits)} AS {n}" for n, e in outputs.items())
    return f"""
WITH {_pairs(events)},
cell AS (SELECT event_id, d, p.cell_id, {cells} FROM pair AS p JOIN {obs} AS o ON o.cell_id = p.cell_id
  AND o.ts >= d - CAST({-lo} AS INT) AND o.ts < d + CAST({hi} AS INT) GROUP BY event_id, d, p.cell_id),
mean AS (SELECT event_id, {means} FROM cell GROUP BY event_id)
SELECT e.event_id, {final}{extra} FROM {events} AS e LEFT JOIN mean USING (event_id)
"""


_IN = "CASE WHEN ts >= d{a} AND ts < d{b} THEN {v} END"


def _at(a: int, b: int, v="value"):
    day = lambda n: "" if n == 0 else (f" + CAST({n} AS INT)" if n > 0 else f" - CAST({-n} AS INT)")
    return _IN.format(a=day(a), b=day(b), v=v)


@query("rain_event_day", _window_sql(
    {"s": f"sum({_at(0, 1)}) * 0.5E0", "m": f"max({_at(0, 1)})", "a": f"avg({_at(0, 1)})"},
    {"gee_imerg_sum_24h_mm": "s", "gee_imerg_max_1h_intensity_mm": "m", "imerg_mean_1h_intensity_mm": "a", "imerg_max_1h_intensity_mm": "m",
     "gee_imerg_max_3h_intensity_mm": "m * 1.5E0", "gee_imerg_max_6h_intensity_mm": "m * 2"}, 0, 1))
def _(x):
    out = spacetime.rain_event_day(x.fx_anchors, x.fx_obs)
    return rounded(out.drop("flood_start_date", "latitude", "longitude", "flood_type"), 4)


@query("rain_day_before", _window_sql(
    {"s": f"sum({_at(-1, 0)}) * 0.5E0", "m": f"max({_at(-1, 0)})"},
    {"gee_imerg_sum_24h_mm": "s", "gee_imerg_max_1h_intensity_mm": "m"}, -1, 0))
def _(x):
    out = spacetime.rain_event_day(x.fx_anchors, x.fx_obs, before=True)
    return rounded(out.select("event_id", "gee_imerg_sum_24h_mm", "gee_imerg_max_1h_intensity_mm"), 4)


_ANTECEDENT = _window_sql(
    {"s3": f"sum({_at(-3, 0)}) * 0.5E0", "s7": f"sum({_at(-7, 0)}) * 0.5E0"},
    {"gee_imerg_sum_3d_before_mm": "s3", "gee_imerg_sum_7d_before_mm": "s7", "gee_imerg_intensity_3d_mm_per_day": "s3 / 3", "gee_imerg_intensity_7d_mm_per_day": "s7 / 7"},
    -7, 0)


@query("rain_antecedent", _ANTECEDENT)
def _(x):
    out = spacetime.rain_antecedent(x.fx_anchors, x.fx_obs)
    return rounded(out.drop("flood_start_date", "latitude", "longitude", "flood_type"), 4)


@query("rain_by_month", _ANTECEDENT)
def _(x):
    path = scratch_path(x.spark, "obs")
    grids.write_grid(x.fx_obs.drop("obs_id"), path)
    out = spacetime.rain_antecedent(x.fx_anchors, grids.read_grid(x.spark, path))
    return rounded(out.drop("flood_start_date", "latitude", "longitude", "flood_type"), 4)


@query("rain_max_daily", f"""
WITH {_pairs()},
daily AS (SELECT event_id, p.cell_id, CAST(ts AS DATE) AS day, sum(value) * 0.5E0 AS s FROM pair AS p JOIN fx_obs AS o ON o.cell_id = p.cell_id
  AND ts >= d - 7 AND ts < d GROUP BY 1, 2, 3),
cell AS (SELECT event_id, cell_id, max(s) AS m FROM daily GROUP BY 1, 2)
SELECT e.event_id, {r("m", 4)} AS gee_imerg_max_daily_7d_mm FROM fx_anchors AS e LEFT JOIN (SELECT event_id, avg(m) AS m FROM cell GROUP BY 1) AS c USING (event_id)
""")
def _(x):
    return rounded(spacetime.rain_max_daily(x.fx_anchors, x.fx_obs).select("event_id", "gee_imerg_max_daily_7d_mm"), 4)


_RUN = lambda run, agg, scale="": f"{agg}({_at(0, 1, f'CASE WHEN source = {run!r} THEN value END')}){scale}"
_LATE = "CASE WHEN source = 'late' THEN value END"


@query("rain_source_fallback", f"""
WITH {_pairs("fx_era_anchors")},
cell AS (SELECT event_id, d, p.cell_id, {_RUN('early', 'sum', ' * 0.5E0')} AS es, {_RUN('early', 'max')} AS em, {_RUN('early', 'avg')} AS ea,
  {_RUN('late', 'sum', ' * 0.5E0')} AS ls, {_RUN('late', 'max')} AS lm, {_RUN('late', 'avg')} AS la,
  sum({_at(-3, 0, _LATE)}) * 0.5E0 AS s3, sum({_at(-7, 0, _LATE)}) * 0.5E0 AS s7
  FROM pair AS p JOIN fx_era_obs AS o ON o.cell_id = p.cell_id AND ts >= d - 7 AND ts < d + 1 GROUP BY event_id, d, p.cell_id),
mean AS (SELECT event_id, avg(es) AS es, avg(em) AS em, avg(ea) AS ea, avg(ls) AS ls, avg(lm) AS lm, avg(la) AS la, avg(s3) AS s3, avg(s7) AS s7 FROM cell GROUP BY 1),
daily AS (SELECT event_id, p.cell_id, CAST(ts AS DATE) AS day, sum(value) * 0.5E0 AS s FROM pair AS p JOIN fx_era_obs AS o ON o.cell_id = p.cell_id AND source = 'late'
  AND ts >= d - 7 AND ts < d GROUP BY 1, 2, 3),
peak AS (SELECT event_id, avg(m) AS pk FROM (SELECT event_id, cell_id, max(s) AS m FROM daily GROUP BY 1, 2) AS c GROUP BY 1),
j AS (SELECT e.event_id, e.flood_start_date AS d, mean.* EXCLUDE (event_id), pk, e.flood_start_date < DATE '2000-06-01' AS era,
  e.flood_start_date >= DATE '2019-06-01' AS early FROM fx_era_anchors AS e LEFT JOIN mean USING (event_id) LEFT JOIN peak USING (event_id)),
k AS (SELECT *, NOT era AND early AND es IS NOT NULL AS ue, NOT era AND NOT (early AND es IS NOT NULL) AND ls IS NOT NULL AS ul FROM j)
SELECT event_id, {r("CASE WHEN ue THEN es WHEN ul THEN ls ELSE 0 END", 4)} AS gee_imerg_sum_24h_mm,
  {r("CASE WHEN ue THEN em WHEN ul THEN lm ELSE 0 END", 4)} AS gee_imerg_max_1h_intensity_mm,
  {r("CASE WHEN ue THEN ea WHEN ul THEN la ELSE 0 END", 4)} AS imerg_mean_1h_intensity_mm,
  {r("CASE WHEN era THEN 0 ELSE coalesce(s3, 0) END", 4)} AS gee_imerg_sum_3d_before_mm,
  {r("CASE WHEN era THEN 0 ELSE coalesce(s7, 0) / 7 END", 4)} AS gee_imerg_intensity_7d_mm_per_day,
  {r("CASE WHEN era THEN 0 ELSE coalesce(pk, 0) END", 4)} AS gee_imerg_max_daily_7d_mm,
  CASE WHEN ue OR ul THEN 0 ELSE 1 END AS imerg_data_missing, CASE WHEN NOT era THEN CASE WHEN ue OR ul THEN 0 ELSE 1 END END AS imerg_extraction_failed,
  CASE WHEN era THEN 'none' WHEN ue THEN 'early' WHEN early THEN 'late_final' ELSE 'late' END AS imerg_source,
  CASE WHEN era THEN 'pre_imerg_era' ELSE '' END AS imerg_coverage_note FROM k
""")
def _(x):
    out = spacetime.rain_features(x.fx_era_anchors, x.fx_era_obs)
    return rounded(out.select(
        "event_id", "gee_imerg_sum_24h_mm", "gee_imerg_max_1h_intensity_mm", "imerg_mean_1h_intensity_mm", "gee_imerg_sum_3d_before_mm",
        "gee_imerg_intensity_7d_mm_per_day", "gee_imerg_max_daily_7d_mm", "imerg_data_missing", "imerg_extraction_failed", "imerg_source",
        "imerg_coverage_note"), 4)


def _var(v):
    return f"CASE WHEN variable = '{v}' THEN value END"


@query("moisture_features", _window_sql(
    {"t": f"avg({_at(-3, 1, _var('click'))})", "u": f"avg({_at(-3, 1, _var('view'))})", "n": f"avg({_at(-60, -30, _var('click'))})"},
    {"gee_smap_surface_soil_moisture": "t", "gee_smap_subsurface_soil_moisture": "u", "gee_smap_soil_moisture_anomaly": "t - n"}, -60, 1))
def _(x):
    out = spacetime.moisture_features(x.fx_anchors, x.fx_obs, surface="click", rootzone="view")
    return rounded(out.drop("flood_start_date", "latitude", "longitude", "flood_type"), 4)


_HALF = "CASE WHEN ts >= CAST(d AS TIMESTAMP) - INTERVAL 12 HOUR AND ts < d AND variable = '{v}' THEN value END"
_MEAN = {n: f"avg({_HALF.format(v=v)})" for n, v in {"t": "click", "h": "view", "p": "error", "u": "signup", "v": "purchase"}.items()}


@query("weather_features", _window_sql(
    {"t": f"{_MEAN['t']} - 273.15E0", "h": _MEAN["h"], "p": _MEAN["p"], "w": f"sqrt({_MEAN['u']} * {_MEAN['u']} + {_MEAN['v']} * {_MEAN['v']})"},
    {"gee_gfs_temp2m_celsius": "t", "gee_gfs_relative_humidity_pct": "h", "gee_gfs_surface_pressure_pa": "p", "gee_gfs_precipitable_water_kg_m2": "h",
     "gee_gfs_wind_speed_ms": "w"}, -1, 0))
def _(x):
    names = {"temperature": "click", "humidity": "view", "pressure": "error", "water": "view", "u": "signup", "v": "purchase"}
    out = spacetime.weather_features(x.fx_anchors, x.fx_obs, names)
    return rounded(out.drop("flood_start_date", "latitude", "longitude", "flood_type"), 4)


_BANDS = """img AS (SELECT cell_id, ts, avg(CASE WHEN variable = 'NDVI' THEN value END) * 0.0001E0 AS ndvi,
  avg(CASE WHEN variable = 'SR_B3' THEN value END) * 0.0000275E0 - 0.2E0 AS g, avg(CASE WHEN variable = 'SR_B5' THEN value END) * 0.0000275E0 - 0.2E0 AS n,
  avg(CASE WHEN variable = 'SR_B6' THEN value END) * 0.0000275E0 - 0.2E0 AS s FROM fx_bands GROUP BY 1, 2)"""


@query("index_features", f"""
WITH {_pairs()}, {_BANDS},
cell AS (SELECT event_id, p.cell_id, avg(ndvi) AS a, avg((s - n) / (s + n + 1e-6)) AS b, avg((g - n) / (g + n + 1e-6)) AS c
  FROM pair AS p JOIN img ON img.cell_id = p.cell_id AND ts >= d - 30 AND ts < d GROUP BY 1, 2),
mean AS (SELECT event_id, avg(a) AS a, avg(b) AS b, avg(c) AS c FROM cell GROUP BY 1)
SELECT event_id, {r("a", 4)} AS gee_ndvi_mean_30d, {r("b", 4)} AS gee_ndbi_mean_30d, {r("c", 4)} AS gee_ndwi_mean_30d FROM fx_anchors LEFT JOIN mean USING (event_id)
""")
def _(x):
    out = spacetime.index_features(x.fx_anchors, x.fx_bands)
    return rounded(out.drop("flood_start_date", "latitude", "longitude", "flood_type"), 4)


@query("clear_sky_index_features", f"""
WITH {_pairs()},
med AS (SELECT event_id, p.cell_id, median(B4 / 10000) AS r4, median(B8 / 10000) AS n8, median(B3 / 10000) AS g3
  FROM pair AS p JOIN fx_images AS i ON i.cell_id = p.cell_id AND ts >= d - 30 AND ts < d AND cloud_pct < 20 AND scene_class IN (4, 5, 6) GROUP BY 1, 2),
mean AS (SELECT event_id, avg((n8 - r4) / nullif(n8 + r4, 0)) AS a, avg((g3 - n8) / nullif(g3 + n8, 0)) AS b FROM med GROUP BY 1)
SELECT event_id, {r("a", 4)} AS "NDVI", {r("b", 4)} AS "NDWI" FROM fx_anchors LEFT JOIN mean USING (event_id)
""")
def _(x):
    out = spacetime.clear_sky_index_features(x.fx_anchors, x.fx_images)
    return rounded(out.select("event_id", "NDVI", "NDWI"), 4)


_CH = "gee_chirps_precip"


@query("daily_rain_features", _window_sql(
    {**{f"s{n}": f"sum({_at(-n, 0)})" for n in (1, 3, 7, 30)}, **{f"m{n}": f"max({_at(-n, 0)})" for n in (3, 7)}},
    {**{f"{_CH}_sum_{n}d_before": f"coalesce(s{n}, 0)" for n in (1, 3, 7, 30)}, **{f"{_CH}_max_{n}d": f"coalesce(m{n}, 0)" for n in (3, 7)},
     f"{_CH}_intensity_7d_before": "CASE WHEN s7 > 0 THEN s7 / 7 ELSE 0 END"}, -30, 0))
def _(x):
    out = spacetime.daily_rain_features(x.fx_anchors, x.fx_obs)
    return rounded(out.drop("flood_start_date", "latitude", "longitude", "flood_type"), 4)


@query("rate_rain_features", _window_sql(
    {"s1": f"sum({_at(-1, 0)})", "s7": f"sum({_at(-7, 0)})", "m": f"max({_at(0, 30)})"},
    {"gee_gpm_precip_sum_1d_before": "coalesce(s1, 0)", "gee_gpm_precip_sum_7d_before": "coalesce(s7, 0)",
     "gee_gpm_precip_max_rate_event_mmhr": "coalesce(m, 0)", "gee_gpm_precip_sum_max_6h_event_mm": "coalesce(m, 0) * 6"}, -7, 30))
def _(x):
    out = spacetime.rate_rain_features(x.fx_anchors, x.fx_obs)
    return rounded(out.drop("flood_start_date", "latitude", "longitude", "flood_type"), 4)


@query("long_rain_features", _window_sql(
    {f"{a}{n}": f"{f}({_at(-n, 0)})" for n in (30, 90) for a, f in (("s", "sum"), ("m", "max"))},
    {f"precip_{w}_{n}d": f"{a}{n}" for n in (30, 90) for a, w in (("s", "total"), ("m", "max"))}, -90, 0))
def _(x):
    out = spacetime.long_rain_features(x.fx_anchors, x.fx_obs)
    return rounded(out.drop("flood_start_date", "latitude", "longitude", "flood_type"), 4)


# ---- indices ------------------------------------------------------------------------------------------

_P24, _P3, _P7 = "gee_imerg_sum_24h_mm", "gee_imerg_sum_3d_before_mm", "gee_imerg_sum_7d_before_mm"
_PEAK, _SLOPE, _SOIL, _UPA = "gee_imerg_max_1h_intensity_mm", "gee_slope_mean", "gee_smap_surface_soil_moisture", "gee_merit_upa_mean"
_INDEX_SQL = {
    "gee_api_weighted_mm": f"0.5E0 * {_P24} + 0.3E0 * {_P3} + 0.2E0 * {_P7}",
    "gee_saturation_proxy": f"{_SOIL} / ({_P7} + 1)",
    "gee_runoff_potential": f"{_P24} * {_SLOPE} / ({_SOIL} + 0.01E0)",
    "gee_antecedent_moisture_proxy": f"0.6E0 * {_P3} + 0.4E0 * {_P7}",
    "gee_precip_x_slope": f"{_P7} * {_SLOPE}",
}
_EVENT_SQL = {
    **_INDEX_SQL,
    "gee_flashiness_index": f"{_PEAK} / (nullif({_P24}, 0) / 24)",
    "gee_twi": f"ln(({_UPA} + 1) / tan(radians({_SLOPE}) + 0.001E0))",
    "gee_moisture_flux": "gee_gfs_precipitable_water_kg_m2 * gee_gfs_wind_speed_ms",
    "gee_flashiness_index_7d": f"CASE WHEN {_P7} > 0 THEN {_PEAK} / ({_P7} / 7 + 1e-6) END",
}
_PIXEL_SQL = {
    **_INDEX_SQL,
    "gee_flashiness_index": f"{_PEAK} / ({_P24} / 24 + 1e-6)",
    "gee_flashiness_index_7d": f"{_PEAK} / ({_P7} / 7 + 1e-6)",
}
_GENTLE = "(SELECT * REPLACE (abs(gee_slope_mean) AS gee_slope_mean) FROM fx_features) AS f"


def _gentle(x):
    return x.fx_features.withColumn("gee_slope_mean", F.abs("gee_slope_mean"))


@query("engineered_indices", f"SELECT row_id, {', '.join(f'{r(e, 4)} AS {n}' for n, e in _EVENT_SQL.items())} FROM {_GENTLE}")
def _(x):
    return rounded(indices.engineer_features(_gentle(x)).select("row_id", *_EVENT_SQL), 4)


@query("engineered_indices_pixel", f"SELECT row_id, {', '.join(f'{r(e, 2)} AS {n}' for n, e in _PIXEL_SQL.items())} FROM {_GENTLE}")
def _(x):
    return rounded(indices.engineer_features(_gentle(x), "pixel").select("row_id", *_PIXEL_SQL), 2)


@query("site_day_features", _window_sql(
    {"s": f"sum({_at(0, 1)}) * 0.5E0", "m": f"max({_at(0, 1)})", "s3": f"sum({_at(-3, 0)}) * 0.5E0", "s7": f"sum({_at(-7, 0)}) * 0.5E0"},
    {"gee_imerg_sum_24h_mm": "s", "gee_imerg_sum_3d_before_mm": "s3", "gee_imerg_sum_7d_before_mm": "s7",
     "gee_api_weighted_mm": "0.5E0 * s + 0.3E0 * s3 + 0.2E0 * s7", "gee_flashiness_index": "m / (nullif(s, 0) / 24)",
     "gee_antecedent_moisture_proxy": "0.6E0 * s3 + 0.4E0 * s7", "gee_flashiness_index_7d": "CASE WHEN s7 > 0 THEN m / (s7 / 7 + 1e-6) END"},
    -7, 1, extra=", m IS NOT NULL AS data_quality_valid"))
def _(x):
    stats = [
        spacetime.WindowStat("gee_imerg_sum_24h_mm", "value", 0, 1, "sum", 0.5),
        spacetime.WindowStat("gee_imerg_max_1h_intensity_mm", "value", 0, 1, "max"),
        *spacetime.antecedent_stats(), spacetime.peak_day_stat(),
    ]
    rain = spacetime.window_features(x.fx_anchors, x.fx_obs, stats)
    checked = rules.quality_flags(rules.repair_features(indices.engineer_features(rain)))
    return rounded(checked.select(
        "event_id", "gee_imerg_sum_24h_mm", "gee_imerg_sum_3d_before_mm", "gee_imerg_sum_7d_before_mm", "gee_api_weighted_mm",
        "gee_flashiness_index", "gee_antecedent_moisture_proxy", "gee_flashiness_index_7d", "data_quality_valid"), 4)


# ---- static grids -----------------------------------------------------------------------------------------

_ZONE = f"""box AS (SELECT event_id, latitude - b / 110540.0 AS y0, latitude + b / 110540.0 AS y1,
  longitude - b / (111320.0 * cos(radians(latitude))) AS x0, longitude + b / (111320.0 * cos(radians(latitude))) AS x1 FROM (SELECT *, {_BUFFER} AS b FROM fx_points) AS p),
hit AS (SELECT event_id, variable, value FROM box JOIN fx_static ON latitude BETWEEN y0 AND y1 AND longitude BETWEEN x0 AND x1)"""


@query("zonal_mean", f"""
WITH {_ZONE}, m AS (SELECT event_id, avg(value) FILTER (variable = 'elevation') AS a, avg(value) FILTER (variable = 'gsw_occurrence') AS b FROM hit GROUP BY 1)
SELECT event_id, {r("a", 4)} AS gee_elevation_mean, {r("b", 4)} AS gee_gsw_occurrence_mean FROM fx_points LEFT JOIN m USING (event_id)
""")
def _(x):
    out = zonal.zonal_mean(x.fx_points, x.fx_static, ["elevation", "gsw_occurrence"])
    return rounded(out.select("event_id", "gee_elevation_mean", "gee_gsw_occurrence_mean"), 4)


@query("zonal_mode", f"""
WITH {_ZONE}, m AS (SELECT event_id, mode(value ORDER BY value) AS a FROM hit WHERE variable = 'land_cover' GROUP BY 1)
SELECT event_id, a AS gee_landcover_mode FROM fx_points LEFT JOIN m USING (event_id)
""")
def _(x):
    return zonal.zonal_mode(x.fx_points, x.fx_static, "land_cover").select("event_id", "gee_landcover_mode")


@query("zonal_fraction", f"""
WITH {_ZONE}, m AS (SELECT event_id, avg(CASE WHEN value = 13 THEN 1 ELSE 0 END) AS a FROM hit WHERE variable = 'land_cover' GROUP BY 1)
SELECT event_id, {r("a")} AS gee_impervious_fraction FROM fx_points LEFT JOIN m USING (event_id)
""")
def _(x):
    return rounded(zonal.zonal_fraction(x.fx_points, x.fx_static, "land_cover", K.URBAN_CLASS).select("event_id", "gee_impervious_fraction"))


def _kernel_sql(kernel):
    terms = [(dr, dc, w) for dr, row in zip((-1, 0, 1), kernel) for dc, w in zip((-1, 0, 1), row)]
    weight = "CASE " + " ".join(f"WHEN b.grid_row - a.grid_row = {dr} AND b.grid_col - a.grid_col = {dc} THEN {w}E0" for dr, dc, w in terms) + " END"
    return f"CASE WHEN count(*) = 9 THEN sum({weight} * b.elevation) / 900 END"


_AROUND = "FROM fx_dem AS a JOIN fx_dem AS b ON b.grid_row BETWEEN a.grid_row - {n} AND a.grid_row + {n} AND b.grid_col BETWEEN a.grid_col - {n} AND a.grid_col + {n}"


@query("curvature", f"""
SELECT a.cell_id, {r(_kernel_sql(K.CURVATURE_KERNEL))} AS curvature, {r(_kernel_sql(K.CURVATURE_KERNEL))} AS profile_curvature,
  {r(_kernel_sql(K.CURVATURE_KERNEL))} AS planform_curvature, {r(_kernel_sql(K.LAPLACIAN_KERNEL))} AS curvature_laplacian {_AROUND.format(n=1)} GROUP BY a.cell_id
""")
def _(x):
    out = terrain.curvature(x.fx_dem, "elevation", 30.0)
    return rounded(out.select("cell_id", "curvature", "profile_curvature", "planform_curvature", "curvature_laplacian"))


_SIDE = "max(CASE WHEN b.grid_row - a.grid_row = {r} AND b.grid_col - a.grid_col = {c} THEN b.elevation END)"
_TERRAIN = f"""
WITH g AS (SELECT a.cell_id, a.grid_row, a.grid_col, ({_SIDE.format(r=0, c=1)} - {_SIDE.format(r=0, c=-1)}) / 60 AS gx, ({_SIDE.format(r=-1, c=0)} - {_SIDE.format(r=1, c=0)}) / 60 AS gy,
  min(CASE WHEN abs(b.grid_row - a.grid_row) + abs(b.grid_col - a.grid_col) <= 1 THEN b.elevation END) AS filled {_AROUND.format(n=1)} GROUP BY 1, 2, 3),
f AS (SELECT a.cell_id, avg(b.filled) AS flow FROM g AS a JOIN g AS b ON (b.grid_row - a.grid_row) * (b.grid_row - a.grid_row) + (b.grid_col - a.grid_col) * (b.grid_col - a.grid_col) <= 4
  AND b.grid_row BETWEEN a.grid_row - 2 AND a.grid_row + 2 GROUP BY 1),
t AS (SELECT cell_id, degrees(atan(sqrt(gx * gx + gy * gy))) AS slope, degrees(atan2(-gx, -gy)) AS az, flow FROM g JOIN f USING (cell_id))
"""


@query("terrain_features", _TERRAIN + f"""
SELECT cell_id, {r("slope", 5)} AS slope, {r("CASE WHEN az < 0 THEN az + 360 ELSE az END", 5)} AS aspect, {r("flow", 5)} AS flow,
  {r("CASE WHEN slope IS NOT NULL THEN ln(flow / greatest(tan(radians(slope)), 0.001E0)) END", 5)} AS wetness, CASE WHEN flow > 950 THEN 1 END AS channel FROM t
""")
def _(x):
    out = terrain.terrain_features(x.fx_dem, "elevation", 30.0, threshold=950.0)
    return rounded(out.select("cell_id", "slope", "aspect", "flow", "wetness", "channel"), 5)


@query("distance_to_nearest", f"""
SELECT a.cell_id, {r("sqrt(min((b.grid_row - a.grid_row) * (b.grid_row - a.grid_row) + (b.grid_col - a.grid_col) * (b.grid_col - a.grid_col))) * 30", 4)} AS distance_m
FROM fx_dem AS a, (SELECT * FROM fx_dem WHERE land_cover = 3) AS b GROUP BY a.cell_id
""")
def _(x):
    marked = x.fx_dem.withColumn("channel", F.col("land_cover") == 3)
    return rounded(terrain.distance_to_nearest(marked, "channel", "distance_m", 30.0).select("cell_id", "distance_m"), 4)


@query("layer_mosaic", f"""
SELECT cell_id, {r("coalesce(CASE WHEN cell_id % 3 > 0 THEN elevation END, elevation + 5)")} AS "Elevation", {r("coalesce(CASE WHEN cell_id % 5 = 0 THEN land_cover END, -1)")} AS "Land_Cover" FROM fx_dem
""")
def _(x):
    first = x.fx_dem.select("cell_id", F.lit("Elevation").alias("variable"), F.lit(0).alias("layer_order"), F.when(F.col("cell_id") % 3 > 0, F.col("elevation")).alias("value"))
    second = x.fx_dem.select("cell_id", F.lit("Elevation").alias("variable"), F.lit(1).alias("layer_order"), (F.col("elevation") + 5).alias("value"))
    third = x.fx_dem.select("cell_id", F.lit("Land_Cover").alias("variable"), F.lit(1).alias("layer_order"), F.when(F.col("cell_id") % 5 == 0, F.col("land_cover").cast("double")).alias("value"))
    layers = first.unionByName(second).unionByName(third)
    return rounded(terrain.mosaic(layers, ["Elevation", "Land_Cover"], fill=-1.0))


@query("roi_tiles", """
SELECT tile_id, count(*) AS n FROM (SELECT CAST(least(floor((longitude - 0.05E0) / (0.4E0 / 5)), 4) * 5 + least(floor((latitude - 0.02E0) / (0.3E0 / 5)), 4) AS BIGINT) AS tile_id
  FROM fx_points WHERE longitude BETWEEN 0.05 AND 0.45 AND latitude BETWEEN 0.02 AND 0.32) AS t GROUP BY tile_id
""")
def _(x):
    return terrain.assign_tiles(x.fx_points, (0.05, 0.02, 0.45, 0.32), 2400.0).groupBy("tile_id").agg(F.count(F.lit(1)).alias("n"))


# ---- forecasts -----------------------------------------------------------------------------------------------

_FC_BUFFER = f"CASE WHEN regexp_matches({_FT}, 'riverine|river|snowmelt|el nino|elnino|storm surge|storm_surge') THEN 20000.0 ELSE 25000.0 END"
_FC_BASIN = f"regexp_matches({_FT}, 'riverine|river|snowmelt|el nino|elnino|storm surge|storm_surge')"
_FC_STRATEGY = (f"CASE WHEN contains({_FT}, '/') OR contains({_FT}, 'mixed') OR ({_FC_BASIN} AND regexp_matches({_FT}, 'flash|urban|pluvial|landslide|dam')) THEN 'hybrid' "
                f"WHEN regexp_matches({_FT}, 'flash|urban|pluvial|wadi|coastal') THEN 'nearest' WHEN {_FC_BASIN} THEN 'mean_bbox' ELSE 'nearest' END")
_FC = f"""
place AS (SELECT DISTINCT latitude, longitude, {_FC_BUFFER} * GROW AS b FROM fx_fc_events),
grid AS (SELECT DISTINCT cell_id, latitude, longitude FROM fx_forecast),
near AS (SELECT p.latitude, p.longitude, b, arg_min(g.cell_id, abs(g.latitude - p.latitude) * 1000000 + abs(g.longitude - p.longitude)) AS cell_id FROM place AS p, grid AS g GROUP BY 1, 2, 3),
boxed AS (SELECT p.latitude, p.longitude, b, g.cell_id FROM place AS p JOIN grid AS g ON g.latitude BETWEEN p.latitude - b / 111000 AND p.latitude + b / 111000
  AND g.longitude BETWEEN p.longitude - b / (111000 * cos(radians(p.latitude))) AND p.longitude + b / (111000 * cos(radians(p.latitude)))),
mean_of AS (SELECT * FROM boxed UNION ALL SELECT * FROM near WHERE (latitude, longitude, b) NOT IN (SELECT (latitude, longitude, b) FROM boxed)),
issue AS (SELECT d, arg_min(ts, abs(epoch(ts) - epoch(d)) - epoch(ts) / 1e12) AS ts FROM (SELECT DISTINCT flood_start_date AS d FROM fx_fc_events) AS e, (SELECT DISTINCT ts FROM fx_forecast) AS f GROUP BY 1)"""
_PLAIN = _FC.replace(" * GROW", "")
_EVENTS = f"(SELECT *, {_FC_BUFFER} AS b, {_FC_STRATEGY} AS strategy FROM fx_fc_events)"


def _noisy(x):
    """The forecast table with a second variable, and every row twice."""
    other = x.fx_forecast.withColumns({"variable": F.lit("swe"), "value": F.lit(0.0)})
    return x.fx_forecast.unionByName(x.fx_forecast).unionByName(other)


@query("forecast_nearest", f"""
WITH {_PLAIN.lstrip()}
SELECT e.event_id, {r("f.value", 4)} AS glofas_forecast_control FROM {_EVENTS} AS e JOIN near AS n ON n.latitude = e.latitude AND n.longitude = e.longitude AND n.b = e.b
JOIN issue AS i ON i.d = e.flood_start_date JOIN fx_forecast AS f ON f.cell_id = n.cell_id AND f.ts = i.ts AND f.product = 'cf'
""")
def _(x):
    return rounded(forecast.forecast_nearest(x.fx_fc_events, _noisy(x)).select("event_id", "glofas_forecast_control"), 4)


@query("forecast_bbox_mean", f"""
WITH {_PLAIN.lstrip()},
v AS (SELECT m.latitude, m.longitude, m.b, f.ts, avg(f.value) AS value FROM mean_of AS m JOIN fx_forecast AS f ON f.cell_id = m.cell_id AND f.product = 'cf' GROUP BY 1, 2, 3, 4)
SELECT e.event_id, {r("v.value", 4)} AS glofas_forecast_control FROM {_EVENTS} AS e JOIN issue AS i ON i.d = e.flood_start_date
JOIN v ON v.latitude = e.latitude AND v.longitude = e.longitude AND v.b = e.b AND v.ts = i.ts
""")
def _(x):
    return rounded(forecast.forecast_bbox_mean(x.fx_fc_events, _noisy(x)).select("event_id", "glofas_forecast_control"), 4)


_MEMBERS = """
used AS (SELECT *, false AS boxed FROM near UNION ALL SELECT *, true FROM mean_of),
v AS (SELECT m.latitude, m.longitude, m.b, m.boxed, f.ts, f.product, f.member, avg(f.value) AS value FROM used AS m JOIN fx_forecast AS f ON f.cell_id = m.cell_id GROUP BY 1, 2, 3, 4, 5, 6, 7),
s AS (SELECT latitude, longitude, b, boxed, ts, avg(value) FILTER (product = 'cf') AS control, avg(value) FILTER (member <> 0) AS mean, median(value) FILTER (member <> 0) AS med,
  stddev_pop(value) FILTER (member <> 0) AS sd, quantile_cont(value, 0.1) FILTER (member <> 0) AS p10, quantile_cont(value, 0.9) FILTER (member <> 0) AS p90 FROM v GROUP BY 1, 2, 3, 4, 5)"""
_ENSEMBLE = f"""{r("mean", 4)} AS glofas_forecast_mean, {r("med", 4)} AS glofas_forecast_median, {r("sd", 4)} AS glofas_forecast_std_dev,
  {r("p10", 4)} AS glofas_forecast_10th_percentile, {r("p90", 4)} AS glofas_forecast_90th_percentile"""
_MATCH = "s.latitude = e.latitude AND s.longitude = e.longitude AND s.b = e.b AND s.ts = i.ts AND s.boxed = (e.strategy <> 'nearest')"


@query("ensemble_stats", f"""
WITH {_PLAIN.lstrip()}, {_MEMBERS.lstrip()}
SELECT e.event_id, {_ENSEMBLE} FROM {_EVENTS} AS e JOIN issue AS i ON i.d = e.flood_start_date JOIN s ON {_MATCH}
""")
def _(x):
    out = forecast.ensemble_stats(x.fx_fc_events, _noisy(x))
    return rounded(out.select("event_id", *K.FORECAST_FEATURES[1:]), 4)


@query("pick_forecast_variable", f"SELECT cell_id, CAST(ts AS DATE) AS day, member, {r('value', 4)} AS value FROM fx_forecast")
def _(x):
    other = x.fx_forecast.withColumns({"variable": F.lit("swe"), "value": F.lit(0.0)})
    picked = forecast.pick_variable(other.unionByName(x.fx_forecast))
    return rounded(picked.select("cell_id", F.to_date("ts").alias("day"), "member", "value"), 4)


@query("control_and_perturbed", f"""
WITH {_PLAIN.lstrip()}, {_MEMBERS.lstrip()}
SELECT e.event_id, {r("c.value", 4)} AS control, {r("mean", 4)} AS perturbed FROM {_EVENTS} AS e JOIN issue AS i ON i.d = e.flood_start_date JOIN s ON {_MATCH}
JOIN near AS n ON n.latitude = e.latitude AND n.longitude = e.longitude AND n.b = e.b JOIN fx_forecast AS c ON c.cell_id = n.cell_id AND c.ts = i.ts AND c.product = 'cf'
""")
def _(x):
    control = forecast.forecast_nearest(x.fx_fc_events, x.fx_forecast).select("event_id", F.col("glofas_forecast_control").alias("control"))
    perturbed = forecast.ensemble_stats(x.fx_fc_events, x.fx_forecast).select("event_id", F.col("glofas_forecast_mean").alias("perturbed"))
    return rounded(control.join(perturbed, "event_id"), 4)


@query("with_forecast", f"""
WITH {_PLAIN.lstrip()}, {_MEMBERS.lstrip()}
SELECT e.event_id, CASE WHEN e.flood_start_date >= DATE '2019-11-05' THEN e.strategy END AS forecast_spatial_strategy, {r("control", 4)} AS glofas_forecast_control, {_ENSEMBLE}
FROM {_EVENTS} AS e JOIN issue AS i ON i.d = e.flood_start_date LEFT JOIN s ON {_MATCH} AND e.flood_start_date >= DATE '2019-11-05'
""")
def _(x):
    out = forecast.with_forecast(x.fx_fc_events, _noisy(x))
    return rounded(out.select("event_id", "forecast_spatial_strategy", *K.FORECAST_FEATURES), 4)


@query("attach_forecasts", f"""
WITH {_PLAIN.lstrip()}, {_MEMBERS.lstrip()}
SELECT e.event_id, e.flood_start_date, e.flood_type, CASE WHEN e.flood_start_date >= DATE '2019-11-05' THEN e.strategy END AS forecast_spatial_strategy,
  {r("control", 4)} AS glofas_forecast_control, {_ENSEMBLE}
FROM {_EVENTS} AS e JOIN issue AS i ON i.d = e.flood_start_date LEFT JOIN s ON {_MATCH} AND e.flood_start_date >= DATE '2019-11-05'
""")
def _(x):
    raw = x.fx_fc_events.withColumn("flood_start_date", F.date_format("flood_start_date", "dd/MM/yyyy"))
    return rounded(enrichment.attach_forecasts(raw, x.fx_forecast), 4)


@query("nearest_issue_time", """
WITH low AS (SELECT t.event_id, t.s, h.s AS below FROM fx_times AS t ASOF LEFT JOIN fx_hours AS h ON t.s >= h.s),
sides AS (SELECT l.event_id, l.s, below, h.s AS above FROM low AS l ASOF LEFT JOIN fx_hours AS h ON l.s <= h.s)
SELECT event_id, s, CAST(CASE WHEN below IS NULL OR above - s <= s - below THEN above ELSE below END AS BIGINT) AS issue FROM sides
""")
def _(x):
    return forecast.nearest_on_axis(x.fx_times, x.fx_hours, "s", "issue").withColumn("issue", F.col("issue").cast("long"))
