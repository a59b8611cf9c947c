"""Queries on cleaning, typing and filtering the event catalogue."""

from pyspark.sql import functions as F

from floodframe import constants as K
from floodframe.functions import dates, flood_types, geo
from floodframe.operators import chunks, cleaning
from floodframe.queries.base import query, r, rounded

_CLEAN_DATE = r"regexp_replace(translate(trim(raw_date), '–—−', '---'), '[T\s].*$', '')"
_PARSED = rf"""
SELECT event_id, CAST(coalesce(
    CASE WHEN regexp_matches(t, '^\d{{4}}-\d{{2}}-\d{{2}}$') THEN try_strptime(t, '%Y-%m-%d') END,
    CASE WHEN regexp_matches(t, '^\d{{1,2}}[-/]\d{{1,2}}[-/]\d{{4}}$') THEN try_strptime(translate(t, '/', '-'), '%d-%m-%Y') END,
    CASE WHEN regexp_matches(t, '^\d{{1,2}}[-/]\d{{1,2}}[-/]\d{{4}}$') THEN try_strptime(translate(t, '/', '-'), '%m-%d-%Y') END,
    CASE WHEN regexp_matches(t, '^\d+$') THEN TIMESTAMP '1899-12-30' + to_days(CAST(t AS INT)) END) AS DATE) AS flood_start_date
FROM (SELECT event_id, {_CLEAN_DATE} AS t FROM fx_raw_dates) AS s
"""


@query("normalize_dashes", "SELECT event_id, translate(trim(raw_date), '–—−', '---') AS raw_date FROM fx_raw_dates")
def _(x):
    return x.fx_raw_dates.withColumn("raw_date", dates.normalize_dashes(F.col("raw_date")))


@query("parse_date_robust", _PARSED)
def _(x):
    return x.fx_raw_dates.select("event_id", dates.parse_date_robust(F.col("raw_date")).alias("flood_start_date"))


@query("pick_date_column", _PARSED.replace("SELECT event_id, CAST", "SELECT 'Start Date' AS picked, event_id, CAST", 1))
def _(x):
    raw = x.fx_raw_dates.withColumnRenamed("raw_date", "Start Date").withColumn("date", F.lit("n/a"))
    picked = dates.pick_date_column(raw.columns)
    return raw.select(F.lit(picked).alias("picked"), "event_id", dates.parse_date_robust(F.col(picked)).alias("flood_start_date"))


@query("detect_date_column", f"""
WITH p AS ({_PARSED})
SELECT 0 AS position, 'start_note' AS column_name, {r("0.0")} AS valid_fraction
UNION ALL SELECT 1, 'date_text', {r("avg(CASE WHEN flood_start_date IS NULL THEN 0 ELSE 1 END)")} FROM p
""")
def _(x):
    raw = x.fx_raw_dates.select("event_id", F.lit("none").alias("start_note"), F.col("raw_date").alias("date_text"))
    return rounded(cleaning.date_column_scores(raw))


@query("date_from_parts", """
SELECT o_orderkey AS event_id, CAST(try_strptime(concat(y, '-', m, '-', d), '%Y-%m-%d') AS DATE) AS flood_start_date FROM (
  SELECT o_orderkey, year(o_orderdate) AS y, CAST(o_orderkey % 14 AS INT) AS m, CAST(o_custkey % 33 AS INT) AS d FROM orders) AS s
""")
def _(x):
    parts = x.orders.select(
        F.col("o_orderkey").alias("event_id"), F.year("o_orderdate").alias("y"),
        (F.col("o_orderkey") % 14).cast("int").alias("m"), (F.col("o_custkey") % 33).cast("int").alias("d"),
    )
    return parts.select("event_id", dates.date_from_parts(F.col("y"), F.col("m"), F.col("d")).alias("flood_start_date"))


_COORDS = """
SELECT event_id, CASE WHEN isnan(a) THEN NULL ELSE a END AS latitude, CASE WHEN isnan(b) THEN NULL ELSE b END AS longitude, flood_start_date
FROM (SELECT event_id, try_cast(lat AS DOUBLE) AS a, try_cast(long AS DOUBLE) AS b, flood_start_date FROM fx_raw_events) AS s
"""


@query("resolve_coords", _COORDS)
def _(x):
    return cleaning.resolve_coords(x.fx_raw_events).drop("lat", "long")


@query("filter_valid_events", f"""
SELECT * FROM ({_COORDS}) AS c WHERE latitude BETWEEN -90 AND 90 AND longitude BETWEEN -180 AND 180 AND flood_start_date IS NOT NULL
""")
def _(x):
    return cleaning.filter_valid_events(cleaning.resolve_coords(x.fx_raw_events)).drop("lat", "long")


@query("event_defaults", "SELECT event_id, flood_start_date, 'Unknown' AS flood_type, 1 AS target FROM fx_events")
def _(x):
    return cleaning.with_event_defaults(x.fx_events.select("event_id", "flood_start_date"))


@query("filter_bad_periods", """
SELECT event_id, flood_start_date FROM fx_recent
WHERE NOT (flood_start_date BETWEEN DATE '2025-01-01' AND DATE '2025-01-04' OR flood_start_date BETWEEN DATE '2024-11-27' AND DATE '2024-11-28'
  OR flood_start_date BETWEEN DATE '2024-03-19' AND DATE '2024-03-21')
""")
def _(x):
    return cleaning.filter_bad_periods(x.fx_recent).select("event_id", "flood_start_date")


@query("classify_release", """
SELECT event_id, CASE WHEN flood_start_date < DATE '2021-05-26' THEN '3.1' ELSE '4.0' END AS model_version,
  CASE WHEN flood_start_date < DATE '2021-05-26' THEN 'control_reforecast' ELSE 'ensemble_perturbed_reforecasts' END AS product_type,
  CASE WHEN flood_start_date < DATE '2021-05-26' THEN 'htessel_lisflood' ELSE 'lisflood' END AS model_name FROM fx_recent
""")
def _(x):
    return x.fx_recent.select("event_id", *[c.alias(n) for n, c in dates.classify_release(F.col("flood_start_date")).items()])


@query("half_month_part", """
SELECT event_id, year(flood_start_date) AS year, month(flood_start_date) AS month, CASE WHEN day(flood_start_date) <= 15 THEN 1 ELSE 2 END AS part FROM fx_events
""")
def _(x):
    return chunks.with_chunk(x.fx_events).select("event_id", "year", "month", "part")


@query("select_day_range", "SELECT event_id, flood_start_date FROM fx_events WHERE day(flood_start_date) BETWEEN 16 AND 31")
def _(x):
    return chunks.select_days(x.fx_events, 16, 31).select("event_id", "flood_start_date")


@query("plan_requests", """
SELECT CASE WHEN day < DATE '2021-05-26' THEN 'htessel_lisflood' ELSE 'lisflood' END AS model, year(day) AS year, month(day) AS month,
  list(day ORDER BY day) AS days, count(*) AS n_days
FROM (SELECT DISTINCT CAST(unnest(generate_series(flood_start_date, flood_start_date + flood_duration_days, INTERVAL 1 DAY)) AS DATE) AS day FROM fx_recent) AS d
WHERE NOT (day BETWEEN DATE '2025-01-01' AND DATE '2025-01-04' OR day BETWEEN DATE '2024-11-27' AND DATE '2024-11-28'
  OR day BETWEEN DATE '2024-03-19' AND DATE '2024-03-21')
GROUP BY 1, 2, 3
""")
def _(x):
    ranges = x.fx_recent.select(
        F.col("flood_start_date").alias("start_date"), F.date_add("flood_start_date", F.col("flood_duration_days")).alias("end_date")
    )
    return chunks.plan_requests(chunks.expand_ranges(ranges))


@query("needs_forecast", """
SELECT year(flood_start_date) AS year, month(flood_start_date) AS month, CASE WHEN day(flood_start_date) <= 15 THEN 1 ELSE 2 END AS part,
  bool_or(flood_start_date >= DATE '2019-11-05') AS need_forecast FROM fx_recent GROUP BY 1, 2, 3
""")
def _(x):
    return chunks.needs_forecast(chunks.with_chunk(x.fx_recent), ["year", "month", "part"])


@query("calendar_features", f"""
SELECT event_id, month(flood_start_date) AS month, dayofyear(flood_start_date) AS day_of_year,
  {r("round(sin(2 * pi() * (month(flood_start_date) / 12.0)), 10)", 8)} AS month_sin, {r("round(cos(2 * pi() * (month(flood_start_date) / 12.0)), 10)", 8)} AS month_cos,
  {r("round(sin(2 * pi() * (dayofyear(flood_start_date) / 365.0)), 10)", 8)} AS doy_sin, {r("round(cos(2 * pi() * (dayofyear(flood_start_date) / 365.0)), 10)", 8)} AS doy_cos
FROM fx_events
""")
def _(x):
    out = cleaning.with_calendar(x.fx_events).select("event_id", "month", "day_of_year", "month_sin", "month_cos", "doy_sin", "doy_cos")
    return rounded(out, 8)


_FT = "lower(coalesce(flood_type, ''))"
_BASIN = f"regexp_matches({_FT}, 'riverine|river|snowmelt|el nino|elnino|storm surge|storm_surge')"


@query("spatial_strategy", f"""
SELECT event_id, CASE WHEN contains({_FT}, '/') OR contains({_FT}, 'mixed') OR ({_BASIN} AND regexp_matches({_FT}, 'flash|urban|pluvial|landslide|dam')) THEN 'hybrid'
  WHEN regexp_matches({_FT}, 'flash|urban|pluvial|wadi|coastal') THEN 'nearest' WHEN {_BASIN} THEN 'mean_bbox' ELSE 'nearest' END AS strategy
FROM fx_events
""")
def _(x):
    return x.fx_events.select("event_id", flood_types.spatial_strategy(F.col("flood_type")).alias("strategy"))


_BUFFER = f"CASE WHEN regexp_matches({_FT}, 'flash|urban|local') THEN 25000 WHEN regexp_matches({_FT}, 'riverine|river|coastal') THEN 50000 ELSE 25000 END"


@query("buffer_sizes", f"SELECT event_id, {_BUFFER} AS feature_buffer, CASE WHEN {_BASIN} THEN 20000 ELSE 25000 END AS forecast_buffer FROM fx_events")
def _(x):
    ft = F.col("flood_type")
    return x.fx_events.select(
        "event_id", flood_types.buffer_m(ft).alias("feature_buffer"), flood_types.buffer_m(ft, "forecast").alias("forecast_buffer")
    )


@query("bounding_box", f"""
SELECT event_id, {r("latitude - b / 110540.0")} AS lat_min, {r("latitude + b / 110540.0")} AS lat_max,
  {r("longitude - b / (111320.0 * cos(radians(latitude)))")} AS lon_min, {r("longitude + b / (111320.0 * cos(radians(latitude)))")} AS lon_max,
  {r("longitude + b / (111000.0 * cos(radians(latitude)))")} AS lon_max_uniform
FROM (SELECT *, CAST({_BUFFER} AS DOUBLE) AS b FROM fx_events) AS e
""")
def _(x):
    args = F.col("latitude"), F.col("longitude"), flood_types.buffer_m(F.col("flood_type"))
    box = {**geo.bbox(*args), "lon_max_uniform": geo.bbox(*args, uniform=True)["lon_max"]}
    return rounded(x.fx_events.select("event_id", *[c.alias(n) for n, c in box.items()]))


@query("wrap_longitude", f"""
SELECT event_id, {r("CASE WHEN longitude < 0 THEN longitude + 360 ELSE longitude END")} AS lon_360,
  {r("(longitude * 3 + 900) - 360 * floor((longitude * 3 + 900) / 360) - 180")} AS lon_180 FROM fx_events
""")
def _(x):
    lon = F.col("longitude")
    return rounded(x.fx_events.select("event_id", geo.wrap_lon(lon, "360").alias("lon_360"), geo.wrap_lon(lon * 3 + 720).alias("lon_180")))


@query("drop_leaky", "SELECT event_id, flood_start_date, flood_type FROM fx_events")
def _(x):
    leaky = x.fx_events.select("event_id", "flood_start_date", "flood_type", "latitude", "longitude")
    return cleaning.drop_leaky(leaky.withColumns({"confidence_score": F.lit(1.0), "rain_Event_Day_mm": F.lit(0.0)}))


@query("null_invalid_zeros", f"""
SELECT row_id, {r("gee_imerg_sum_24h_mm")} AS gee_imerg_sum_24h_mm, {r("nullif(p_a, 0)")} AS gee_smap_surface_soil_moisture, {r("nullif(p_c, 0)")} AS gee_twi
FROM (SELECT f.row_id, f.gee_imerg_sum_24h_mm, p.p_a, p.p_c FROM fx_features f JOIN fx_preds p USING (row_id)) AS j
""")
def _(x):
    df = x.fx_preds.select("row_id", (F.col("x2") - 1).alias("gee_imerg_sum_24h_mm"),
                           F.col("p_a").alias("gee_smap_surface_soil_moisture"), F.col("p_c").alias("gee_twi"))
    return rounded(cleaning.null_invalid_zeros(df, ["gee_imerg_sum_24h_mm", "gee_smap_surface_soil_moisture", "gee_twi"]))


@query("clean_label", """
SELECT row_id, CAST(greatest(0, least(1, round_even(v, 0))) AS INT) AS target_future FROM (
  SELECT row_id, CASE WHEN l_suppkey % 10 = 0 THEN NULL ELSE p_a * 3 - 1 END AS v FROM fx_preds) AS s
WHERE v IS NOT NULL
""")
def _(x):
    raw = F.when(F.col("l_suppkey") % 10 == 0, None).otherwise(F.col("p_a") * 3 - 1)
    odd = F.when(F.col("l_suppkey") % 20 == 0, float("inf")).otherwise(raw)
    return cleaning.clean_label(x.fx_preds.select("row_id", odd.alias("target_future")))


@query("enforce_schema", f"""
SELECT row_id, {r("gee_slope_mean")} AS gee_slope_mean, CAST(NULL AS DOUBLE) AS gee_twi, {r("y")} AS y,
  CAST(NULL AS DOUBLE) AS flood_type FROM fx_features
""")
def _(x):
    return rounded(cleaning.enforce_schema(x.fx_features, ["gee_slope_mean", "gee_twi", "y", "flood_type"], keep=["row_id"]))


@query("land_cover_names", """
SELECT row_id, CASE Land_Cover WHEN 10 THEN 'Trees' WHEN 20 THEN 'Shrubland' WHEN 30 THEN 'Grassland' WHEN 40 THEN 'Cropland'
  WHEN 50 THEN 'Built-up' WHEN 60 THEN 'Bare/Sparse vegetation' WHEN 70 THEN 'Snow/Ice' WHEN 80 THEN 'Water' WHEN 90 THEN 'Wetland'
  WHEN 95 THEN 'Mangroves' WHEN 100 THEN 'Moss/Lichen' ELSE 'Unknown' END AS "Land_Cover_Type" FROM fx_scored
""")
def _(x):
    return cleaning.with_land_cover_type(x.fx_scored).select("row_id", "Land_Cover_Type")


_IMPUTED = ["gee_imerg_sum_3d_before_mm", "gee_imerg_max_1h_intensity_mm", "gee_slope_mean"]


@query("impute_median", "SELECT row_id, " + ", ".join(
    r(f"coalesce({c}, (SELECT quantile_cont({c}, 0.5) FROM fx_features))") + f" AS {c}" for c in _IMPUTED) + " FROM fx_features")
def _(x):
    return rounded(cleaning.impute_median(x.fx_features.select("row_id", *_IMPUTED), _IMPUTED))


@query("region_flags", """
SELECT row_id, CASE WHEN e > 1000 AND m IN (3, 4, 5, 6) THEN 1 ELSE 0 END AS snowmelt_risk_spring,
  CASE WHEN e > 800 AND abs(latitude) > 35 THEN 1 ELSE 0 END AS snow_region, CASE WHEN m IN (3, 4, 5, 6) THEN 1 ELSE 0 END AS is_snowmelt_season,
  CASE WHEN m IN (6, 7, 8, 9) THEN 1 ELSE 0 END AS is_monsoon_season, CASE WHEN m IN (12, 1, 2, 3) THEN 1 ELSE 0 END AS is_ice_season,
  CASE WHEN abs(latitude) < 23.5 THEN 1 ELSE 0 END AS tropical_region, CASE WHEN abs(latitude) >= 23.5 AND abs(latitude) < 50 THEN 1 ELSE 0 END AS temperate_region,
  CASE WHEN latitude > 50 THEN 1 ELSE 0 END AS northern_region
FROM (SELECT row_id, latitude, gee_elevation_mean / 30 AS e, month(flood_start_date) AS m FROM fx_features) AS f
""")
def _(x):
    df = x.fx_features.select("row_id", "latitude", "flood_start_date", (F.col("gee_elevation_mean") / 30).alias("gee_elevation_mean"))
    return cleaning.with_region_flags(df).drop("latitude", "flood_start_date", "gee_elevation_mean")


@query("severity_label", """
SELECT event_id, CASE WHEN flood_duration_days / 4.0 >= 1.5 THEN 1 ELSE 0 END AS y_binary, year(flood_start_date) AS event_year FROM fx_events
""")
def _(x):
    df = x.fx_events.withColumn("severity", F.col("flood_duration_days") / 4.0)
    return cleaning.with_severity_label(df).select("event_id", "y_binary", "event_year")


@query("coverage_flags", """
SELECT event_id, d < DATE '2000-06-01' AS pre_rain_era, d >= DATE '2000-06-01' AND d < DATE '2015-03-31' AS pre_moisture_era,
  CASE WHEN d < DATE '2000-06-01' THEN 'pre_imerg_era' ELSE '' END AS imerg_coverage_note,
  CASE WHEN d < DATE '2000-06-01' THEN 'none' WHEN d < DATE '2019-06-01' THEN 'late' ELSE 'early' END AS event_day_source,
  CASE WHEN d < DATE '2015-03-31' THEN 'v007' ELSE 'v008' END AS smap_version_used
FROM (SELECT event_id, flood_start_date AS d FROM fx_events UNION ALL SELECT event_id, flood_start_date FROM fx_recent) AS e
""")
def _(x):
    df = x.fx_events.unionByName(x.fx_recent)
    return cleaning.with_coverage(df).select(
        "event_id", "pre_rain_era", "pre_moisture_era", "imerg_coverage_note", "event_day_source", "smap_version_used")


@query("lineage_stamps", f"""
SELECT event_id, '{K.PIPELINE_VERSION}' AS pipeline_version, '{K.PROCESSING_VERSION}' AS processing_version,
  '{K.DATA_SOURCES}' AS data_sources, 14 AS max_latency_hours, true AS stamped FROM fx_events
""")
def _(x):
    df = cleaning.with_lineage(x.fx_events.select("event_id"))
    stamped = F.col("data_extraction_timestamp").isNotNull() & F.col("processing_date").isNotNull()
    return df.withColumn("stamped", stamped).drop("data_extraction_timestamp", "processing_date")


_SPARSE = {
    "empty": "CAST(NULL AS DOUBLE)", "zero": "CAST(0 AS DOUBLE)",
    "rare": "CASE WHEN l_partkey % 50 = 0 THEN x1 END", "rare_nonzero": "CASE WHEN l_partkey % 50 = 0 THEN x1 ELSE 0E0 END",
    "filled": "x1",
}


@query("drop_sparse_columns", "SELECT row_id, CAST(NULL AS DOUBLE) AS confidence_score, CAST(l_partkey AS STRING) AS part_text, x1 AS filled FROM fx_preds")
def _(x):
    df = x.fx_preds.selectExpr("row_id", "CAST(l_partkey AS STRING) AS part_text", "CAST(NULL AS DOUBLE) AS confidence_score",
                               *[f"{e} AS {n}" for n, e in _SPARSE.items()])
    return cleaning.drop_sparse_columns(df, protect=(*K.SPARSE_PROTECTED, "row_id"))


@query("sparse_column_report", "WITH s AS (SELECT " + ", ".join(f"{e} AS {n}" for n, e in _SPARSE.items()) + " FROM fx_preds)" + " UNION ALL ".join(f"""
SELECT '{n}' AS column_name, {r(f"1 - count({n}) / count(*)")} AS null_fraction, {r(f"avg(CASE WHEN abs(coalesce({n}, 0)) < 1e-12 THEN 1 ELSE 0 END)")} AS zero_fraction,
  {"false" if n == "filled" else "true"} AS dropped FROM s""" for n in _SPARSE))
def _(x):
    df = x.fx_preds.selectExpr(*[f"{e} AS {n}" for n, e in _SPARSE.items()])
    return rounded(cleaning.sparse_column_report(df))


@query("first_rows", "SELECT event_id, flood_start_date FROM fx_events ORDER BY flood_start_date, event_id LIMIT 100")
def _(x):
    return cleaning.limit_rows(x.fx_events.select("event_id", "flood_start_date"), 100, "flood_start_date", "event_id")


@query("sample_rows", "SELECT event_id, flood_start_date FROM fx_events ORDER BY md5(concat(CAST(event_id AS STRING), '|42')) LIMIT 500")
def _(x):
    return cleaning.sample_rows(x.fx_events.select("event_id", "flood_start_date"), 500, "event_id")
