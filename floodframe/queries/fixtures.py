"""Hazard tables derived from the given ones. Square roots keep rounded results clear of ties."""

from floodframe.queries.base import FIXTURES

FIXTURES["fx_events"] = """
SELECT o_orderkey AS event_id, CAST(o_orderdate AS DATE) AS flood_start_date,
  CAST((o_custkey * 7919) % 17001 AS DOUBLE) / 100 - 85 AS latitude,
  CAST((o_custkey * 104729) % 36000 AS DOUBLE) / 100 - 180 AS longitude,
  CASE o_orderkey % 9 WHEN 0 THEN 'Flash flood' WHEN 1 THEN 'Riverine flood' WHEN 2 THEN 'Coastal flood'
    WHEN 3 THEN 'Flash/Riverine' WHEN 4 THEN 'Snowmelt' WHEN 5 THEN 'Urban river' WHEN 6 THEN 'Dam break'
    WHEN 7 THEN 'Mixed' ELSE NULL END AS flood_type,
  CAST(o_orderkey % 16 AS INT) AS flood_duration_days, 1 AS target
FROM {orders}
"""

# the same events moved near the release, product and bad-period dates
FIXTURES["fx_recent"] = """
SELECT event_id, flood_start_date + 8700 AS flood_start_date, latitude, longitude, flood_type,
  flood_duration_days, target FROM {fx_events}
"""

FIXTURES["fx_raw_events"] = """
SELECT o_orderkey AS event_id,
  CASE o_orderkey % 13 WHEN 0 THEN 'n/a' WHEN 1 THEN '90.5' WHEN 2 THEN NULL WHEN 3 THEN 'NaN'
    ELSE CAST((o_custkey * 7919) % 181 - 90 AS STRING) END AS "Lat",
  CASE o_orderkey % 11 WHEN 0 THEN '-180.01' WHEN 1 THEN '' ELSE CAST((o_custkey * 104729) % 360 - 180 AS STRING) END AS "LON",
  CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE CAST(o_orderdate AS DATE) END AS flood_start_date
FROM {orders}
""".replace('"Lat"', "lat").replace('"LON"', "long")

_DATE_STYLES = """
SELECT event_id, CASE event_id % 10
  WHEN 0 THEN concat(y, '-', lpad(m, 2, '0'), '-', lpad(d, 2, '0'))
  WHEN 1 THEN concat(lpad(d, 2, '0'), '-', lpad(m, 2, '0'), '-', y)
  WHEN 2 THEN concat('  ', d, '–', m, '—', y, ' ')
  WHEN 3 THEN concat(y, '-', lpad(m, 2, '0'), '-', lpad(d, 2, '0'), 'T00:00:00')
  WHEN 4 THEN concat(lpad(m, 2, '0'), '/', lpad(d, 2, '0'), '/', y)
  WHEN 5 THEN concat(y, '−', lpad(m, 2, '0'), '−', lpad(d, 2, '0'), ' 12:30:00')
  WHEN 6 THEN CAST(serial AS STRING)
  WHEN 7 THEN concat('31-02-', y)
  WHEN 8 THEN NULL
  ELSE 'n/a' END AS raw_date
FROM (SELECT o_orderkey AS event_id, CAST(year(o_orderdate) AS STRING) AS y, CAST(month(o_orderdate) AS STRING) AS m,
  CAST(day(o_orderdate) AS STRING) AS d, SERIAL AS serial FROM {orders}) AS parts
"""
FIXTURES["fx_raw_dates"] = (
    _DATE_STYLES.replace("SERIAL", "datediff(CAST(o_orderdate AS DATE), DATE '1899-12-30')"),
    _DATE_STYLES.replace("SERIAL", "date_diff('day', DATE '1899-12-30', CAST(o_orderdate AS DATE))"),
)

# a 0.2 degree lattice of observation cells
FIXTURES["fx_cells"] = """
SELECT DISTINCT user_id AS cell_id, floor(CAST(user_id AS DOUBLE) / 40) / 5 + 10 AS latitude,
  CAST(user_id % 40 AS DOUBLE) / 5 + 20 AS longitude FROM {events}
"""

FIXTURES["fx_obs"] = """
SELECT event_id AS obs_id, user_id AS cell_id, floor(CAST(user_id AS DOUBLE) / 40) / 5 + 10 AS latitude,
  CAST(user_id % 40 AS DOUBLE) / 5 + 20 AS longitude, ts, sqrt(value) AS value,
  CASE WHEN event_type IN ('error', 'signup') THEN 'late' ELSE 'early' END AS source, event_type AS variable
FROM {events}
"""

FIXTURES["fx_anchors"] = """
SELECT site * 1000 + dayofyear(flood_start_date) AS event_id, flood_start_date,
  floor(CAST(site AS DOUBLE) / 40) / 5 + 10.03 AS latitude, CAST(site % 40 AS DOUBLE) / 5 + 20.02 AS longitude,
  CASE site % 5 WHEN 0 THEN 'Flash flood' WHEN 1 THEN 'Riverine flood' WHEN 2 THEN 'Coastal flood' WHEN 3 THEN 'Snowmelt' ELSE NULL END AS flood_type
FROM (SELECT DISTINCT user_id AS site, CAST(ts AS DATE) + CAST(event_id % 3 AS INT) * 20 AS flood_start_date FROM {events}) AS days
"""

# observations and events of three eras: now, before the early run, before all rain data
_ERA = "CASE {site} % 3 WHEN 1 THEN {day} - 2500 WHEN 2 THEN {day} - 9500 ELSE {day} END"
FIXTURES["fx_era_anchors"] = """
SELECT event_id, CASE site % 3 WHEN 1 THEN flood_start_date - 2500 WHEN 2 THEN flood_start_date - 9500 ELSE flood_start_date END AS flood_start_date,
  latitude, longitude, flood_type
FROM (SELECT *, CAST(floor(CAST(event_id AS DOUBLE) / 1000) AS BIGINT) AS site FROM {fx_anchors}) AS a
"""
FIXTURES["fx_era_obs"] = """
SELECT obs_id, cell_id, latitude, longitude, CASE cell_id % 3 WHEN 1 THEN ts - INTERVAL '2500' DAY WHEN 2 THEN ts - INTERVAL '9500' DAY ELSE ts END AS ts,
  value, source, variable FROM {fx_obs}
"""

# daily images with one row per band
FIXTURES["fx_bands"] = """
SELECT cell_id, latitude, longitude, date_trunc('day', ts) AS ts, value * 900 + 8000 AS value,
  CASE variable WHEN 'click' THEN 'NDVI' WHEN 'view' THEN 'SR_B3' WHEN 'error' THEN 'SR_B5' WHEN 'signup' THEN 'SR_B6' ELSE 'QA' END AS variable
FROM {fx_obs}
"""
FIXTURES["fx_images"] = """
SELECT cell_id, latitude, longitude, ts, CAST(obs_id % 9 AS INT) AS scene_class, CAST(obs_id % 27 AS INT) AS cloud_pct,
  value * 100 + 1 AS "B3", value * 70 + obs_id % 50 AS "B4", value * 90 + obs_id % 70 AS "B8" FROM {fx_obs}
""".replace('"', "")

# fine static grid, 0.01 degrees, and points over it
FIXTURES["fx_dem"] = """
SELECT CAST(floor(CAST(p_partkey AS DOUBLE) / 50) AS INT) AS grid_row, CAST(p_partkey % 50 AS INT) AS grid_col, p_partkey AS cell_id,
  sqrt(p_retailprice * 1000) + (p_partkey * 37) % 11 AS elevation, CAST(p_size % 17 AS INT) AS land_cover FROM {part}
"""
FIXTURES["fx_static"] = """
SELECT cell_id, grid_row, grid_col, CAST(grid_row AS DOUBLE) / 100 AS latitude, CAST(grid_col AS DOUBLE) / 100 AS longitude,
  'elevation' AS variable, CAST(elevation AS DOUBLE) AS value FROM {fx_dem}
UNION ALL
SELECT cell_id, grid_row, grid_col, CAST(grid_row AS DOUBLE) / 100, CAST(grid_col AS DOUBLE) / 100,
  'land_cover', CAST(land_cover AS DOUBLE) FROM {fx_dem}
UNION ALL
SELECT cell_id, grid_row, grid_col, CAST(grid_row AS DOUBLE) / 100, CAST(grid_col AS DOUBLE) / 100,
  'gsw_occurrence', CASE WHEN land_cover < 8 THEN CAST(land_cover * 10 AS DOUBLE) END FROM {fx_dem}
"""
FIXTURES["fx_points"] = """
SELECT c_custkey AS event_id, CAST((c_custkey * 37) % 4007 AS DOUBLE) / 10000 AS latitude,
  CAST((c_custkey * 53) % 5003 AS DOUBLE) / 10000 AS longitude,
  CASE c_custkey % 4 WHEN 0 THEN 'Flash flood' WHEN 1 THEN 'Riverine flood' WHEN 2 THEN 'Snowmelt' ELSE NULL END AS flood_type,
  c_acctbal FROM {customer}
"""

# ensemble forecast on a half-degree lattice, three issue days
_FORECAST = """
SELECT vec_id AS cell_id, floor(CAST(vec_id AS DOUBLE) / 25) / 2 - 5 AS latitude, CAST(vec_id % 25 AS DOUBLE) / 2 - 6 AS longitude,
  CAST(DATE '2024-01-01' + CAST(k * k * 2 AS INT) AS TIMESTAMP) AS ts, CAST(member AS INT) AS member,
  CASE WHEN member = 0 THEN 'cf' ELSE 'pf' END AS product, 'dis24' AS variable, (CAST(v AS DOUBLE) + 1) * 100 * (k + 1) AS value
FROM EXPLODED
"""
FIXTURES["fx_forecast"] = (
    _FORECAST.replace("EXPLODED", "(SELECT vec_id, member, v, explode(sequence(0, 2)) AS k FROM (SELECT vec_id, posexplode(embedding) AS (member, v) FROM {embeddings}))"),
    _FORECAST.replace("EXPLODED", "(SELECT vec_id, member, v, unnest(range(3)) AS k FROM (SELECT vec_id, unnest(range(len(embedding))) AS member, unnest(embedding) AS v FROM {embeddings}) AS m) AS e"),
)
FIXTURES["fx_fc_events"] = """
SELECT o_orderkey AS event_id, CAST((o_custkey * 37) % 957 AS DOUBLE) / 100 - 5.013 AS latitude,
  CAST((o_custkey * 53) % 1213 AS DOUBLE) / 100 - 6.017 AS longitude,
  CASE o_orderkey % 7 WHEN 0 THEN 'Flash flood' WHEN 1 THEN 'Riverine flood' WHEN 2 THEN 'Coastal flood'
    WHEN 3 THEN 'Flash/Riverine' WHEN 4 THEN 'Snowmelt' WHEN 5 THEN 'Mixed' ELSE NULL END AS flood_type,
  CASE WHEN o_orderkey % 10 = 3 THEN DATE '2019-11-04' ELSE DATE '2024-01-01' + CAST(o_custkey % 12 AS INT) END AS flood_start_date
FROM {orders}
"""

FIXTURES["fx_preds"] = """
SELECT concat(CAST(l_orderkey AS STRING), '-', CAST(l_partkey AS STRING), '-', CAST(l_suppkey AS STRING), '-', CAST(l_linenumber AS STRING), '-', CAST(CAST(floor(l_extendedprice) AS BIGINT) AS STRING)) AS row_id,
  l_orderkey, l_partkey, l_suppkey, l_linenumber, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS y,
  l_discount * 10 AS p_a, l_quantity / 50 AS p_b, l_tax * 12 AS p_c, l_extendedprice AS x1, l_quantity AS x2 FROM {lineitem}
"""

FIXTURES["fx_scored"] = """
SELECT row_id, CAST((l_partkey * 7919) % 17001 AS DOUBLE) / 100 - 85 AS latitude,
  CAST((l_partkey * 104729) % 36000 AS DOUBLE) / 100 - 180 AS longitude,
  p_b AS "Final_Risk_Score", p_b - sqrt(x1) * 0.0008E0 AS "Risk_Lower_90", p_b + sqrt(x1) * 0.0012E0 AS "Risk_Upper_90",
  sqrt(x1) * 0.002E0 AS "Uncertainty", CAST(l_partkey % 12 * 10 AS INT) AS "Land_Cover", x1, x2 FROM {fx_preds}
""".replace('"', "")

# feature rows with gaps, zeros and values outside their domains
FIXTURES["fx_features"] = """
SELECT row_id, CAST(x2 - 1 AS DOUBLE) AS gee_imerg_sum_24h_mm,
  CASE WHEN l_partkey % 17 = 0 THEN NULL ELSE sqrt(x1) / 10 END AS gee_imerg_sum_3d_before_mm,
  CASE WHEN l_partkey % 19 = 0 THEN 0E0 ELSE sqrt(x1 * 2) / 10 END AS gee_imerg_sum_7d_before_mm,
  CASE WHEN l_partkey % 23 = 0 THEN NULL WHEN l_partkey % 23 = 1 THEN 0E0 ELSE x2 / 2 END AS gee_imerg_max_1h_intensity_mm,
  p_c * 40 - CASE WHEN l_suppkey % 13 = 0 THEN 30 ELSE 0 END AS gee_slope_mean,
  p_a * 1.1E0 AS gee_smap_surface_soil_moisture, x1 * 3 AS gee_merit_upa_mean,
  p_b * 20 AS gee_gfs_wind_speed_ms, p_c * 70 AS gee_gfs_precipitable_water_kg_m2,
  x2 * 4 - 110 AS gee_gfs_temp2m_celsius, p_a * 103 AS gee_gfs_relative_humidity_pct,
  p_a * 2.02E0 - 1.01E0 AS gee_ndvi_mean_30d, x1 - 600 AS gee_elevation_mean, p_b * 400 AS gee_aspect_mean,
  CAST(CASE WHEN l_suppkey % 11 = 0 THEN 1 ELSE 0 END AS INT) AS imerg_data_missing,
  CASE l_suppkey % 6 WHEN 0 THEN 'Flash flood' WHEN 1 THEN 'Riverine flood' WHEN 2 THEN 'Snowmelt' WHEN 3 THEN 'Mixed' WHEN 4 THEN '' ELSE NULL END AS flood_type,
  DATE '1999-06-01' + CAST(l_partkey % 900 AS INT) AS flood_start_date,
  CAST(l_partkey % 185 - 92 AS DOUBLE) AS latitude, CAST(l_suppkey % 365 - 182 AS DOUBLE) AS longitude, y
FROM {fx_preds}
"""

# chunk ledger: half months of each year with a status
FIXTURES["fx_chunks"] = """
SELECT year(o_orderdate) AS year, month(o_orderdate) AS month, CASE WHEN day(o_orderdate) <= 15 THEN 1 ELSE 2 END AS part,
  count(*) AS n, CASE WHEN year(o_orderdate) = 1996 OR sum(o_custkey) % 4 > 0 OR year(o_orderdate) = 1997 AND month(o_orderdate) < 3 THEN 'completed' ELSE 'failed' END AS status
FROM {orders} GROUP BY year(o_orderdate), month(o_orderdate), CASE WHEN day(o_orderdate) <= 15 THEN 1 ELSE 2 END
"""

# hourly issue times with a hole of 400 days, wanted at odd minutes inside it, around it and beyond both ends
_HOURS = "SELECT DISTINCT date_trunc('hour', CASE WHEN event_id % 2 = 0 THEN ts + INTERVAL '400' DAY ELSE ts END) AS issued FROM {events}"
FIXTURES["fx_hours"] = (f"SELECT unix_seconds(issued) AS s FROM ({_HOURS}) AS h", f"SELECT CAST(epoch(issued) AS BIGINT) AS s FROM ({_HOURS}) AS h")
_TIMES = "SELECT event_id, EPOCH + event_id % 7 * 7776000 - CASE WHEN event_id % 11 = 0 THEN 9000000 ELSE 0 END AS s FROM {events}"
FIXTURES["fx_times"] = (_TIMES.replace("EPOCH", "unix_seconds(date_trunc('minute', ts))"), _TIMES.replace("EPOCH", "CAST(epoch(date_trunc('minute', ts)) AS BIGINT)"))
