"""Queries on rules, quality checks, sampling and sources."""

from pyspark.sql import functions as F

from floodframe import constants as K
from floodframe.operators import chunks, cleaning, negatives, rules
from floodframe.queries.base import query, r, rounded
from floodframe.session import scratch_path
from floodframe.sources import events as event_files, feature_store, grids, sinks

_RANGED = {
    "gee_imerg_sum_24h_mm": (0, 10000), "gee_slope_mean": (0, 90), "gee_aspect_mean": (0, 360), "gee_elevation_mean": (-500, 9000),
    "gee_gfs_temp2m_celsius": (-50, 60), "gee_gfs_relative_humidity_pct": (0, 100),
}


@query("null_out_of_range", "SELECT row_id, " + ", ".join(
    r(f"CASE WHEN {c} BETWEEN {lo} AND {hi} THEN {c} END") + f" AS {c}" for c, (lo, hi) in _RANGED.items()) + " FROM fx_features")
def _(x):
    return rounded(rules.null_out_of_range(x.fx_features.select("row_id", *_RANGED)))


def _repair_sql(c, kind, lo, hi):
    if kind == "bounded":
        return (f"CASE WHEN abs({c}) < 1e-10 THEN 0 WHEN {c} < {lo} THEN CASE WHEN {c} > {lo} - 0.01E0 THEN {lo} END "
                f"WHEN {c} > {hi} THEN CASE WHEN {c} < {hi} + 0.01E0 THEN {hi} END ELSE {c} END")
    if kind == "non_negative":
        return f"CASE WHEN {c} < 0 THEN CASE WHEN {c} > -1e-10 THEN 0 END ELSE {c} END"
    if hi is None:
        return f"CASE WHEN {c} < {lo} THEN NULL ELSE {c} END"
    return f"CASE WHEN {c} < {lo} OR {c} > {hi} THEN NULL ELSE {c} END"


_REPAIRED = {
    "gee_ndvi_mean_30d": ("bounded", -1, 1), "gee_smap_surface_soil_moisture": ("fraction", 0, 1),
    "gee_gfs_relative_humidity_pct": ("percentage", 0, 100), "gee_slope_mean": ("slope", 0, 90), "gee_aspect_mean": ("angle", 0, 360),
    "gee_gfs_temp2m_celsius": ("celsius", -90, 60), "gee_imerg_sum_24h_mm": ("non_negative", 0, None),
    "gee_elevation_mean": ("lower_bound", -500, None), "gee_merit_upa_mean": ("positive", 0, None),
}


@query("repair_features", "SELECT row_id, " + ", ".join(
    r(_repair_sql(c, *rule)) + f" AS {c}" for c, rule in _REPAIRED.items()) + " FROM fx_features")
def _(x):
    return rounded(rules.repair_features(x.fx_features.select("row_id", *_REPAIRED)))


_FLAGS = """
SELECT row_id, concat_ws('|', CASE WHEN gee_imerg_max_1h_intensity_mm IS NULL THEN 'missing_imerg_intensity_features' END,
    CASE WHEN flood_start_date > DATE '2001-06-01' THEN 'future_event_date_' || CAST(flood_start_date AS VARCHAR) END,
    CASE WHEN abs(latitude) > 90 THEN 'invalid_latitude_' || CAST(latitude AS VARCHAR) END,
    CASE WHEN abs(longitude) > 180 THEN 'invalid_longitude_' || CAST(longitude AS VARCHAR) END) AS data_quality_issues,
  concat_ws('|',
    CASE WHEN imerg_data_missing = 1 OR gee_imerg_max_1h_intensity_mm IS NULL AND s7 IS NULL THEN 'imerg_data_unavailable'
      WHEN contains(ft, 'flash') THEN CASE WHEN gee_imerg_max_1h_intensity_mm = 0 THEN 'zero_precipitation_flash_flood'
        WHEN gee_imerg_max_1h_intensity_mm < 10 THEN 'low_intensity_flash_flood_' || printf('%.1f', gee_imerg_max_1h_intensity_mm) || 'mm_hr' END
      WHEN contains(ft, 'river') THEN CASE WHEN s7 = 0 THEN 'zero_precipitation_riverine_flood'
        WHEN s7 < 25 THEN 'low_precip_riverine_flood_' || printf('%.1f', s7) || 'mm_7d' END
      WHEN contains(ft, 'snowmelt') THEN NULL
      WHEN gee_imerg_max_1h_intensity_mm = 0 OR s7 = 0 THEN 'zero_precipitation_' || CASE WHEN ft = '' THEN 'unknown' ELSE ft END END,
    CASE WHEN soil IS NULL THEN 'smap_surface_soil_moisture_missing' END,
    CASE WHEN gee_gfs_temp2m_celsius IS NULL AND gee_gfs_relative_humidity_pct IS NULL THEN 'gfs_atmospheric_missing' END,
    CASE WHEN flood_start_date < DATE '2000-06-01' THEN 'pre_imerg_era_' || CAST(flood_start_date AS VARCHAR) END,
    CASE WHEN soil < 0 OR soil > 1 THEN 'soil_moisture_out_of_range_' || printf('%.3f', soil) END,
    CASE WHEN gee_gfs_temp2m_celsius < -50 OR gee_gfs_temp2m_celsius > 60 THEN 'temperature_out_of_range_' || printf('%.1f', gee_gfs_temp2m_celsius) || 'C' END
  ) AS data_quality_warnings
FROM (SELECT *, gee_smap_surface_soil_moisture AS soil, gee_imerg_sum_7d_before_mm AS s7, lower(coalesce(flood_type, 'none')) AS ft FROM fx_features) AS f
"""
_WITH_VALID = f"SELECT *, data_quality_issues = '' AS data_quality_valid FROM ({_FLAGS}) AS q"


def _flagged(x):
    return rules.quality_flags(x.fx_features, now=F.lit("2001-06-01").cast("timestamp"))


@query("quality_flags", _WITH_VALID)
def _(x):
    return _flagged(x).select("row_id", "data_quality_issues", "data_quality_warnings", "data_quality_valid")


@query("quality_totals", f"""
SELECT count(*) AS total_events, count(*) FILTER (data_quality_valid) AS valid_events, count(*) FILTER (NOT data_quality_valid) AS invalid_events,
  {r("(SELECT avg(imerg_data_missing) * 100 FROM fx_features)")} AS rain_missing_pct FROM ({_WITH_VALID}) AS v
""")
def _(x):
    return rounded(rules.quality_totals(_flagged(x)))


@query("common_issues", f"""
SELECT issue, count(*) AS n FROM (SELECT unnest(string_split(data_quality_issues, '|')) AS issue FROM ({_FLAGS}) AS q WHERE data_quality_issues <> '') AS i
GROUP BY issue ORDER BY n DESC, issue LIMIT 10
""")
def _(x):
    return rules.common_issues(_flagged(x))


@query("flood_type_counts", "SELECT flood_type, count(*) AS n FROM fx_events WHERE flood_type IS NOT NULL GROUP BY flood_type")
def _(x):
    return rules.value_counts(x.fx_events, "flood_type")


@query("catalogue_extent", f"""
SELECT count(*) AS events, min(flood_start_date) AS first_date, max(flood_start_date) AS last_date, {r("min(latitude)")} AS lat_min,
  {r("max(latitude)")} AS lat_max, {r("min(longitude)")} AS lon_min, {r("max(longitude)")} AS lon_max FROM fx_events
""")
def _(x):
    return rounded(rules.catalogue_profile(x.fx_events)["extent"])


@query("top_flood_types", "SELECT flood_type, count(*) AS n FROM fx_events WHERE flood_type IS NOT NULL GROUP BY flood_type ORDER BY n DESC, flood_type LIMIT 10")
def _(x):
    return rules.catalogue_profile(x.fx_events)["flood_types"]


# ---- negatives and augmentation ----------------------------------------------------------------

_NEGATIVES = """
SELECT concat('neg_', CAST(event_id AS VARCHAR), '_d', CAST(n AS VARCHAR)) AS event_id, flood_start_date - CAST(n AS INT) AS flood_start_date, latitude, longitude,
  0 AS target, CASE n WHEN 1 THEN 0.9E0 WHEN 3 THEN 0.3E0 ELSE 0E0 END AS soft_label, CASE WHEN n IN (1, 3) THEN 1 ELSE 0 END AS near_miss,
  year(flood_start_date - CAST(n AS INT)) AS year
FROM (SELECT * REPLACE (flood_start_date - 5475 AS flood_start_date) FROM fx_events) AS e, (SELECT unnest([1, 3, 7, 15, 30]) AS n) AS o
WHERE flood_start_date - CAST(n AS INT) >= DATE '1980-01-01'
"""


def _old(x):
    return x.fx_events.withColumn("flood_start_date", F.date_sub("flood_start_date", 5475))


@query("negatives_time_offset", _NEGATIVES)
def _(x):
    return negatives.negatives_time_offset(_old(x)).select(
        "event_id", "flood_start_date", "latitude", "longitude", "target", "soft_label", "near_miss", "year")


_EXTRA = "CASE WHEN flood_duration_days <= 2 THEN 0 WHEN flood_duration_days <= 4 THEN 1 WHEN flood_duration_days <= 8 THEN 2 WHEN flood_duration_days <= 12 THEN 3 ELSE 4 END"
_AUGMENTED = f"""
SELECT event_id, flood_start_date + CAST(k AS INT) AS flood_start_date, flood_duration_days, target
FROM (SELECT *, unnest(range({_EXTRA} + 1)) AS k FROM fx_events) AS e
"""


@query("augment_by_duration", _AUGMENTED)
def _(x):
    return negatives.augment_by_duration(x.fx_events).select("event_id", "flood_start_date", "flood_duration_days", "target")


@query("combine_events", f"""
SELECT event_id, target, soft_label, near_miss, year(flood_start_date) AS year, month(flood_start_date) AS month FROM (
  SELECT CAST(event_id AS VARCHAR) AS event_id, flood_start_date, target, CAST(NULL AS DOUBLE) AS soft_label, NULL AS near_miss FROM ({_AUGMENTED}) AS a
  UNION ALL SELECT event_id, flood_start_date, target, soft_label, near_miss FROM ({_NEGATIVES.replace("flood_start_date - 5475", "flood_start_date")}) AS n) AS u
""")
def _(x):
    positives = x.fx_events.withColumn("event_id", F.col("event_id").cast("string"))
    both = negatives.combine_events(negatives.augment_by_duration(positives), negatives.negatives_time_offset(positives))
    return both.select("event_id", "target", "soft_label", "near_miss", "year", "month")


@query("exclusion_zone", """
WITH p AS (SELECT DISTINCT 6378137 * radians(latitude * 0.2E0) AS px, 6378137 * ln(tan(pi() / 4 + radians(longitude * 0.2E0) / 2)) AS py FROM fx_events),
c AS (SELECT c_custkey AS event_id, CAST((c_custkey * 7907) % 17011 AS DOUBLE) / 500 - 17 AS latitude, CAST((c_custkey * 10007) % 36013 AS DOUBLE) / 500 - 36 AS longitude FROM customer),
m AS (SELECT event_id, 6378137 * radians(latitude) AS x, 6378137 * ln(tan(pi() / 4 + radians(longitude) / 2)) AS y FROM c)
SELECT event_id FROM m WHERE NOT EXISTS (SELECT 1 FROM p WHERE (x - px) * (x - px) + (y - py) * (y - py) <= 75000.0 * 75000.0)
""")
def _(x):
    # latitude and longitude swap roles on both sides, which spreads the points over the plane
    positives = x.fx_events.select((F.col("longitude") * 0.2).alias("latitude"), (F.col("latitude") * 0.2).alias("longitude"))
    candidates = x.customer.select(
        F.col("c_custkey").alias("event_id"),
        ((F.col("c_custkey") * 10007) % 36013 / F.lit(500.0) - 36).alias("latitude"),
        ((F.col("c_custkey") * 7907) % 17011 / F.lit(500.0) - 17).alias("longitude"),
    )
    return negatives.exclude_within(candidates, positives).select("event_id")


def _countries(x):
    """A triangle per nation."""
    corner = lambda dx, dy: F.struct((F.col("x0") + dx).alias("x"), (F.col("y0") + dy).alias("y"))
    return x.nation.select(
        F.upper(F.col("n_name")).alias("country_code"),
        (F.col("n_nationkey") % 5 * 30.0 - 70).cast("double").alias("x0"), (F.floor(F.col("n_nationkey") / 5) * 20.0 - 50).cast("double").alias("y0"),
    ).select("country_code", F.array(corner(0.0, 0.0), corner(25.0, 0.0), corner(12.0, 15.0), corner(0.0, 0.0)).alias("ring"))


def _with_country(x):
    names = x.nation.select(F.col("n_nationkey"), F.col("n_name").alias("country_code"))
    return x.fx_events.join(names, F.col("event_id") % 7 == F.col("n_nationkey")).drop("n_nationkey")


_UNIT = "CAST(CAST('0x' || substr(md5(concat(CAST(candidate AS VARCHAR), '|{seed}')), 1, 13) AS BIGINT) AS DOUBLE) / 4503599627370496.0E0"
_TRIANGLES = "tri AS (SELECT upper(n_name) AS country_code, CAST(n_nationkey % 5 * 30 - 70 AS DOUBLE) AS x0, CAST(floor(n_nationkey / 5) * 20 - 50 AS DOUBLE) AS y0 FROM nation)"
_INSIDE = "latitude > y0 AND 15 * (longitude - x0) > 12 * (latitude - y0) AND 15 * (x0 + 25 - longitude) > 13 * (latitude - y0)"


@query("negatives_spatial", f"""
WITH {_TRIANGLES},
p AS (SELECT e.*, n_name FROM fx_events AS e JOIN nation ON e.event_id % 7 = n_nationkey),
home AS (SELECT *, 6378137 * radians(x0) AS mx, 6378137 * ln(tan(pi() / 4 + radians(y0) / 2)) AS m0, 6378137 * ln(tan(pi() / 4 + radians(y0 + 15) / 2)) AS m1 FROM tri WHERE country_code IN (SELECT upper(n_name) FROM p)),
line AS (SELECT *, sum(area) OVER (ORDER BY country_code) AS upto FROM (SELECT *, 6378137 * radians(25) * (m1 - m0) / 2 AS area FROM home) AS h),
c AS (SELECT unnest(range(0, (SELECT count(*) * 4 + 1000 FROM p))) AS candidate),
u AS (SELECT candidate, {_UNIT.format(seed=K.SEED)} * (SELECT sum(area) FROM line) AS pos, {_UNIT.format(seed=K.SEED + 1)} AS a, {_UNIT.format(seed=K.SEED + 2)} AS b FROM c),
d AS (SELECT candidate, x0 + a * 25 AS longitude, y0 + b * 15 AS latitude, country_code, x0, y0 FROM u JOIN line ON pos >= upto - area AND pos < upto),
i AS (SELECT *, 6378137 * radians(longitude) AS x, 6378137 * ln(tan(pi() / 4 + radians(latitude) / 2)) AS y FROM d WHERE {_INSIDE}),
q AS (SELECT DISTINCT 6378137 * radians(longitude) AS px, 6378137 * ln(tan(pi() / 4 + radians(latitude) / 2)) AS py FROM p),
near AS (SELECT DISTINCT candidate FROM i JOIN (SELECT *, CAST(floor(px / 7500) AS BIGINT) + di AS bx, CAST(floor(py / 7500) AS BIGINT) + dj AS bz FROM q, (SELECT unnest([-1, 0, 1]) AS di) AS e, (SELECT unnest([-1, 0, 1]) AS dj) AS f) AS q
  ON CAST(floor(x / 7500) AS BIGINT) = bx AND CAST(floor(y / 7500) AS BIGINT) = bz WHERE (x - px) * (x - px) + (y - py) * (y - py) <= 7500.0 * 7500.0)
SELECT candidate, {r('latitude')} AS latitude, {r('longitude')} AS longitude, country_code, CAST(NULL AS DATE) AS flood_start_date, 0 AS target
FROM i WHERE candidate NOT IN (SELECT candidate FROM near) ORDER BY candidate LIMIT (SELECT count(*) FROM p)
""")
def _(x):
    return rounded(negatives.negatives_spatial(_with_country(x), _countries(x), metres=7500.0))


@query("negatives_bbox", f"""
WITH {_TRIANGLES},
box AS (SELECT min(x0) AS xa, max(x0) + 25 AS xb, min(y0) AS ya, max(y0) + 15 AS yb FROM tri),
c AS (SELECT unnest(range(0, (SELECT count(*) * 8 + 1000 FROM fx_events))) AS candidate),
d AS (SELECT candidate, xa + {_UNIT.format(seed=K.SEED)} * (xb - xa) AS longitude, ya + {_UNIT.format(seed=K.SEED + 1)} * (yb - ya) AS latitude FROM c, box),
i AS (SELECT candidate, latitude, longitude, min(country_code) AS country_code FROM d JOIN tri ON {_INSIDE} GROUP BY 1, 2, 3)
SELECT candidate, {r('latitude')} AS latitude, {r('longitude')} AS longitude, country_code, CAST(NULL AS DATE) AS flood_start_date, 0 AS target
FROM i ORDER BY candidate LIMIT (SELECT CAST(floor(count(*) * 1.5E0) AS BIGINT) FROM fx_events)
""")
def _(x):
    return rounded(negatives.negatives_bbox(x.fx_events, _countries(x)))


# ---- sources and sinks ---------------------------------------------------------------------------

def _month_names():
    return F.date_format("flood_start_date", "yyyy_MM")


@query("read_events", "SELECT CAST(event_id AS VARCHAR) AS event_id, CAST(flood_start_date AS VARCHAR) AS flood_start_date, flood_type FROM fx_events")
def _(x):
    path = scratch_path(x.spark, "events")
    x.fx_events.select("event_id", "flood_start_date", "flood_type").write.option("header", True).csv(path)
    return event_files.read_events(x.spark, path)


@query("read_yearly_files", """
SELECT concat('enriched_events_', CAST(year(flood_start_date) AS VARCHAR), '.csv') AS file_name, true AS has_bytes, count(*) AS n FROM fx_events GROUP BY 1
""")
def _(x):
    path = scratch_path(x.spark, "yearly")
    named = x.fx_events.select("event_id", F.concat(F.lit("enriched_events_"), F.year("flood_start_date"), F.lit(".csv")).alias("name"))
    named.repartition("name").write.partitionBy("name").option("header", True).csv(path)
    # one file per name, as the exports have them
    fs_path = x.spark._jvm.org.apache.hadoop.fs.Path
    fs = fs_path(path).getFileSystem(x.spark._jsc.hadoopConfiguration())
    for part in fs.globStatus(fs_path(f"{path}/name=*/*.csv")):
        source = part.getPath()
        fs.rename(source, fs_path(f"{path}/{source.getParent().getName().removeprefix('name=')}"))
    names = event_files.list_inputs(x.spark, path)
    df = event_files.read_events(x.spark, path, name_glob="enriched_events_*.csv", with_file=True)
    counts = df.groupBy(F.col("source_file").alias("file_name")).agg(F.count(F.lit(1)).alias("n"))
    return names.join(counts, "file_name", "left").select("file_name", (F.col("bytes") > 0).alias("has_bytes"), "n")


@query("read_many", """
SELECT CAST(event_id AS VARCHAR) AS event_id, CASE WHEN event_id % 3 = 0 THEN flood_type END AS flood_type,
  CASE WHEN event_id % 3 = 1 THEN CAST(flood_duration_days AS VARCHAR) END AS flood_duration_days FROM fx_events
""")
def _(x):
    path = scratch_path(x.spark, "many")
    for i, extra in enumerate((["flood_type"], ["flood_duration_days"], [])):
        x.fx_events.where(F.col("event_id") % 3 == i).select("event_id", *extra).write.mode("append").option("header", True).csv(path)
    return event_files.read_many(x.spark, path)


_BY_MONTH = "SELECT year(flood_start_date) AS year, month(flood_start_date) AS month, count(*) AS n, sum(event_id) AS ids FROM fx_events GROUP BY 1, 2"


def _counted(df, *keys):
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("event_id").cast("long")).alias("ids"))


@query("write_monthly", _BY_MONTH.replace("sum(event_id)", "CAST(sum(event_id) AS BIGINT)"))
def _(x):
    path = scratch_path(x.spark, "monthly")
    sinks.write_monthly(x.fx_events, path, fmt="csv")
    return _counted(x.spark.read.option("header", True).csv(path).select("event_id", F.col("year").cast("int"), F.col("month").cast("int")), "year", "month")


@query("write_enriched", _BY_MONTH.replace("sum(event_id)", "CAST(sum(event_id) AS BIGINT)"))
def _(x):
    path = scratch_path(x.spark, "enriched")
    sinks.write_enriched(x.fx_events, path)
    sinks.write_enriched(x.fx_events.where(F.year("flood_start_date") == 1999), path)  # rewrites its own months only
    return _counted(x.spark.read.parquet(path), "year", "month")


@query("write_half_month", """
SELECT year(flood_start_date) AS year, month(flood_start_date) AS month, CASE WHEN day(flood_start_date) <= 15 THEN 1 ELSE 2 END AS part,
  count(*) AS n, CAST(sum(event_id) AS BIGINT) AS ids FROM fx_events GROUP BY 1, 2, 3
""")
def _(x):
    path = scratch_path(x.spark, "halves")
    sinks.write_half_month(x.fx_events, path)
    return _counted(x.spark.read.parquet(path), "year", "month", "part")


@query("feature_cache", "SELECT event_id, flood_start_date, true AS found, false AS other_found FROM fx_events")
def _(x):
    folder, key = scratch_path(x.spark, "store"), {"type": "training_events", "years": "1995"}
    feature_store.save_features(x.fx_events.select("event_id", "flood_start_date"), key, folder)
    found = feature_store.has_features(x.spark, key, folder)
    other = feature_store.has_features(x.spark, {**key, "years": "1996"}, folder)
    return feature_store.load_features(x.spark, key, folder).withColumns({"found": F.lit(found), "other_found": F.lit(other)})


@query("load_or_compute", "SELECT event_id, CASE WHEN event_id % 10 = 0 THEN 'second' ELSE 'first' END AS made FROM fx_events")
def _(x):
    folder, key, df = scratch_path(x.spark, "store"), {"type": "rows"}, x.fx_events.select("event_id")
    feature_store.load_or_compute(x.spark, key, df.where("event_id % 10 > 0"), lambda d: d.withColumn("made", F.lit("first")), folder, ["event_id"])
    return feature_store.load_or_compute(x.spark, key, df, lambda d: d.withColumn("made", F.lit("second")), folder, ["event_id"])


@query("read_grid", f"SELECT source, variable, count(*) AS n, {r('sum(value)', 3)} AS total FROM fx_obs GROUP BY source, variable")
def _(x):
    path = scratch_path(x.spark, "grid")
    grids.write_grid(x.fx_obs.drop("obs_id"), path)
    df = grids.read_grid(x.spark, path)
    return rounded(df.groupBy("source", "variable").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")), 3)


@query("parse_pixel_sample", f"SELECT event_id, {r('longitude', 4)} AS longitude, {r('latitude', 4)} AS latitude FROM fx_events")
def _(x):
    geo = F.format_string('{"type":"Point","coordinates":[%.2f,%.2f]}', "longitude", "latitude")
    raw = x.fx_events.select("event_id", geo.alias(".geo"), F.col("event_id").alias("system:index"))
    return rounded(event_files.parse_pixel_sample(raw), 4)


@query("flatten_properties", "SELECT event_id AS id, CAST(json_extract(props, '$.k') AS INT) AS k, event_type AS kind FROM events")
def _(x):
    nested = x.events.select(
        F.col("event_id").alias("id"),
        F.struct(F.from_json("props", "k INT")["k"].alias("k"), F.col("event_type").alias("kind")).alias("properties"),
    )
    return event_files.flatten_properties(nested)


@query("write_report_table", "SELECT flood_type, count(*) AS n FROM fx_events WHERE flood_type IS NOT NULL GROUP BY flood_type")
def _(x):
    path = scratch_path(x.spark, "report")
    sinks.write_report_table(rules.value_counts(x.fx_events, "flood_type"), path)
    return x.spark.read.json(path).select("flood_type", "n")


_LEDGER = "SELECT CAST(year AS VARCHAR) AS request, concat(CAST(month AS VARCHAR), '-', CAST(part AS VARCHAR)) AS chunk, status FROM fx_chunks"


@query("ledger_rollup", f"""
SELECT request, count(*) AS total_chunks, count(*) FILTER (status = 'completed') AS successful_chunks,
  coalesce(list(chunk ORDER BY chunk) FILTER (status <> 'completed'), []) AS failed_chunks,
  CASE WHEN count(*) = count(*) FILTER (status = 'completed') THEN 'completed' WHEN count(*) FILTER (status = 'completed') > 0 THEN 'partial' ELSE 'failed' END AS status
FROM ({_LEDGER}) AS l GROUP BY request
""")
def _(x):
    ledger = x.fx_chunks.select(
        F.col("year").cast("string").alias("request"), F.concat_ws("-", "month", "part").alias("chunk"), "status")
    return chunks.ledger_rollup(ledger)


# ---- incremental processing -------------------------------------------------------------------------

@query("pending_chunks", "SELECT year, month, part FROM fx_chunks WHERE status <> 'completed'")
def _(x):
    plan = x.fx_chunks.select("year", "month", "part")
    return chunks.pending_chunks(plan, x.fx_chunks.where("status = 'completed'"))


@query("complete_months", """
SELECT year, month, part FROM fx_chunks WHERE status = 'completed'
  AND (year, month) IN (SELECT (year, month) FROM fx_chunks WHERE status = 'completed' GROUP BY year, month HAVING count(DISTINCT part) = 2)
""")
def _(x):
    return chunks.complete_months(x.fx_chunks.where("status = 'completed'").select("year", "month", "part"))


@query("continue_from_month", """
SELECT event_id, flood_start_date FROM fx_events WHERE flood_start_date >= DATE '1995-09-01'
""")
def _(x):
    return chunks.continue_from(x.fx_events, 9).select("event_id", "flood_start_date")
