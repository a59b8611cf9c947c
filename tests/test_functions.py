from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from floodframe import constants as K
from floodframe.functions import dates, flood_types, geo, indices, risk
from floodframe.functions.numbers import clamp
from floodframe.operators import cleaning, rules


def one(df):
    return [tuple(r) for r in df.collect()]


@pytest.mark.parametrize("text,expected", [
    ("2020-01-04", date(2020, 1, 4)), ("04-01-2020", date(2020, 1, 4)), ("13/01/2020", date(2020, 1, 13)),
    ("01/13/2020", date(2020, 1, 13)), ("2020–01–04", date(2020, 1, 4)), ("2020-01-04 00:00:00", date(2020, 1, 4)),
    ("2020-01-04T05:06", date(2020, 1, 4)), ("43831", date(2020, 1, 1)), ("43831.7", date(2020, 1, 1)), ("", None), (None, None), ("31-02-2020", None),
    ("n/a", None), ("4.1.2020", date(2020, 1, 4)), ("20200104", date(2020, 1, 4)),
])
def test_parse_date(spark, text, expected):
    df = spark.createDataFrame([(text,)], "t string").select(dates.parse_date_robust(F.col("t")))
    assert one(df) == [(expected,)]


def test_pick_date_column():
    assert dates.pick_date_column(["date", "Start Date", "Flood Start Date"]) == "Flood Start Date"
    assert dates.pick_date_column(["event_date", "start_date"]) == "start_date"
    assert dates.pick_date_column(["event_date", "date"]) == "event_date"
    assert dates.pick_date_column(["x"]) is None


def test_detect_date_column(spark):
    df = spark.createDataFrame([("a", "2020-01-01", "2020-01-01"), ("b", "x", "02/01/2020")], "start string, begin_day string, date string")
    assert cleaning.detect_date_column(df) == "date"  # exactly half is not enough
    with pytest.raises(ValueError):
        cleaning.detect_date_column(df.select("start"))


@pytest.mark.parametrize("day,kept", [
    ("2024-03-18", True), ("2024-03-19", False), ("2024-03-21", False), ("2024-03-22", True), ("2024-11-26", True),
    ("2024-11-27", False), ("2024-11-29", True), ("2025-01-04", False), ("2025-01-05", True), (None, True),
])
def test_bad_periods(spark, day, kept):
    df = spark.createDataFrame([(day,)], "d string").select(F.col("d").cast("date").alias("flood_start_date"))
    assert (cleaning.filter_bad_periods(df).count() == 1) is kept


def test_bad_period_order():
    with pytest.raises(ValueError):
        cleaning.filter_bad_periods(None, [(date(2024, 1, 2), date(2024, 1, 1))])


def test_coordinates(spark):
    rows = [("90", "-180"), ("90.0001", "0"), ("x", "0"), (None, "0"), ("NaN", "0"), ("-90", "180")]
    df = cleaning.resolve_coords(spark.createDataFrame(rows, "Lat string, X string")).withColumn("flood_start_date", F.current_date())
    assert one(cleaning.filter_valid_events(df).select("latitude", "longitude")) == [(90.0, -180.0), (-90.0, 180.0)]


def test_calendar_without_date(spark):
    df = cleaning.with_calendar(spark.sql("SELECT CAST(NULL AS DATE) AS flood_start_date"))
    assert one(df.select("month", "day_of_year", "month_sin", "doy_cos")) == [(-1, -1, None, None)]


@pytest.mark.parametrize("text,strategy,features,forecast", [
    ("Flash flood", "nearest", 25000, 25000), ("Riverine flood", "mean_bbox", 50000, 20000), ("Flash/Riverine", "hybrid", 25000, 20000),
    ("Urban river", "hybrid", 25000, 20000), ("Coastal", "nearest", 50000, 25000), ("Snowmelt", "mean_bbox", 25000, 20000),
    (None, "nearest", 25000, 25000), ("Mixed", "hybrid", 25000, 25000), ("El Nino", "mean_bbox", 25000, 20000),
])
def test_flood_types(spark, text, strategy, features, forecast):
    t = F.lit(text).cast("string")
    df = spark.range(1).select(flood_types.spatial_strategy(t), flood_types.buffer_m(t), flood_types.buffer_m(t, "forecast"))
    assert one(df) == [(strategy, features, forecast)]


def test_haversine_and_wrap(spark):
    lit = lambda *v: [F.lit(float(x)) for x in v]
    row = spark.range(1).select(
        geo.haversine_km(*lit(0, 0, 0, 180)).alias("half"), geo.haversine_km(*lit(10, 179.9, 10, -179.9)).alias("seam"),
        geo.haversine_km(F.lit(None).cast("double"), *lit(0, 0, 0)).alias("none"),
        geo.wrap_lon(F.lit(359.5)).alias("w1"), geo.wrap_lon(F.lit(-0.5), "360").alias("w2"), geo.wrap_lon(F.lit(180.0)).alias("w3"),
    ).first()
    assert row.half == pytest.approx(20015.1, abs=0.1) and row.seam == pytest.approx(21.9, abs=0.1) and row.none is None
    assert (row.w1, row.w2, row.w3) == (-0.5, 359.5, -180.0)


def test_boxes_match_brute_force(spark):
    places = spark.sql("""SELECT id AS p, CASE WHEN id < 6 THEN 88.5 + id * 0.3 ELSE pmod(id * 37, 170) - 85 END AS latitude,
        CASE WHEN id % 3 = 0 THEN 179.9 WHEN id % 3 = 1 THEN -179.95 ELSE pmod(id * 71, 360) - 180 END AS longitude, 60000.0 AS m FROM range(40)""")
    cells = spark.sql("""SELECT a.id * 1000 + b.id AS cell_id, a.id * 0.5 - 90 AS cell_lat, b.id * 0.75 - 180 AS cell_lon
        FROM range(361) a CROSS JOIN range(480) b""")
    boxes = places.withColumns(geo.bbox(F.col("latitude"), F.col("longitude"), F.col("m")))
    got = {tuple(r) for r in geo.cells_in_boxes(boxes, cells, 0.5).select("p", "cell_id").collect()}
    every = boxes.join(F.broadcast(cells), geo.inside_box(F.col("cell_lat"), F.col("cell_lon")))
    assert got == {tuple(r) for r in every.select("p", "cell_id").collect()} and got


def test_clamp_keeps_null(spark):
    v = F.lit(None).cast("double")
    assert one(spark.range(1).select(clamp(v, 0.0, 1.0), clamp(F.lit(2.0), 0.0, 1.0), clamp(F.lit(-1.0), low=0.0))) == [(None, 1.0, 0.0)]


@pytest.mark.parametrize("value,repaired", [
    (-1e-11, 0.0), (-0.5, None), (0.0, 0.0), (None, None), (12.5, 12.5),
])
def test_repair_non_negative(spark, value, repaired):
    df = spark.createDataFrame([(value,)], "gee_imerg_sum_24h_mm double")
    assert one(rules.repair_features(df)) == [(repaired,)]


@pytest.mark.parametrize("value,repaired", [(1.005, 1.0), (1.02, None), (-1.005, -1.0), (1e-11, 0.0), (0.4, 0.4)])
def test_repair_bounded_and_idempotent(spark, value, repaired):
    df = spark.createDataFrame([(value,)], "gee_ndvi_mean_30d double")
    once = rules.repair_features(df)
    assert one(once) == [(repaired,)] and one(rules.repair_features(once)) == [(repaired,)]


def test_index_nulls(spark):
    df = spark.sql("SELECT 0D AS gee_imerg_sum_24h_mm, 1D AS gee_imerg_max_1h_intensity_mm, 0D AS gee_imerg_sum_7d_before_mm, 5D AS gee_merit_upa_mean")
    row = indices.engineer_features(df).first()
    assert row.gee_flashiness_index is None and row.gee_flashiness_index_7d is None and row.gee_api_weighted_mm is None
    assert row.gee_twi == pytest.approx(8.6995, abs=1e-3)  # absent slope counts as flat


@pytest.mark.parametrize("p,width,action", [(0.8, 0.2, "Immediate mitigation"), (0.8, 0.21, "Rapid verification"), (0.4, 0.7, "Investigate (uncertain)"), (0.39, 0.0, "Monitor")])
def test_actions(spark, p, width, action):
    assert one(spark.range(1).select(risk.action_trigger(F.lit(p), F.lit(width)))) == [(action,)]


def test_sparse_columns(spark):
    df = spark.sql("SELECT id, CAST(NULL AS DOUBLE) AS gone, 0D AS zero, CASE WHEN id = 1 THEN 1D END AS rare, CAST(id AS DOUBLE) AS kept, 0D AS x_reduction_method FROM range(100)")
    assert cleaning.drop_sparse_columns(df).columns == ["id", "kept", "x_reduction_method"]


def test_sampling_ignores_partitioning(spark):
    a = {r.id for r in cleaning.sample_rows(spark.range(1000), 50, "id", 1).collect()}
    b = {r.id for r in cleaning.sample_rows(spark.range(1000).repartition(7), 50, "id", 1).collect()}
    assert a == b and len(a) == 50 and a != {r.id for r in cleaning.sample_rows(spark.range(1000), 50, "id", 2).collect()}


def test_quality_future_date(spark):
    df = spark.sql("SELECT DATE'2030-01-01' AS flood_start_date, 95D AS latitude, 0D AS longitude, 'Dam' AS flood_type, 3D AS gee_imerg_max_1h_intensity_mm, -1D AS gee_imerg_x")
    row = rules.quality_flags(df, now=F.lit(datetime(2029, 12, 31)).cast("timestamp")).first()
    assert row.data_quality_issues == "future_event_date_2030-01-01|invalid_latitude_95.0" and not row.data_quality_valid
    assert "negative_precip_value_gee_imerg_x_-1.0" in row.data_quality_warnings


def test_constants_consistent():
    assert len(K.STATIC_FEATURES) == 17 and len(K.DYNAMIC_FEATURES) == 19 and len(K.FULL_FEATURES) == 36
