import math
from datetime import date, datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from floodframe import constants as K
from floodframe.operators import chunks, features, forecast, local, metrics, negatives, ranking, scoring, spacetime, terrain, train, zones
from floodframe.operators.cleaning import impute_median
from floodframe.sources import events as event_files, feature_store, grids, sinks
from floodframe.session import scratch_path
from floodframe.streaming.enrich import stream_enrich


def test_running_totals_with_skewed_values(spark):
    df = spark.sql("SELECT CASE WHEN id < 700 THEN 0.5 + id * 1e-9 ELSE id END AS v, id % 3 AS w FROM range(1000)")
    got = {r.v: (r.w_before, r.w_total) for r in ranking.running_totals(df, "v", ["w"]).collect()}
    total, want = 0, {}
    for v, w in sorted((r.v, r.w) for r in df.collect()):
        want[v] = (total, 999)
        total += w
    assert got == want


@pytest.mark.parametrize("values", [[3.0], [1.0, 2.0], [5.0] * 40 + [1.0, 9.0], list(range(101))])
def test_exact_quantiles(spark, values):
    df = spark.createDataFrame([(float(v),) for v in values] + [(None,), (float("nan"),)], "x double")
    row = ranking.exact_quantiles(df, ["x"], [0.0, 0.1, 1 / 3, 0.5, 1.0]).first()
    assert [row[f"q{i}"] for i in range(5)] == pytest.approx(list(np.quantile(values, [0, 0.1, 1 / 3, 0.5, 1])))


def test_impute_with_given_medians(spark):
    df = spark.createDataFrame([(None, 1.0), (2.0, None)], "a double, b double")
    stats = spark.createDataFrame([(7.0, 8.0)], "a double, b double")
    assert sorted(tuple(r) for r in impute_median(df, ["a", "b"], stats).collect()) == [(2.0, 8.0), (7.0, 1.0)]


def _obs(spark, rows):
    return spark.createDataFrame(
        [(c, 10.0, 20.0 + c * 0.1, t, v, "late", "rain") for c, t, v in rows],
        "cell_id long, latitude double, longitude double, ts timestamp_ntz, value double, source string, variable string")


def _event(spark, day=date(2024, 1, 10)):
    return spark.createDataFrame([(1, 10.0, 20.0, day, "Flash flood")], "event_id int, latitude double, longitude double, flood_start_date date, flood_type string")


def test_windows_are_half_open(spark):
    obs = _obs(spark, [(0, datetime(2024, 1, 10), 4.0), (0, datetime(2024, 1, 11), 100.0), (0, datetime(2024, 1, 9, 23, 59, 59), 1.0),
                       (0, datetime(2024, 1, 7), 2.0), (0, datetime(2024, 1, 6, 23, 59, 59), 8.0), (1, datetime(2024, 1, 10, 12), 6.0)])
    row = spacetime.rain_event_day(_event(spark), obs).first()
    assert row.gee_imerg_sum_24h_mm == 2.5 and row.gee_imerg_max_1h_intensity_mm == 5.0  # per cell, then mean
    row = spacetime.rain_antecedent(_event(spark), obs).first()
    assert row.gee_imerg_sum_3d_before_mm == 1.5 and row.gee_imerg_sum_7d_before_mm == 5.5
    assert spacetime.rain_max_daily(_event(spark), obs).first().gee_imerg_max_daily_7d_mm == 4.0


def test_windows_without_data(spark):
    obs = _obs(spark, [(0, datetime(2020, 1, 1), 4.0)])
    assert spacetime.rain_event_day(_event(spark), obs).first().gee_imerg_sum_24h_mm is None
    assert spacetime.daily_rain_features(_event(spark), obs).first().gee_chirps_precip_sum_30d_before == 0.0
    row = spacetime.rain_features(_event(spark), obs).first()
    assert (row.gee_imerg_sum_24h_mm, row.imerg_data_missing, row.imerg_extraction_failed, row.imerg_source) == (0.0, 1, 1, "late_final")
    old = spacetime.rain_features(_event(spark, date(1999, 1, 1)), obs).first()
    assert (old.imerg_source, old.imerg_data_missing, old.imerg_extraction_failed, old.imerg_coverage_note) == ("none", 1, None, "pre_imerg_era")


def test_peak_counts_absent_days_as_zero(spark):
    obs = _obs(spark, [(0, datetime(2024, 1, 8), -3.0)])
    assert spacetime.rain_max_daily(_event(spark), obs).first().gee_imerg_max_daily_7d_mm == 0.0


def test_hot_place_keeps_every_event(spark):
    events = spark.range(300).select("id", F.lit(10.0).alias("latitude"), F.lit(20.0).alias("longitude"),
                                     F.lit(date(2024, 1, 10)).alias("flood_start_date"), F.lit("Flash flood").alias("flood_type"))
    obs = _obs(spark, [(0, datetime(2024, 1, 10), 4.0)])
    assert spacetime.rain_event_day(events, obs).where("gee_imerg_sum_24h_mm = 2.0").count() == 300


def test_negatives_and_augmentation(spark):
    df = spark.createDataFrame([(1, date(1980, 1, 10), d, 1) for d in (None, 0, 2, 3, 4, 5, 8, 9, 12, 13)], "event_id long, flood_start_date date, flood_duration_days int, target int")
    assert negatives.augment_by_duration(df).count() == 10 + sum([0, 0, 0, 1, 1, 2, 2, 3, 3, 4])
    neg = negatives.negatives_time_offset(df)
    assert neg.count() == 10 * 3 and neg.agg(F.min("flood_start_date")).first()[0] >= K.EARLIEST_NEGATIVE


def test_exclusion_matches_brute_force(spark):
    rng = np.random.default_rng(1)
    crowd = 1.0 + rng.normal(0, 0.02, (800, 2))  # many positives in a few small squares
    pos, cand = np.r_[rng.uniform(-3, 3, (40, 2)), crowd], np.r_[rng.uniform(-3, 3, (400, 2)), 1.0 + rng.normal(0, 0.3, (400, 2))]
    p = spark.createDataFrame([tuple(map(float, r)) for r in pos] * 2 + [(None, 1.0)], "latitude double, longitude double")
    c = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(cand)] + [(-1, None, 1.0)], "id int, latitude double, longitude double")
    xy = lambda a: np.c_[K.MERCATOR_RADIUS_M * np.radians(a[:, 1]), K.MERCATOR_RADIUS_M * np.log(np.tan(np.pi / 4 + np.radians(a[:, 0]) / 2))]
    d = np.sqrt(((xy(cand)[:, None] - xy(pos)[None]) ** 2).sum(-1)).min(1)
    kept = {r.id for r in negatives.exclude_within(c, p, 40_000).collect()}
    assert kept == set(np.flatnonzero(d > 40_000)) | {-1}  # an unlocated row is near nothing


def _square(spark):
    corner = "array(struct(0D AS x, 0D AS y), struct(10D AS x, 0D AS y), struct(10D AS x, 10D AS y), struct(0D AS x, 10D AS y))"
    return spark.sql(f"SELECT 'AA' AS country_code, {corner} AS ring")


def test_spatial_negatives(spark):
    pos = spark.createDataFrame([("aa", 5.0, 5.0)] * 50, "country_code string, latitude double, longitude double")
    neg = negatives.negatives_spatial(pos, _square(spark), metres=100_000)
    rows = neg.collect()
    assert len(rows) == 50 and all(0 <= r.latitude <= 10 and 0 <= r.longitude <= 10 and r.flood_start_date is None for r in rows)
    assert negatives.exclude_within(neg, pos, 100_000).count() == 50
    assert {tuple(r) for r in rows} == {tuple(r) for r in negatives.negatives_spatial(pos, _square(spark), metres=100_000).collect()}
    assert negatives.negatives_bbox(pos, _square(spark)).count() == 75


def test_negatives_are_complete_or_refused(spark):
    pos = spark.createDataFrame([("aa", 5.0, 5.0)] * 30, "country_code string, latitude double, longitude double")
    sliver = spark.sql("SELECT 'AA' AS country_code, array(struct(0D AS x, 0D AS y), struct(10D AS x, 10D AS y), struct(10D AS x, 9.9D AS y)) AS ring")
    assert negatives.negatives_bbox(pos, sliver).count() == 45  # one candidate in two hundred lies inside
    with pytest.raises(ValueError, match="room for only 0 of 30"):
        negatives.negatives_spatial(pos, _square(spark), metres=3_000_000, give_up=2000)


def _scanned(df):
    """Files and rows read by each scan of a plan that has run, by table folder."""
    out = []

    def walk(node):
        name = node.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            return walk(node.executedPlan())
        if "QueryStageExec" in name:
            return walk(node.plan())
        if name == "FileSourceScanExec":
            out.append((node.metrics().apply("numFiles").value(), node.metrics().apply("numOutputRows").value()))
        for k in range(node.children().size()):
            walk(node.children().apply(k))

    df.collect()
    walk(df._jdf.queryExecution().executedPlan())
    return out


def test_windows_read_only_months_in_reach(spark, tmp_path):
    days = [(c, datetime(y, m, 9), float(m)) for c in range(3) for y in (2021, 2024) for m in range(1, 13)]
    obs = _obs(spark, days).unionByName(_obs(spark, days).withColumn("source", F.lit("other")))
    grids.write_grid(obs, str(tmp_path / "obs"))
    table = grids.read_grid(spark, str(tmp_path / "obs"))
    out = spacetime.rain_features(_event(spark), table)
    scans = _scanned(out)
    assert scans and all(files == 1 and rows == 3 for files, rows in scans)  # of 48 files: one month in reach, one source, three cells
    assert {tuple(r) for r in out.collect()} == {tuple(r) for r in spacetime.rain_features(_event(spark), _obs(spark, days)).collect()}


def test_windows_of_two_eras_read_no_month_between(spark, tmp_path):
    days = [(c, datetime(y, m, 9), float(m)) for c in range(3) for y in range(1990, 2021, 5) for m in (1, 6)]
    grids.write_grid(_obs(spark, days), str(tmp_path / "obs"))
    table = grids.read_grid(spark, str(tmp_path / "obs"))
    events = _event(spark, date(1990, 1, 10)).unionByName(_event(spark, date(2020, 6, 10)).withColumn("event_id", F.lit(2)))
    out = spacetime.rain_antecedent(events, table)
    scans = _scanned(out)
    assert scans and all(files == 2 for files, _ in scans)  # of 14
    assert {tuple(r) for r in out.collect()} == {tuple(r) for r in spacetime.rain_antecedent(events, _obs(spark, days)).collect()}


def test_forecasts_read_only_wanted_months_and_one_variable(spark, tmp_path):
    rows = [(c, 10.0 + c, 20.0, datetime(2024, m, 5), p, k, v, float(100 * m + c + k) if v == "dis24" else 0.0)
            for c in range(2) for m in range(1, 13) for p, k in (("cf", 0), ("pf", 1), ("pf", 2)) for v in ("dis24", "swe") for _ in range(2)]
    fc = spark.createDataFrame(rows, grids.GRID_SCHEMAS["forecast"])
    grids.write_grid(fc, str(tmp_path / "fc"))
    table = grids.read_grid(spark, str(tmp_path / "fc"), "forecast")
    event = _event(spark, date(2024, 6, 4))
    out = forecast.with_forecast(event, table)
    assert any(files == 1 for files, _ in _scanned(out))
    row = out.first()
    assert (row.glofas_forecast_control, row.glofas_forecast_mean, row.glofas_forecast_median) == (600.0, 601.5, 601.5)
    assert forecast.forecast_nearest(event, fc).first().glofas_forecast_control == 600.0


def test_quantile_brackets_are_checked(spark):
    values = [float(i // 3) for i in range(30_000)] + [1e9] * 5
    df = spark.createDataFrame([(v,) for v in values], "x double").repartition(4)
    row = ranking.exact_quantiles(df, ["x"], [0.0, 0.25, 0.5, 0.9999, 1.0]).first()
    assert [row[f"q{i}"] for i in range(5)] == pytest.approx(list(np.quantile(values, [0, 0.25, 0.5, 0.9999, 1])))


def test_scratch_scope_removes_what_it_made(spark, tmp_path):
    from floodframe import session

    with session.scratch(spark) as base:
        df = session.cut_lineage(spark, spark.range(5))
        assert df.count() == 5 and df.inputFiles()[0].split("://")[-1].count("/scope-") == 1
    path = spark._jvm.org.apache.hadoop.fs.Path(base)
    assert not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)


def test_isotonic_by_slices_is_the_minmax_of_means(spark, monkeypatch):
    from floodframe.operators import isotonic

    rng = np.random.default_rng(3)
    rows = [(float(s), int(rng.uniform() < 0.2 + 0.6 * s)) for s in rng.integers(0, 60, 3000) / 60]
    monkeypatch.setattr(isotonic, "FAN", 2)  # several rounds of merging
    model = isotonic.fit(spark.createDataFrame([*rows, (None, 1), (float("nan"), 0), (0.5, None)], "s double, y int"), "s", "y")
    scores = sorted({s for s, _ in rows})
    n, t = (np.array([f(y for s, y in rows if s == v) for v in scores], float) for f in (lambda g: sum(1 for _ in g), sum))
    for k, v in enumerate(scores):
        want = max(min(t[i:j + 1].sum() / n[i:j + 1].sum() for j in range(k, len(n))) for i in range(k + 1))
        assert np.interp(v, model.scores, model.values) == pytest.approx(want)
    probe = spark.createDataFrame([(-1.0,), (2.0,), (None,), (float("nan"),)], "s double")
    got = [r[0] for r in probe.select(isotonic.apply(model, F.col("s"))).collect()]
    assert got == [model.values[0], model.values[-1], None, None]
    empty = isotonic.fit(spark.createDataFrame([], "s double, y int"), "s", "y")
    assert [r[0] for r in probe.select(isotonic.apply(empty, F.col("s"))).collect()] == [None] * 4


def test_scopes_of_threads_do_not_mix_and_jobs_keep_their_order(spark):
    from floodframe import session

    def job(k):
        before = session.scratch_path(spark, "x")
        with session.scratch(spark) as own:
            inner = session.scratch_path(spark, "x")
        return k, before.rsplit("/", 1)[0], inner.startswith(own), spark.range(k).count()

    with session.scratch(spark) as base:
        out = session.side_by_side(spark, [lambda k=k: job(k) for k in range(6)], 3)
    assert out == [(k, base, True, k) for k in range(6)]
    with pytest.raises(ZeroDivisionError):
        session.side_by_side(spark, [lambda: 1 // 0, lambda: 1])


def test_a_machine_local_folder_is_refused_on_a_cluster(spark):
    from floodframe.session import check_shared

    check_shared("local[8]", "file:/tmp/w")
    check_shared("yarn", "hdfs://n/w")
    for folder in ("file:/tmp/w", "/tmp/w"):
        with pytest.raises(ValueError):
            check_shared("spark://host:7077", folder)


def test_nearest_on_axis(spark):
    axis = spark.createDataFrame([(-10.0,), (0.0,), (1.0,), (5.0,)], "v double")
    rng = np.random.default_rng(2).uniform(-30, 30, 200)
    values = spark.createDataFrame([(float(v),) for v in rng], "v double")
    grid = np.array([-10.0, 0, 1, 5])
    for r in forecast.nearest_on_axis(values, axis, "v", "n").collect():
        assert r.n == grid[np.abs(grid - r.v).argmin()]
    tie = spark.createDataFrame([(3.0,), (0.5,)], "v double")
    assert {r.n for r in forecast.nearest_on_axis(tie, axis, "v", "n").collect()} == {5.0, 1.0}
    assert {r.n for r in forecast.nearest_on_axis(tie, axis, "v", "n", "low").collect()} == {1.0, 0.0}
    single = spark.createDataFrame([(2.0,)], "v double")
    assert forecast.nearest_on_axis(tie, single, "v", "n").agg(F.min("n"), F.count("n")).first() == (2.0, 2)


def test_nearest_on_axis_with_a_hole_and_many_ranges(spark):
    hours = [float(h) for h in range(500)] + [float(h) for h in range(9000, 9500)]
    axis = spark.createDataFrame([(h,) for h in hours], "v double")
    wanted = [-3.0, 499.0, 500.0, 4749.4, 4749.5, 4749.6, 8999.9, 9700.0, float("nan"), None] + [float(v) + 0.25 for v in np.random.default_rng(4).integers(-50, 9600, 300)]
    out = forecast.nearest_on_axis(spark.createDataFrame([(v,) for v in wanted], "v double"), axis, "v", "n")
    assert "explode" not in out._jdf.queryExecution().toString()
    for r in out.collect():
        if r.v is None or np.isnan(r.v):
            assert r.n is None
        else:
            gap = np.abs(np.array(hours) - r.v)
            assert r.n == np.array(hours)[gap == gap.min()].max()
    assert out.count() == len(wanted)
    assert forecast.nearest_on_axis(axis, axis.limit(0), "v", "n").agg(F.count("n")).first()[0] == 0


def _fc(spark, rows):
    return spark.createDataFrame([(1, 10.0, 20.0, datetime(2024, 1, 10), p, m, "dis24", v) for p, m, v in rows],
                                 "cell_id long, latitude double, longitude double, ts timestamp_ntz, product string, member int, variable string, value double")


@pytest.mark.parametrize("members,mean", [([("cf", 0, 9.0)], None), ([("pf", 0, 9.0), ("pf", 1, 2.0)], 2.0), ([("pf", 1, None)], None),
                                          ([("pf", i, float(i)) for i in range(1, 5)], 2.5)])
def test_ensembles(spark, members, mean):
    fc = _fc(spark, members)
    if members == [("cf", 0, 9.0)]:
        fc = fc.unionByName(_fc(spark, [("pf", 0, 1.0)]))
    row = forecast.with_forecast(_event(spark), fc).first()
    assert row.glofas_forecast_mean == mean
    if mean == 2.5:
        assert row.glofas_forecast_10th_percentile == pytest.approx(1.3) and row.glofas_forecast_std_dev == pytest.approx(np.std([1, 2, 3, 4]))


def test_distance_transform_brute_force(spark):
    rng = np.random.default_rng(3)
    grid = rng.random((17, 23)) < 0.03
    rows = [(int(i), int(j), bool(grid[i, j])) for i in range(17) for j in range(23) if (i + j) % 7]
    df = spark.createDataFrame(rows, "grid_row int, grid_col int, wet boolean")
    targets = np.array([(i, j) for i, j, w in rows if w])
    for r in terrain.distance_to_nearest(df, "wet").collect():
        assert r.distance == pytest.approx(np.sqrt(((targets - (r.grid_row, r.grid_col)) ** 2).sum(1)).min())
    assert terrain.distance_to_nearest(df.withColumn("wet", F.lit(False)), "wet").where("distance IS NOT NULL").isEmpty()


def test_focal_statistics_with_gaps(spark):
    rng = np.random.default_rng(5)
    rows = [(int(i), int(j), float(rng.random())) for i in range(9) for j in range(11) if rng.random() < 0.6]
    df = spark.createDataFrame(rows, "grid_row int, grid_col int, v double")
    out = terrain.focal_mean(terrain.focal_min(df, 1, "v", "low"), 2, "v", "mean").collect()
    assert len(out) == len(rows)
    for r in out:
        near = lambda k: [v for i, j, v in rows if (i - r.grid_row) ** 2 + (j - r.grid_col) ** 2 <= k * k]
        assert r.low == min(near(1)) and r["mean"] == pytest.approx(np.mean(near(2)))


def test_terrain_plane(spark):
    df = spark.sql("SELECT a.id AS grid_row, b.id AS grid_col, CAST(b.id * 30 AS DOUBLE) AS elevation FROM range(5) a CROSS JOIN range(5) b")
    row = terrain.terrain_features(df).where("grid_row = 2 AND grid_col = 2").first()
    assert row.slope == pytest.approx(45.0) and row.aspect == pytest.approx(270.0)  # rises to the east, faces west
    flat = terrain.curvature(df, "elevation", 30.0).where("grid_row = 2 AND grid_col = 2").first()
    assert flat.curvature == pytest.approx(0.0) and flat.curvature_laplacian == pytest.approx(0.0)


def test_metrics_edges(spark):
    constant = spark.createDataFrame([(1, 0.3), (0, 0.3), (0, 0.3)], "y int, p double")
    row = metrics.full_metrics(constant, "y", "p", 0.5).first()
    assert row.roc_auc == 0.5 and row.pr_auc == pytest.approx(1 / 3) and row.precision == 0 and row.mcc == 0 and row.fbeta_2_0 == 0
    single = metrics.full_metrics(constant.where("y = 0"), "y", "p", 0.2).first()
    assert single.roc_auc is None and single.fp == 2 and single.balanced_accuracy == 0.0


def test_threshold_bin_agrees_with_comparison(spark):
    values = [i / 100 for i in range(101)] + list(np.random.default_rng(4).random(300)) + [np.nextafter(0.3, 0), np.nextafter(0.3, 1)]
    df = spark.createDataFrame([(float(v),) for v in values], "p double").withColumn("b", metrics.threshold_bin(F.col("p")))
    for r in df.collect():
        assert r.b == sum(r.p >= t / 100 for t in range(10, 91))


def test_weight_grid():
    grid = metrics.weight_grid()
    assert len(grid) == 171 and all(math.isclose(sum(w), 1) and min(w) > 0.0499 and max(w) < 0.901 for w in grid)


def test_blend_stays_between_inputs(spark):
    df = spark.sql("SELECT rand(1) AS a, rand(2) AS b, rand(3) AS c FROM range(200)")
    out = metrics.blend(df, ["a", "b", "c"], (0.45, 0.05, 0.5), 0.5)
    assert out.where("blended < least(a, b, c) - 1e-12 OR blended > greatest(a, b, c) + 1e-12").isEmpty()


def test_folds_and_split_are_stratified(spark):
    df = spark.range(1000).withColumn("y", (F.col("id") % 10 == 0).cast("int"))
    counts = features.assign_folds(df, "y", "id", 5).groupBy("y", "fold").count().collect()
    assert {(r.y, r["count"]) for r in counts} == {(0, 180), (1, 20)} and len(counts) == 10
    held = features.stratified_split(df, "y", "id", 0.2).where("is_holdout").groupBy("y").count()
    assert {tuple(r) for r in held.collect()} == {(0, 180), (1, 20)}


def test_priority_defaults(spark):
    one = spark.createDataFrame([(0.9, 0.15)], "Final_Risk_Score double, Uncertainty double")
    assert scoring.operational_priority(one).first().Operational_Priority == "High risk (uncertain)"
    equal = spark.createDataFrame([(0.9, 0.3), (0.1, 0.3)], "Final_Risk_Score double, Uncertainty double")
    assert {r.Operational_Priority for r in scoring.operational_priority(equal).collect()} == {"High risk (uncertain)", "Investigate (uncertain)"}


def test_components_chain(spark):
    edges = spark.range(60).selectExpr("id AS src", "id + 1 AS dst").union(spark.range(60).selectExpr("id + 1 AS src", "id AS dst"))
    vertices = spark.range(64).selectExpr("id AS v")
    labels = {r.v: r.label for r in zones.connected_components(edges, vertices).collect()}
    assert labels == {**{i: 0 for i in range(61)}, 61: 61, 62: 62, 63: 63}


def noise_of(spark):
    return spark.sql("SELECT CAST(id AS DOUBLE) AS latitude, CAST(id % 7 AS DOUBLE) AS longitude, rand(5) AS Final_Risk_Score FROM range(30)")


def test_zones_small_and_noise(spark):
    few = spark.createDataFrame([(0.0, 0.0, 0.1)] * 3, "latitude double, longitude double, Final_Risk_Score double")
    assert {r.Risk_Zone for r in zones.risk_zones(few).collect()} == {"Uncategorized"}  # noise like any other
    assert zones.spatial_clusters(noise_of(spark), method="kmeans", k=3).select("spatial_cluster").distinct().count() == 3
    noise = spark.sql("SELECT CAST(id AS DOUBLE) AS latitude, CAST(id % 7 AS DOUBLE) AS longitude, rand(5) AS Final_Risk_Score FROM range(30)")
    assert {r.Risk_Zone for r in zones.risk_zones(noise, min_samples=20).collect()} == {"Uncategorized"}
    assert zones.spatial_clusters(noise, min_samples=20).agg(F.min("spatial_cluster")).first()[0] == 0


def test_local_samples_near_pole_and_seam(spark):
    rng = np.random.default_rng(6)
    pts = [(i, float(a), float(b), date(2020, 1, 1)) for i, (a, b) in enumerate(np.c_[np.r_[rng.uniform(80, 90, 150), rng.uniform(-5, 5, 150)], np.r_[rng.uniform(-180, 180, 150), rng.uniform(170, 190, 150)]])]
    events = spark.createDataFrame([(i, a, (b + 180) % 360 - 180, d) for i, a, b, d in pts], "event_id int, latitude double, longitude double, flood_start_date date")
    targets = spark.createDataFrame([(1, 89.5, 10.0), (2, 0.0, 179.8), (3, 86.0, -179.0)], "target_id int, latitude double, longitude double")
    got = {(r.target_id, r.event_id) for r in local.local_samples(targets, events, F.lit(date(2021, 1, 1))).collect()}
    from floodframe.functions.geo import haversine_km
    e = events.select("event_id", F.col("latitude").alias("a"), F.col("longitude").alias("b"))
    every = targets.join(F.broadcast(e), haversine_km(F.col("latitude"), F.col("longitude"), F.col("a"), F.col("b")) <= 500)
    assert got == {(r.target_id, r.event_id) for r in every.collect()} and len(got) > 50


def test_combine_absent_sides(spark):
    df = spark.createDataFrame([(None, None, 0), (0.7, None, 0), (None, 0.2, 500)], "global_proba double, local_proba double, n_local long").withColumn("avg_dist_km", F.lit(10.0))
    rows = local.combine_local_global(local.blend_weights(df)).orderBy("n_local", "final_proba").collect()
    assert [r.final_proba for r in rows] == [None, 0.7, 0.2] and rows[0].confidence == 0 and rows[0].final_label is None


def test_continue_from(spark):
    df = spark.createDataFrame([(date(2019, 12, 5),), (date(2020, 1, 5),), (date(2020, 3, 5),), (date(2021, 1, 1),), (None,)], "flood_start_date date")
    assert chunks.continue_from(df, 3).count() == 2 and chunks.continue_from(df, 1).count() == 4
    assert chunks.continue_from(df, 7).count() == 1  # no July anywhere: 2020 is the year, July the start


def test_read_many_and_cache(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id,x\n1,2\n")
    (tmp_path / "b.csv").write_text("id,y\n2,3\n")
    (tmp_path / "c.csv").write_text("id,x\n4,5\n")
    rows = {tuple(r) for r in event_files.read_many(spark, str(tmp_path)).select("id", "x", "y").collect()}
    assert rows == {("1", "2", None), ("2", None, "3"), ("4", "5", None)}
    assert [r.file_name for r in event_files.list_inputs(spark, str(tmp_path), "[ab].csv").collect()] == ["a.csv", "b.csv"]
    key = {"b": 1, "a": 2}
    assert feature_store.feature_key(key) == feature_store.feature_key({"a": 2, "b": 1}) and len(feature_store.feature_key(key)) == 16
    assert feature_store.load_features(spark, key, str(tmp_path)) is None
    calls = []
    make = lambda d: calls.append(1) or d
    for n, rows in ((10, 10), (11, 11), (5, 5), (20, 20)):
        assert feature_store.load_or_compute(spark, key, spark.range(n), make, str(tmp_path), ["id"]).count() == rows
    assert len(calls) == 3  # all, one and nine more; nothing for the five known ones


def test_stream_resumes(spark, tmp_path):
    src, out, cp = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "cp")
    frame = lambda n: spark.createDataFrame([(n, date(2024, 1, n))], "event_id int, flood_start_date date")
    run = lambda: stream_enrich(spark, src, out, cp, "event_id int, flood_start_date date", lambda d: d.withColumn("x", F.lit(1))).awaitTermination()
    frame(3).write.mode("append").parquet(src)
    run()
    run()
    frame(20).write.mode("append").parquet(src)
    run()
    assert sorted((r.event_id, r.part, r.x) for r in spark.read.parquet(out).collect()) == [(3, 1, 1), (20, 2, 1)]


def test_param_grid():
    options = {"a": [1, 2, 3], "b": ["x", "y"], "c": [0.1, 0.2]}
    assert len(train.sample_param_grid(options, 20)) == 12
    some = train.sample_param_grid(options, 5, 1)
    assert len({tuple(s.items()) for s in some}) == 5 and some == train.sample_param_grid(options, 5, 1)


def test_calibration_is_monotone(spark):
    df = spark.sql("SELECT id, rand(7) AS s, CAST(rand(8) < rand(7) AS INT) AS y FROM range(2000)")
    out = train.calibrate(df, train.fit_calibrator(df, "s", "y"), "s", "c").orderBy("s").collect()
    assert all(a.c <= b.c + 1e-12 for a, b in zip(out, out[1:])) and 0 < out[0].c and out[-1].c < 1


def test_local_expert_needs_both_classes(spark):
    df = spark.range(40).selectExpr("id", "CAST(id AS DOUBLE) AS x", "1 AS y")
    assert train.local_expert(df, ["x"], "id", "y", "linear")[2]["reason"] == "too_few_samples"


def test_monthly_rewrite_is_idempotent(spark, tmp_path):
    path = str(tmp_path / "m")
    df = spark.createDataFrame([(1, date(2024, 1, 3)), (2, date(2024, 2, 3)), (3, None)], "event_id int, flood_start_date date")
    for _ in range(2):
        sinks.write_monthly(df, path)
    sinks.write_monthly(df.where("event_id = 2"), path)
    assert spark.read.parquet(path).count() == 2


@pytest.fixture
def written(monkeypatch):
    """Columns of each table a training step writes."""
    tables, write = [], train.cut_lineage
    monkeypatch.setattr(train, "cut_lineage", lambda spark, df: tables.append(df.columns) or write(spark, df))
    return tables


def _learnable(spark, n=240):
    rows = spark.range(n).select(F.col("id").cast("string").alias("k"), (F.col("id") % 17).cast("double").alias("a"), (F.col("id") % 5).cast("double").alias("b"))
    return rows.withColumn("label", ((F.col("a") + F.col("b")) > 9).cast("int"))


def test_rotations_write_the_rows_once_for_all_fits(spark, written):
    lists = {"static": ["a"], "dynamic": ["b"], "full": ["a", "b"]}
    small = {"boosted": {"maxIter": 1, "maxDepth": 2}, "forest": {"numTrees": 2, "maxDepth": 2}, "linear": {"maxIter": 3}}
    df = _learnable(spark)
    out = train.rotate_roles(df.unionByName(df.where("k = '7'")), lists, "k", k=2, params=small).collect()
    assert sorted(r.cycle for r in out) == [1, 2, 3]
    # the repeated key meets itself in the join of three scores
    assert {r.tp + r.fn + r.fp + r.tn for r in out} == {240 - 1 + 8}
    assert sum({"a", "b"} <= set(columns) for columns in written) == 1


def test_trials_write_the_rows_once(spark, written):
    df = features.assign_folds(_learnable(spark), "label", "k", 2)
    assert train.tune(df, "linear", ["a", "b"], [{"maxIter": 2}, {"maxIter": 3}]).count() == 4
    assert sum("a" in columns for columns in written) == 1


def _points(spark, n, seed=3):
    """``n`` places with an id, a date and a flood type, spread over two degrees."""
    rng = np.random.default_rng(seed)
    rows = [(i, float(a), float(b), date(2020, 1, 1 + i % 28), "Flash flood") for i, (a, b) in enumerate(rng.uniform(10, 12, (n, 2)))]
    return spark.createDataFrame(rows, "event_id long, latitude double, longitude double, flood_start_date date, flood_type string")


def test_near_samples_are_compared_in_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(local, "_BUCKETS_AT_ONCE", 20, raising=False)
    targets = _points(spark, 200).select((F.col("event_id") + 0).alias("target_id"), "latitude", (F.col("longitude") * 9).alias("longitude"))
    held = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        pairs = local.local_samples(targets, _points(spark, 50), F.lit(date(2021, 1, 1)), 100.0)
        assert pairs.rdd.getNumPartitions() > 8
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", held)


def test_local_samples_query_with_repeated_ids(spark, tmp_path):
    spark.createDataFrame([(1,), (1,), (2,)], "s_suppkey long").write.parquet(str(tmp_path / "supplier.parquet"))
    orders = [(k, c, date(2005, 1, 1) if k % 2 else date(1970, 1, 1)) for k, c in ((1, 1), (1, 1), (2, 1), (3, 1), (4, 2), (5, 7))]
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long, o_orderdate date").write.parquet(str(tmp_path / "orders.parquet"))
    from floodframe.queries import registry  # noqa: F401
    from floodframe.queries.base import QUERIES

    rows = QUERIES["local_samples"](spark, str(tmp_path)).collect()
    assert rows and all(r.is_recent == (r.event_id % 2 == 1) for r in rows)
    # too few recent events anywhere, so each target takes all of its radius; pairs of repeated ids meet each other as they did
    assert all(r.in_recent_choice for r in rows)
    assert all(sum(1 for s in rows if (s.target_id, s.event_id) == (r.target_id, r.event_id)) in (1, 4, 16) for r in rows)


def test_exclusion_reads_its_candidates_once(spark):
    seen = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def drawn(v):
        seen.add(1)
        return v

    places = _points(spark, 100)
    candidates = places.withColumn("latitude", drawn("latitude"))
    far = negatives.exclude_within(candidates, places.where("event_id < 10").select("latitude", "longitude"), 20_000).collect()
    assert seen.value == 100 and 0 < len(far) < 90


def test_zonal_boxes_are_dealt_over_tasks_by_their_number(spark, monkeypatch):
    from floodframe.operators import zonal

    monkeypatch.setattr(zonal, "_PLACES_AT_ONCE", 50, raising=False)
    assert zonal._boxes(_points(spark, 500), None, 0.05).rdd.getNumPartitions() == 10


def test_clear_sky_medians_move_no_image_per_event(spark):
    rng = np.random.default_rng(5)
    images = [(c, 11.0 + c / 10, 11.0, datetime(2019, 12, 1) + timedelta(hours=int(h)), 4, 1, None if h % 9 == 0 else float(r), float(n), float(g))
              for c in range(3) for h, r, n, g in zip(rng.integers(0, 1500, 60), *rng.uniform(100, 9000, (3, 60)))]
    grid = spark.createDataFrame(images, "cell_id long, latitude double, longitude double, ts timestamp, scene_class int, cloud_pct int, B4 double, B8 double, B3 double")
    out = spacetime.clear_sky_index_features(_points(spark, 40), grid, buffer=1e6)
    assert "median(" not in out._jdf.queryExecution().optimizedPlan().toString()
    for r in out.collect():
        first = datetime(r.flood_start_date.year, r.flood_start_date.month, r.flood_start_date.day) - timedelta(days=30)
        values = []
        for c in range(3):
            held = [i for i in images if i[0] == c and first <= i[3] < first + timedelta(days=30)]
            red, nir = np.median([i[6] for i in held if i[6] is not None]), np.median([i[7] for i in held])
            values.append((nir - red) / (nir + red))
        assert r.NDVI == pytest.approx(np.mean(values))


def test_zonal_boxes_stay_where_they_are_and_only_few_cells_travel(spark, monkeypatch):
    from floodframe.operators import zonal

    far = [(9_000 + i, "elevation", 60.0 + i / 100, 0.0, 1.0) for i in range(300)]
    cells = [(100 * i + j, "elevation", i / 100, j / 100, float(i * j % 23)) for i in range(-30, 31) for j in range(-30, 31)]
    static = spark.createDataFrame(cells + far, "cell_id long, variable string, latitude double, longitude double, value double")
    points = spark.createDataFrame([(i, i / 50, -i / 70, "Snowmelt") for i in range(12)], "event_id long, latitude double, longitude double, flood_type string")
    mean = lambda: zonal.zonal_mean(points, static, ["elevation"]).select("event_id", F.round("gee_elevation_mean", 9))
    few = mean()
    plan = few._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("rightHint=(strategy=broadcast)") == 4 and "leftHint" not in plan  # the boxes are on the left
    assert zonal._cells_near(zonal._boxes(points, None, 0.05), zonal._cells(static, 0.05)).count() <= len(cells)
    got = sorted(map(tuple, few.collect()))
    monkeypatch.setattr(zonal, "_CELLS_EVERYWHERE", 0)
    many = mean()
    plan = many._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("rightHint=(strategy=merge)") == 4 and sorted(map(tuple, many.collect())) == got
    for i, value in got:
        half = 25_000 / 110_540, 25_000 / (111_320 * math.cos(math.radians(i / 50)))
        inside = [v for *_, lat, lon, v in cells if abs(lat - i / 50) <= half[0] and abs(lon + i / 70) <= half[1]]
        assert value == pytest.approx(sum(inside) / len(inside))


def test_weight_sweep_multiplies_no_rows_and_counts_as_one_by_one(spark):
    rng = np.random.default_rng(7)
    rows = [(int(rng.integers(0, 2)), *[float(v) for v in rng.choice([0.0, 0.1, 0.35, 0.5, 0.9, 1.0, *rng.uniform(0, 1, 4)], 3)]) for _ in range(120)]
    rows += [(1, None, 0.5, 0.5), (0, 0.2, 0.2, None), (None, 0.1, 0.4, 0.2), (0, -1.0, 2.0, -3.0)]
    df = spark.createDataFrame(rows, "y int, p_a double, p_b double, p_c double")
    found = metrics.search_weights(df, "y", ["p_a", "p_b", "p_c"])
    assert "inline" not in found._jdf.queryExecution().optimizedPlan().toString().split("Union")[0]
    out = {(round(r.weight_static, 9), round(r.weight_dynamic, 9), round(r.threshold, 9)): r for r in found.collect()}
    assert len(out) == 171 * 81
    for weights in metrics.weight_grid()[::17]:
        at = df.select("y", metrics.blended(["p_a", "p_b", "p_c"], weights).alias("p"))
        q = metrics.clip_probability(F.col("p"))
        whole = at.agg(F.count("y").alias("n"), F.sum(F.when(F.col("y") == 1, (1 - q) * (1 - q)).when(F.col("y") == 0, q * q)).alias("s")).first()
        for threshold in (0.1, 0.11, 0.35, 0.5, 0.9):
            high = F.coalesce(F.col("p") >= threshold, F.lit(False))
            want = at.agg(F.count_if(high & (F.col("y") == 1)).alias("tp"), F.count_if(high & (F.col("y") == 0)).alias("fp"),
                          F.count_if(~high & (F.col("y") == 1)).alias("fn"), F.count_if(~high & (F.col("y") == 0)).alias("tn")).first()
            r = out[round(weights[0], 9), round(weights[1], 9), threshold]
            assert (r.tp, r.fp, r.fn, r.tn) == tuple(want) and r.brier == pytest.approx(whole.s / whole.n)
