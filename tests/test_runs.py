"""Whole runs: chunks through the ledger, many experts at once."""

from datetime import date, datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from floodframe.operators import experts
from floodframe.plans import forecast_chunks, local_prediction
from floodframe.sources import commit_log


def _events(spark, days):
    return spark.createDataFrame([(i, 10.0, 20.0, "Flash flood", d) for i, d in enumerate(days)],
                                 "event_id long, latitude double, longitude double, flood_type string, start_date string")


def _forecast(spark):
    return spark.createDataFrame([(1, 10.0, 20.0, datetime(2024, 1, d), p, m, "dis24", float(d + m)) for d in (1, 20) for p, m in (("cf", 0), ("pf", 1), ("pf", 2))],
                                 "cell_id long, latitude double, longitude double, ts timestamp, product string, member int, variable string, value double")


def test_chunk_run_survives_a_kill_between_staging_and_commit(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "out")
    raw = _events(spark, ["2019-03-02", "2019-03-20", "2024-01-03", "2024-01-25", "2024-02-02", None, "n/a", "2025-01-02"])
    assert forecast_chunks.monthly_table(spark, path) is None
    commit, calls = commit_log.commit, []

    def killed(*args):
        calls.append(args)
        if len(calls) == 2:
            raise KeyboardInterrupt
        commit(*args)

    monkeypatch.setattr(commit_log, "commit", killed)
    with pytest.raises(KeyboardInterrupt):
        forecast_chunks.run_chunks(raw, _forecast(spark), path)
    assert {r["year"] for r in commit_log.ledger(spark, path).collect()} == {2019}
    assert sorted(r["event_id"] for r in commit_log.committed_rows(spark, path).collect()) == [0, 1]
    monkeypatch.setattr(commit_log, "commit", commit)
    assert forecast_chunks.run_chunks(raw, _forecast(spark), path) == 1
    assert forecast_chunks.run_chunks(raw, _forecast(spark), path) == 0
    rows = commit_log.committed_rows(spark, path).collect()
    assert sorted(r["event_id"] for r in rows) == [0, 1, 2, 3, 4]
    assert {r["event_id"]: r["glofas_forecast_control"] for r in rows} == {0: None, 1: None, 2: 1.0, 3: 20.0, 4: 20.0}
    whole = forecast_chunks.monthly_table(spark, path).collect()
    assert sorted(r["event_id"] for r in whole) == [0, 1, 2, 3]  # February 2024 has one half only
    assert sum(r["n_rows"] for r in commit_log.ledger(spark, path).collect()) == 5


def test_two_runs_that_commit_one_chunk_make_no_doubles(spark, tmp_path):
    path = str(tmp_path / "out")
    df = spark.createDataFrame([(1, 2020, 5, 1), (2, 2020, 5, 1)], "event_id long, year int, month int, part int")
    runs = [commit_log.write_staged(df, path) for _ in range(2)]
    for run in runs:
        commit_log.commit(spark, path, run)
    assert sorted(r["event_id"] for r in commit_log.committed_rows(spark, path).collect()) == [1, 2]


def _newton(x, y, ridge=1.0):
    x = np.column_stack([np.ones(len(x)), (x - x.mean(0)) / x.std(0)])
    beta, penalty = np.zeros(x.shape[1]), np.diag([1e-9, *[ridge] * (x.shape[1] - 1)])
    for _ in range(50):
        p = 1 / (1 + np.exp(-x @ beta))
        beta += np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + penalty, x.T @ (y - p) - np.diag(penalty) * beta)
    return beta


def test_experts_equal_single_fits(spark):
    rng = np.random.default_rng(1)
    rows, want = [], {}
    for g, n in ((1, 200), (2, 75), (3, 29), (4, 40)):
        x = rng.normal(size=(n, 2)) * [3, 0.1] + [5, -2]
        y = (rng.uniform(size=n) < 1 / (1 + np.exp(-(x[:, 0] - 5) * (g - 1.5)))).astype(int) if g != 4 else np.ones(n, int)
        rows += [(g, g * 1000 + i, int(y[i]), float(x[i, 0]), float(x[i, 1])) for i in range(n)]
        want[g] = _newton(x, y) if g < 3 else None
    df = spark.createDataFrame(rows + [(1, 9, None, 1.0, 1.0)], "g int, key long, y int, a double, b double")
    out = {r["g"]: r for r in experts.fit_experts(df, "g", "key", ["a", "b"], "y").collect()}
    assert set(out) == {1, 2}  # too few rows, one class
    for g, r in out.items():
        assert r["beta"] == pytest.approx(want[g], abs=1e-6) and r["slope"] < 1e-6
        assert 0 < r["oof_rmse"] < 0.6 and 0 < r["oof_var"] < 0.25 and r["oof_logloss"] > 0
        assert r["cal_y"] == sorted(r["cal_y"]) and r["cal_x"] == sorted(r["cal_x"])


def test_isotonic_is_the_minmax_of_means(spark):
    rng = np.random.default_rng(2)
    for n in (1, 2, 7, 40):
        w = rng.integers(1, 5, n).astype(float)
        s = np.array([rng.integers(0, k + 1) for k in w.astype(int)], float)
        _, got = experts.isotonic(np.arange(n), s, w)
        want = [max(min(s[i:j + 1].sum() / w[i:j + 1].sum() for j in range(k, n)) for i in range(k + 1)) for k in range(n)]
        assert got == pytest.approx(want)


def test_locations_without_expert_take_the_global_probability(spark):
    events = spark.createDataFrame([(i, 0.1 * (i % 7), 0.1 * (i % 5), date(2008, 1, 1), int(i % 7 > 3), float(i % 7)) for i in range(80)],
                                   "event_id long, latitude double, longitude double, flood_start_date date, label int, f double")
    targets = spark.createDataFrame([(1, 0.0, 0.0, 0.2, 6.0), (2, 60.0, 60.0, 0.3, 6.0), (3, 0.0, 0.2, None, None), (4, None, None, 0.9, 1.0)],
                                    "target_id long, latitude double, longitude double, global_proba double, f double")
    out = {r["target_id"]: r for r in local_prediction.predict_locations(targets, events, F.lit("2009-01-01").cast("date"), ["f"], "label", min_samples=50).collect()}
    assert out[1]["n_local"] == 80 and out[1]["local_proba"] > 0.9 and 0.2 < out[1]["final_proba"] < 1 and out[1]["final_label"] in (0, 1)
    assert out[2]["n_local"] == 0 and out[2]["local_proba"] is None and out[2]["final_proba"] == 0.3 and out[2]["avg_dist_km"] == 500.0
    assert out[3]["final_proba"] == out[3]["local_proba"] is not None
    assert out[4]["final_proba"] == 0.9


def test_small_groups_are_fitted_without_a_job_per_step_and_as_large_ones_are(spark, monkeypatch):
    rng = np.random.default_rng(3)
    rows = []
    for g, n in ((1, 150), (2, 64), (3, 31)):
        a, b = rng.normal(size=n) + 3, rng.integers(0, 9, n).astype(float)
        y = (rng.uniform(size=n) < 1 / (1 + np.exp(3 - a))).astype(int)
        rows += [(g, g * 1000 + i, int(y[i]), [float(a[i]), None, float("nan")][i % 13 == 0 if i % 2 else 2 * (i % 17 == 0)], float(b[i]), 7) for i in range(n)]
    rows += [(1, None, 1, 2.0, 4.0, 7), (None, 5, 0, 1.0, 1.0, 7), (4, 6, 1, 1.0, 1.0, 7), (4, 6, 0, 2.0, 1.0, 7)]
    df = spark.createDataFrame(rows, "g int, key long, y int, a double, b double, c int")
    context = spark.sparkContext
    fit = lambda: {r["g"]: r.asDict() for r in experts.fit_experts(df, "g", "key", ["a", "b", "c"], "y", min_rows=2).collect()}
    context.setJobGroup("small groups", "")
    try:
        small = fit()
        jobs = len(context.statusTracker().getJobIdsForGroup("small groups"))
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
    assert jobs < 16  # eight steps are not eight passes
    monkeypatch.setattr(experts, "ROWS_AT_ONCE", 4 * 100)  # group 1 goes by passes, the others at once
    mixed = fit()
    monkeypatch.setattr(experts, "ROWS_AT_ONCE", 0)
    large = fit()
    assert set(small) == set(mixed) == set(large) == {1, 2, 3}  # of group 4 no fold has a model of other rows
    for g, one in small.items():
        for other in (mixed[g], large[g]):
            for c in one:
                assert other[c] == pytest.approx(one[c], rel=1e-6, abs=1e-8), (g, c)
