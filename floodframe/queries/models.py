"""Queries on splits, metrics, training, scoring, zones and local experts."""

import json

from pyspark.sql import Window, functions as F

from floodframe import constants as K
from floodframe.functions import geo, risk
from floodframe.operators import features, local, metrics, scoring, train, zones
from floodframe.plans import regional, training
from floodframe.queries.base import query, r, rounded
from floodframe.session import cut_lineage, side_by_side

_SCORES = ["p_a", "p_b", "p_c"]
_THR = 0.45


def _confusion_sql(p="p_b", thr=_THR):
    return (f"CAST(count(*) FILTER (y = 1 AND {p} >= {thr}) AS DOUBLE) AS tp, CAST(count(*) FILTER (y = 0 AND {p} >= {thr}) AS DOUBLE) AS fp, "
            f"CAST(count(*) FILTER (y = 0 AND {p} < {thr}) AS DOUBLE) AS tn, CAST(count(*) FILTER (y = 1 AND {p} < {thr}) AS DOUBLE) AS fn")


def _loss_sql(p="p_b"):
    q = f"least(greatest({p}, 1e-6), 1 - 1e-6)"
    return f"avg(({q} - y) * ({q} - y)) AS brier, avg(-ln(CASE WHEN y = 1 THEN {q} ELSE 1 - {q} END)) AS log_loss"


_MCC = "coalesce((tp * tn - fp * fn) / nullif(sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)), 0), 0)"
_RATES = {
    "tpr": "coalesce(tp / nullif(tp + fn, 0), 0)", "tnr": "coalesce(tn / nullif(tn + fp, 0), 0)", "fpr": "coalesce(fp / nullif(fp + tn, 0), 0)",
    "fnr": "coalesce(fn / nullif(fn + tp, 0), 0)", "precision": "coalesce(tp / nullif(tp + fp, 0), 0)", "recall": "coalesce(tp / nullif(tp + fn, 0), 0)",
    "accuracy": "(tp + tn) / (tp + fp + tn + fn)", "balanced_accuracy": "(coalesce(tp / nullif(tp + fn, 0), 0) + coalesce(tn / nullif(tn + fp, 0), 0)) / 2",
    "mcc": _MCC,
}
_BETAS = {f"fbeta_{t // 10}_{t % 10}": f"coalesce((1 + {t / 10}E0 * {t / 10}E0) * tp / nullif((1 + {t / 10}E0 * {t / 10}E0) * tp + {t / 10}E0 * {t / 10}E0 * fn + fp, 0), 0)" for t in range(10, 31)}
_COUNTS = ", ".join(f"CAST({c} AS BIGINT) AS {c}" for c in ("tp", "fp", "tn", "fn")) + ", CAST(fp + fn AS BIGINT) AS fp_plus_fn"


def _named(expressions, digits=6):
    return ", ".join(f'{r(e, digits)} AS "{n}"' for n, e in expressions.items())


_RANKS = """
s AS (SELECT least(greatest({p}, 1e-6), 1 - 1e-6) AS score, CAST(count(*) FILTER (y = 1) AS DOUBLE) AS pos, CAST(count(*) FILTER (y = 0) AS DOUBLE) AS neg FROM {t} GROUP BY 1),
w AS (SELECT pos, neg, coalesce(sum(neg) OVER (ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below,
  sum(pos) OVER (ORDER BY score DESC) AS hits, sum(pos + neg) OVER (ORDER BY score DESC) AS flagged FROM s),
ranks AS (SELECT sum(pos * (below + neg / 2)) / (sum(pos) * sum(neg)) AS roc_auc, sum(pos * hits / flagged) / sum(pos) AS pr_auc FROM w)"""


# ---- roles, splits, weights -----------------------------------------------------------------------

_ROLE_COLUMNS = {"gee_slope_mean": "x1 / 10", "gee_twi": "x1 + x2", "intensity": "p_a", "moisture": "p_b", "flow": "p_c", "area": "x1 * x2", "gee_ndvi_mean_30d": "x1 / (x2 + 3)"}


@query("partition_features", f"""
WITH f AS (SELECT {', '.join(f'{e} AS {n}' for n, e in _ROLE_COLUMNS.items())} FROM fx_preds),
cv AS ({' UNION ALL '.join(f"SELECT '{n}' AS feature, stddev_samp({n}) / (abs(avg({n})) + 1e-6) AS cv FROM f" for n in _ROLE_COLUMNS)}),
cut AS (SELECT quantile_cont(cv, 0.35) AS lo, quantile_cont(cv, 0.70) AS hi FROM cv)
SELECT feature, {r('cv')} AS cv, CASE WHEN feature = 'gee_slope_mean' THEN 'static' WHEN cv <= lo THEN 'static' WHEN cv >= hi THEN 'dynamic'
  WHEN feature IN ('gee_twi', 'gee_ndvi_mean_30d') THEN 'static' ELSE 'dynamic' END AS role FROM cv, cut
""")
def _(x):
    df = x.fx_preds.selectExpr(*[f"{e} AS {n}" for n, e in _ROLE_COLUMNS.items()])
    return rounded(features.partition_features(df, list(_ROLE_COLUMNS)))


_HASHED = "(SELECT *, row_number() OVER (PARTITION BY y ORDER BY md5(concat(row_id, '|42')), row_id) AS rn, count(*) OVER (PARTITION BY y) AS n FROM fx_preds)"


@query("stratified_split", f"SELECT row_id, y, rn <= n * 0.2E0 AS is_holdout FROM {_HASHED} AS h")
def _(x):
    return features.stratified_split(x.fx_preds.select("row_id", "y"), "y", "row_id", 0.2)


@query("assign_folds", f"SELECT row_id, y, CAST((rn - 1) % 5 AS INT) AS fold FROM {_HASHED} AS h")
def _(x):
    return features.assign_folds(x.fx_preds.select("row_id", "y"), "y", "row_id", 5)


@query("class_weight", f"SELECT {r('count(*) FILTER (y = 0) / greatest(1, count(*) FILTER (y = 1))')} AS scale_pos_weight FROM fx_preds")
def _(x):
    return rounded(features.class_weight(x.fx_preds, "y"))


@query("class_distribution", "SELECT y, count(*) AS n FROM fx_preds GROUP BY y")
def _(x):
    return features.class_distribution(x.fx_preds, "y")


@query("prepare_training", f"""
SELECT row_id, y, {r('x1')} AS gee_elevation_mean, {r('nullif(p_a, 0)')} AS gee_twi, {r('p_c')} AS gee_slope_mean, rn <= n * 0.2E0 AS is_holdout FROM {_HASHED} AS h
""")
def _(x):
    df = x.fx_preds.selectExpr("row_id", "y", "x1 AS gee_elevation_mean", "p_a AS gee_twi", "p_c AS gee_slope_mean", "x2 AS other")
    return rounded(training.prepare_training(df, ["gee_elevation_mean", "gee_twi", "gee_slope_mean", "absent"], "y", "row_id"))


# ---- metrics ------------------------------------------------------------------------------------------

@query("classification_metrics", f"""
WITH c AS (SELECT {_confusion_sql()}, {_loss_sql()} FROM fx_preds)
SELECT {_THR}E0 AS threshold, {_COUNTS}, {_named({'brier': 'brier', 'log_loss': 'log_loss', **_RATES, **_BETAS})} FROM c
""")
def _(x):
    return rounded(metrics.classification_metrics(x.fx_preds, "y", "p_b", _THR))


@query("ranking_metrics", f"WITH {_RANKS.format(p='p_b * 0.6E0 + p_a * 0.4E0', t='fx_preds').lstrip()} SELECT {_named({'roc_auc': 'roc_auc', 'pr_auc': 'pr_auc'})} FROM ranks")
def _(x):
    df = x.fx_preds.withColumn("p", F.col("p_b") * 0.6 + F.col("p_a") * 0.4)
    return rounded(metrics.ranking_metrics(df, "y", "p"))


_GRID = "(SELECT CAST(unnest(range(10, 91)) AS DOUBLE) / 100 AS threshold)"
_SWEEP = f"""
WITH g AS (SELECT threshold, CAST(count(*) FILTER (y = 1 AND p_b >= threshold) AS DOUBLE) AS tp, CAST(count(*) FILTER (y = 0 AND p_b >= threshold) AS DOUBLE) AS fp,
  CAST(count(*) FILTER (y = 0 AND p_b < threshold) AS DOUBLE) AS tn, CAST(count(*) FILTER (y = 1 AND p_b < threshold) AS DOUBLE) AS fn, {_loss_sql()}
  FROM fx_preds, {_GRID} AS t GROUP BY threshold)
SELECT threshold, {_COUNTS}, {_named({'brier': 'brier', 'log_loss': 'log_loss', **_RATES, **_BETAS, 'selection_score': f'round(-(fp + fn) + {_MCC} - brier, 9)'})} FROM g
"""


@query("sweep_thresholds", _SWEEP)
def _(x):
    return rounded(metrics.sweep_thresholds(x.fx_preds, "y", "p_b"))


@query("best_threshold", f"SELECT * FROM ({_SWEEP}) AS s ORDER BY selection_score DESC, threshold LIMIT 1")
def _(x):
    return rounded(metrics.best_threshold(metrics.sweep_thresholds(x.fx_preds, "y", "p_b")))


_SEARCH = f"""
WITH wt AS (SELECT a, b, 1 - a - b AS c FROM (SELECT CAST(unnest(range(1, 20)) AS DOUBLE) / 20 AS a) AS i, (SELECT CAST(unnest(range(1, 20)) AS DOUBLE) / 20 AS b) AS j
  WHERE a <= 0.9E0 + 1e-9 AND b <= 0.9E0 + 1e-9 AND 1 - a - b >= 0.05E0 - 1e-9 AND 1 - a - b <= 0.9E0 + 1e-9),
d AS (SELECT p_a, p_b, p_c, CAST(count(*) FILTER (y = 1) AS DOUBLE) AS pos, CAST(count(*) FILTER (y = 0) AS DOUBLE) AS neg FROM fx_preds GROUP BY 1, 2, 3),
m AS (SELECT a, b, c, pos, neg, a * p_a + b * p_b + c * p_c AS p FROM d, wt),
bin AS (SELECT a, b, c, list_sum([CASE WHEN p >= t / 100 THEN 1 ELSE 0 END FOR t IN [CAST(u AS DOUBLE) FOR u IN range(10, 91)]]) AS k, sum(pos) AS pos, sum(neg) AS neg,
  sum(pos * (1 - q) * (1 - q) + neg * q * q) AS sse FROM (SELECT *, least(greatest(p, 1e-6), 1 - 1e-6) AS q FROM m) AS z GROUP BY 1, 2, 3, 4),
total AS (SELECT a, b, c, sum(pos) AS np, sum(neg) AS nn, sum(sse) / sum(pos + neg) AS brier FROM bin GROUP BY 1, 2, 3),
h AS (SELECT a, b, c, brier, t, np, nn, coalesce(sum(bin.pos) FILTER (k > t - 10), 0) AS tp, coalesce(sum(bin.neg) FILTER (k > t - 10), 0) AS fp
  FROM total JOIN (SELECT unnest(range(10, 91)) AS t) AS tt ON true JOIN bin USING (a, b, c) GROUP BY a, b, c, brier, t, np, nn),
g AS (SELECT a, b, c, brier, CAST(t AS DOUBLE) / 100 AS threshold, tp, fp, nn - fp AS tn, np - tp AS fn FROM h)
SELECT {r('a')} AS weight_static, {r('b')} AS weight_dynamic, {r('c')} AS weight_full, threshold, {_COUNTS}, {r('brier')} AS brier, {r(_MCC)} AS mcc,
  {r(f'round(-(fp + fn) + {_MCC} - brier, 9)')} AS selection_score FROM g
"""
_SEARCHED = ["weight_static", "weight_dynamic", "weight_full", "threshold", "tp", "fp", "tn", "fn", "fp_plus_fn", "brier", "mcc", "selection_score"]


@query("search_weights", f"SELECT * FROM ({_SEARCH}) AS s")
def _(x):
    return rounded(metrics.search_weights(x.fx_preds, "y", _SCORES).select(*_SEARCHED))


@query("best_weights", f"SELECT * FROM ({_SEARCH}) AS s ORDER BY selection_score DESC, weight_static, weight_dynamic, threshold LIMIT 1")
def _(x):
    return rounded(metrics.best_weights(metrics.search_weights(x.fx_preds, "y", _SCORES)).select(*_SEARCHED))


@query("top_combinations", f"SELECT * FROM ({_SEARCH}) AS s ORDER BY fp_plus_fn, weight_static, weight_dynamic, threshold LIMIT 10")
def _(x):
    return rounded(metrics.top_combinations(metrics.search_weights(x.fx_preds, "y", _SCORES)).select(*_SEARCHED))


@query("blend_probabilities", f"SELECT row_id, {r('0.45E0 * p_a + 0.05E0 * p_b + 0.5E0 * p_c', 5)} AS blended, CASE WHEN 0.45E0 * p_a + 0.05E0 * p_b + 0.5E0 * p_c >= 0.51E0 THEN 1 ELSE 0 END AS prediction FROM fx_preds")
def _(x):
    return rounded(metrics.blend(x.fx_preds, _SCORES, (0.45, 0.05, 0.5), 0.51).select("row_id", "blended", "prediction"), 5)


_BLENDED = "(SELECT y, 0.45E0 * p_a + 0.05E0 * p_b + 0.5E0 * p_c AS p FROM fx_preds)"


@query("evaluate_blend", f"""
WITH b AS {_BLENDED}, {_RANKS.format(p='p', t='b').lstrip()}, c AS (SELECT {_confusion_sql('p', '0.51E0')}, {_loss_sql('p')} FROM b)
SELECT 0.51E0 AS threshold, {_COUNTS}, 0.45E0 AS weight_static, 0.05E0 AS weight_dynamic, 0.5E0 AS weight_full,
  {_named({'brier': 'brier', 'log_loss': 'log_loss', **_RATES, **_BETAS, 'roc_auc': 'roc_auc', 'pr_auc': 'pr_auc', 'fbeta_default': _BETAS['fbeta_2_0']})} FROM c, ranks
""")
def _(x):
    return rounded(metrics.evaluate_blend(x.fx_preds, "y", _SCORES, (0.45, 0.05, 0.5), 0.51))


@query("backtest", f"""
WITH {_RANKS.format(p='p_b', t='fx_preds').lstrip()}, c AS (SELECT {_confusion_sql(thr='0.5')} FROM fx_preds)
SELECT {_named({'average_precision': 'pr_auc', 'roc_auc': 'roc_auc', 'f1_score': _BETAS['fbeta_1_0'], 'precision': _RATES['precision'], 'recall': _RATES['recall'],
  'csi': 'tp / greatest(1, tp + fn + fp)'})}, CAST(tp + fp + tn + fn AS BIGINT) AS events FROM c, ranks
""")
def _(x):
    return rounded(metrics.backtest(x.fx_preds, "y", "p_b"))


_FOLD_METRICS = {"fp_plus_fn": "fp + fn", **_RATES, **{k: _BETAS[k] for k in ("fbeta_1_0", "fbeta_1_5", "fbeta_2_0", "fbeta_2_5", "fbeta_3_0")},
                 "brier": "brier", "log_loss": "log_loss"}


@query("cv_summary", f"""
WITH c AS (SELECT l_partkey % 5 AS fold, {_confusion_sql()}, {_loss_sql()} FROM fx_preds GROUP BY 1),
m AS ({' UNION ALL '.join(f"SELECT '{n}' AS metric, {e} AS value FROM c" for n, e in _FOLD_METRICS.items())})
SELECT metric, {r('avg(value)')} AS mean, {r('stddev_samp(value)')} AS std FROM m GROUP BY metric
""")
def _(x):
    folds = metrics.fold_metrics(x.fx_preds.withColumn("fold", F.col("l_partkey") % 5), "y", "p_b", _THR)
    return rounded(metrics.cv_summary(folds))


@query("trial_log", f"""
WITH c AS (SELECT l_partkey % 6 AS trial_number, l_suppkey % 4 AS fold, {_confusion_sql()}, {_loss_sql()} FROM fx_preds GROUP BY 1, 2)
SELECT trial_number, {r('-avg(fp + fn)')} AS objective_value, {r('avg(fp + fn)')} AS mean_fp_plus_fn, {r(f'avg({_MCC})')} AS mean_mcc, {r('avg(brier)')} AS mean_brier,
  concat('{{"depth":', CAST(trial_number + 3 AS VARCHAR), '}}') AS params FROM c GROUP BY trial_number
""")
def _(x):
    trials = x.fx_preds.select((F.col("l_partkey") % 6).alias("trial_number"), (F.col("l_suppkey") % 4).alias("fold"), "y", "p_b")
    counted = trials.groupBy("trial_number", "fold").agg(*metrics._confusion("y", "p_b", _THR), *metrics._losses("y", "p_b"))
    scored = counted.withColumns(metrics.confusion_metrics(())).withColumn("depth", (F.col("trial_number") + 3).cast("int"))
    objective = scored.groupBy("trial_number").agg((-F.avg("fp_plus_fn")).alias("objective_value"))
    return rounded(metrics.trial_log(scored.join(objective, "trial_number"), ["depth"]))


@query("oof_long", " UNION ALL ".join(f"SELECT row_id, y AS target, '{c}' AS model, {r(c)} AS calibrated_proba FROM fx_preds" for c in _SCORES))
def _(x):
    return rounded(metrics.oof_long(x.fx_preds, _SCORES, ["row_id"], "y"))


# ---- training ------------------------------------------------------------------------------------------

_ROLES = {"static": ["x1", "p_a"], "dynamic": ["x2", "p_c"], "full": ["x1", "x2", "p_a", "p_c"]}
_SMALL = {"boosted": {"maxIter": 3, "maxDepth": 3}, "forest": {"numTrees": 5, "maxDepth": 4}, "linear": {"maxIter": 10}}


def _training_rows(x):
    """Labels that depend on the features, so that there is something to learn."""
    signal = (F.col("x1") / 50000 + F.col("p_a") + F.col("y")) > 1.6
    return x.fx_preds.select("row_id", "x1", "x2", "p_a", "p_c", signal.cast("int").alias("label"))


# Fitted models have no SQL; what has to hold of their output does, as counts and truths.
_LABELLED = "(SELECT row_id, CASE WHEN x1 / 50000 + p_a + y > 1.6E0 THEN 1 ELSE 0 END AS label FROM fx_preds)"


def _within(*columns):
    """Whether all columns are probabilities."""
    truths = [F.coalesce(F.col(c).between(0.0, 1.0), F.lit(False)) for c in columns]
    return F.expr("true") if not truths else truths[0] if len(truths) == 1 else F.array_min(F.array(*truths))


def _learned(df, score, label="label", least=0.6):
    """Whether the score ranks the label clearly better than chance."""
    return F.lit(metrics.ranking_metrics(df, label, score).first()["roc_auc"] > least)


@query("train_models", f"SELECT row_id, label, true AS in_range, true AS boosted_learned, true AS linear_learned FROM {_LABELLED} AS t")
def _(x):
    df = _training_rows(x)
    models = train.train_models(df, _ROLES, params=_SMALL)
    for kind, model in models.items():
        df = train.with_probability(model, df, f"p_{kind}")
    df = cut_lineage(x.spark, df)
    # the forest's role holds no column the label depends on
    learned = [_learned(df, f"p_{kind}").alias(f"{kind}_learned") for kind in ("boosted", "linear")]
    return df.select("row_id", "label", _within(*train.SCORE_COLUMNS).alias("in_range"), *learned)


@query("oof_predictions", f"""
SELECT row_id, label, CAST((row_number() OVER (PARTITION BY label ORDER BY md5(concat(row_id, '|42')), row_id) - 1) % 3 AS INT) AS fold, true AS in_range, true AS learned FROM {_LABELLED} AS t
""")
def _(x):
    df = features.assign_folds(_training_rows(x), "label", "row_id", 3)
    out = cut_lineage(x.spark, train.oof_predict(df, train.estimator("linear", _ROLES["full"], maxIter=10)))
    return out.select("row_id", "label", "fold", _within("oof").alias("in_range"), _learned(out, "oof").alias("learned"))


@query("calibrated_scores", "SELECT row_id, y, true AS in_range, true AS in_order, true AS same_mean FROM fx_preds")
def _(x):
    df = x.fx_preds.select("row_id", "y", "p_b")
    out = cut_lineage(x.spark, train.calibrate(df, train.fit_calibrator(df, "p_b", "y"), "p_b", "calibrated_proba"))
    # equal calibrated values pool neighbouring scores: ranges of scores per value may not overlap
    spans = out.groupBy("calibrated_proba").agg(F.min("p_b").alias("lo"), F.max("p_b").alias("hi"))
    crossed = spans.select("hi", F.lead("lo").over(Window.orderBy("calibrated_proba")).alias("after")).where("after < hi")
    means = out.agg(F.avg("calibrated_proba").alias("p"), F.avg("y").alias("y")).first()
    return out.select("row_id", "y", _within("calibrated_proba").alias("in_range"), F.lit(crossed.isEmpty()).alias("in_order"),
                      F.lit(abs(means["p"] - means["y"]) < 1e-4).alias("same_mean"))


_CYCLES = [", ".join(f"{kind}:{role}" for kind, role in roles.items()) for roles in train.cycles()]


@query("rotate_roles", " UNION ALL ".join(
    f"SELECT {i} AS cycle, '{name}' AS roles, (SELECT CAST(sum(label) AS BIGINT) FROM {_LABELLED} AS t) AS positives, (SELECT count(*) FROM fx_preds) AS n_rows, true AS weights_sum, true AS threshold_in_grid, true AS better_than_half, {i} IS NOT NULL AS listed"
    for i, name in enumerate(_CYCLES, start=1)))
def _(x):
    out = train.rotate_roles(_training_rows(x), _ROLES, "row_id", k=2, params=_SMALL)
    total = F.col("weight_static") + F.col("weight_dynamic") + F.col("weight_full")
    return out.select(
        "cycle", "roles", (F.col("tp") + F.col("fn")).alias("positives"), (F.col("tp") + F.col("fn") + F.col("fp") + F.col("tn")).alias("n_rows"),
        (F.abs(total - 1) < 1e-9).alias("weights_sum"), F.col("threshold").between(0.1, 0.9).alias("threshold_in_grid"),
        (2 * F.col("fp_plus_fn") < F.col("tp") + F.col("fn") + F.col("fp") + F.col("tn")).alias("better_than_half"), F.lit(True).alias("listed"))


_TRIALS = train.sample_param_grid({"maxIter": [5, 10, 15], "regParam": [0.0, 0.01, 0.1]}, 3)


@query("tune_parameters", " UNION ALL ".join(
    f"SELECT {i} AS trial_number, '{json.dumps({'params_json': json.dumps(p)}, separators=(',', ':'))}' AS params, true AS objective_is_errors, true AS brier_in_range, true AS mcc_in_range"
    for i, p in enumerate(_TRIALS)))
def _(x):
    df = features.assign_folds(_training_rows(x), "label", "row_id", 2)
    log = metrics.trial_log(train.tune(df, "linear", _ROLES["full"], _TRIALS), ["params_json"])
    return log.select("trial_number", "params", (F.abs(F.col("objective_value") + F.col("mean_fp_plus_fn")) < 1e-9).alias("objective_is_errors"),
                      F.col("mean_brier").between(0.0, 0.25).alias("brier_in_range"), F.col("mean_mcc").between(0.05, 1.0).alias("mcc_in_range"))


@query("feature_importance", f"SELECT CAST(unnest(range(1, {len(_ROLES['full']) + 1})) AS INT) AS rank, true AS known, true AS sums_to_one, true AS descending, 'x1' AS least_expected_first")
def _(x):
    df = _training_rows(x)
    model = train.estimator("forest", _ROLES["full"], **_SMALL["forest"]).fit(df)
    rows = train.feature_importance(model, _ROLES["full"], df).orderBy("rank").collect()
    values = [r["importance"] for r in rows]
    known = sorted(r["feature"] for r in rows) == sorted(_ROLES["full"])
    return x.spark.createDataFrame(
        [(r["rank"], known, abs(sum(values) - 1) < 1e-9, values == sorted(values, reverse=True), rows[0]["feature"]) for r in rows],
        "rank int, known boolean, sums_to_one boolean, descending boolean, least_expected_first string")


# ---- scoring and reports -----------------------------------------------------------------------------------

@query("score_models", f"SELECT row_id, label, true AS in_range, true AS interval_holds, true AS prediction_follows, true AS learned FROM {_LABELLED} AS t")
def _(x):
    df = cut_lineage(x.spark, features.assign_folds(features.with_class_weight(_training_rows(x), "label"), "label", "row_id", 2))

    def fitted(kind, role):  # calibrated on scores of rows the model has not seen
        model = train.estimator(kind, _ROLES[role], "label", "weight", **_SMALL[kind])
        return model.fit(df), train.fit_calibrator(train.oof_predict(df, model, "fold", "_oof", written=True), "_oof", "label")

    roles = train.MODEL_ROLES
    models = dict(zip(roles, side_by_side(x.spark, [lambda kind=kind, role=role: fitted(kind, role) for kind, role in roles.items()])))
    out = cut_lineage(x.spark, regional.score(df, models, (0.45, 0.05, 0.5), 0.5))
    p = F.col("Risk_Probability")
    return out.select("row_id", "label", _within("Risk_Probability", *train.SCORE_COLUMNS).alias("in_range"),
                      ((F.col("Risk_Lower_90") <= p) & (p <= F.col("Risk_Upper_90"))).alias("interval_holds"),
                      (F.col("Prediction") == (p >= 0.5).cast("int")).alias("prediction_follows"), _learned(out, "Risk_Probability").alias("learned"))


@query("risk_columns", f"""
SELECT row_id, {r('p', 5)} AS "Risk_Probability", {r('p', 5)} AS "Final_Risk_Score", {r('CASE WHEN p - h < 0 THEN 0 ELSE p - h END', 5)} AS "Risk_Lower_90",
  {r('CASE WHEN p + h > 1 THEN 1 ELSE p + h END', 5)} AS "Risk_Upper_90", {r('h', 5)} AS "Uncertainty", CASE WHEN p >= 0.5 THEN 1 ELSE 0 END AS "Prediction"
FROM (SELECT row_id, 0.3E0 * p_a + 0.3E0 * p_b + 0.4E0 * p_c AS p, p_c / 7 AS h FROM fx_preds) AS s
""")
def _(x):
    out = scoring.risk_columns(x.fx_preds, _SCORES, (0.3, 0.3, 0.4), 0.5, F.col("p_c") / 7)
    return rounded(out.drop(*[c for c in x.fx_preds.columns if c != "row_id"]), 5)


@query("risk_levels", """
SELECT row_id, CASE WHEN Final_Risk_Score >= 0.8 THEN 'very-high-risk' WHEN Final_Risk_Score >= 0.6 THEN 'high-risk' WHEN Final_Risk_Score >= 0.4 THEN 'moderate-risk' ELSE 'low-risk' END AS level FROM fx_scored
""")
def _(x):
    return x.fx_scored.select("row_id", risk.risk_level(F.col("Final_Risk_Score")).alias("level"))


_PRIORITY = """
WITH s AS (SELECT *, Risk_Upper_90 - Risk_Lower_90 AS w FROM fx_scored), q AS (SELECT quantile_cont(w, 1 / 3) AS lo, quantile_cont(w, 2 / 3) AS hi FROM s)
SELECT row_id, CASE WHEN Final_Risk_Score >= 0.5 AND w < lo THEN 'High risk (confident)' WHEN Final_Risk_Score >= 0.5 THEN 'High risk (uncertain)'
  WHEN w >= hi THEN 'Investigate (uncertain)' ELSE 'Low risk (confident)' END AS "Operational_Priority",
  CASE WHEN Final_Risk_Score >= 0.8 AND w <= 0.2 THEN 'Immediate mitigation' WHEN Final_Risk_Score >= 0.6 AND w <= 0.4 THEN 'Rapid verification'
  WHEN Final_Risk_Score >= 0.4 AND w <= 0.7 THEN 'Investigate (uncertain)' ELSE 'Monitor' END AS "Action_Trigger" FROM s, q
"""


@query("operational_priority", _PRIORITY)
def _(x):
    return scoring.operational_priority(x.fx_scored).select("row_id", "Operational_Priority", "Action_Trigger")


@query("action_triggers", _PRIORITY.replace('"Operational_Priority",', "AS p,").replace("row_id, CASE WHEN Final_Risk_Score >= 0.5 AND w < lo THEN 'High risk (confident)' WHEN Final_Risk_Score >= 0.5 THEN 'High risk (uncertain)'\n  WHEN w >= hi THEN 'Investigate (uncertain)' ELSE 'Low risk (confident)' END AS AS p,", "row_id,"))
def _(x):
    width = scoring.interval_width(x.fx_scored)
    return x.fx_scored.select("row_id", risk.action_trigger(F.col("Final_Risk_Score"), width).alias("Action_Trigger"))


@query("report_summary", f"""
SELECT {_named({'avg_risk_score': 'avg(Final_Risk_Score)', 'max_risk_score': 'max(Final_Risk_Score)', 'avg_risk_lower_90': 'avg(Risk_Lower_90)',
  'avg_risk_upper_90': 'avg(Risk_Upper_90)', 'avg_uncertainty': 'avg(Risk_Upper_90 - Risk_Lower_90)', 'high_risk_area_pct': 'avg(CASE WHEN Final_Risk_Score >= 0.5 THEN 1 ELSE 0 END) * 100'}, 8)},
  0.5E0 AS operating_threshold, (SELECT mode(t ORDER BY t) FROM (SELECT CASE Land_Cover WHEN 10 THEN 'Trees' WHEN 20 THEN 'Shrubland' WHEN 30 THEN 'Grassland' WHEN 40 THEN 'Cropland'
  WHEN 50 THEN 'Built-up' WHEN 60 THEN 'Bare/Sparse vegetation' WHEN 70 THEN 'Snow/Ice' WHEN 80 THEN 'Water' WHEN 90 THEN 'Wetland' WHEN 100 THEN 'Moss/Lichen' ELSE 'Unknown' END AS t FROM fx_scored) AS l) AS dominant_land_cover
FROM fx_scored
""")
def _(x):
    from floodframe.operators.cleaning import with_land_cover_type

    return rounded(scoring.report_summary(with_land_cover_type(x.fx_scored)), 8)


@query("priority_shares", f'SELECT "Operational_Priority", {r("count(*) / (SELECT count(*) FROM fx_scored)")} AS share FROM ({_PRIORITY}) AS p GROUP BY 1')
def _(x):
    return rounded(scoring.shares(scoring.operational_priority(x.fx_scored), "Operational_Priority"))


@query("global_importance", f"""
SELECT concat('f', CAST(i - 1 AS VARCHAR)) AS feature, {r('avg(abs(CAST(embedding[i] AS DOUBLE)))')} AS importance
FROM embeddings, (SELECT unnest(range(1, 65)) AS i) AS p GROUP BY i
""")
def _(x):
    return rounded(scoring.global_importance(x.embeddings, "embedding"))


@query("binned_curve", f"""
WITH q AS (SELECT quantile_cont(x1, 0.01) AS lo, quantile_cont(x1, 0.99) AS hi FROM fx_scored),
b AS (SELECT CAST(least(greatest(ceil((x1 - lo) / ((hi - lo) / 19)), 1), 19) AS BIGINT) AS bin, Final_Risk_Score FROM fx_scored, q WHERE x1 BETWEEN lo AND hi),
m AS (SELECT bin, avg(Final_Risk_Score) AS s, count(*) AS n FROM b GROUP BY bin)
SELECT g.bin, {r('lo + (g.bin - 0.5E0) * ((hi - lo) / 19)', 4)} AS centre, {r('s', 4)} AS mean_score, coalesce(n, 0) AS n
FROM (SELECT unnest(range(1, 20)) AS bin) AS g CROSS JOIN q LEFT JOIN m ON m.bin = g.bin
""")
def _(x):
    return rounded(scoring.binned_curve(x.fx_scored, "x1"), 4)


@query("score_histogram", "SELECT CAST(least(floor(Final_Risk_Score / (1E0 / 20)), 19) AS BIGINT) AS bin, count(*) AS n FROM fx_scored WHERE Final_Risk_Score BETWEEN 0 AND 1 GROUP BY 1")
def _(x):
    return scoring.histogram(x.fx_scored, F.col("Final_Risk_Score"))


@query("width_histogram", "SELECT CAST(least(floor(greatest(Risk_Upper_90 - Risk_Lower_90, 0) / (1E0 / 20)), 19) AS BIGINT) AS bin, count(*) AS n FROM fx_scored WHERE Risk_Upper_90 - Risk_Lower_90 <= 1 GROUP BY 1")
def _(x):
    return scoring.width_histogram(x.fx_scored)


@query("land_cover_counts", "SELECT Land_Cover, count(*) AS n FROM fx_scored GROUP BY Land_Cover")
def _(x):
    from floodframe.operators.rules import value_counts

    return value_counts(x.fx_scored, "Land_Cover")


@query("map_points", f"""
SELECT row_id, {r('(SELECT avg(latitude) FROM fx_scored)')} AS centre_lat, {r('(SELECT avg(longitude) FROM fx_scored)')} AS centre_lon
FROM fx_scored ORDER BY md5(concat(row_id, '|42')), row_id LIMIT 1000
""")
def _(x):
    return rounded(scoring.map_points(x.fx_scored, "row_id", 1000).select("row_id", "centre_lat", "centre_lon"))


@query("sample_coverage", f"SELECT 80000 AS requested, count(*) AS returned, {r('count(*) / 80000')} AS coverage_ratio, count(*) / 80000 < 0.8 AS low_coverage FROM fx_scored")
def _(x):
    return rounded(scoring.coverage(x.fx_scored, 80_000))


# ---- zones ------------------------------------------------------------------------------------------------------

_EPS = 0.12


def _cluster_sql(columns, table, eps, min_samples, min_size):
    axes = [f"i{k}" for k in range(len(columns))]
    z = ", ".join(f"CAST(floor((({c}) - (SELECT avg({c}) FROM {table})) / (SELECT stddev_pop({c}) FROM {table}) / {eps}) AS BIGINT) AS {a}" for c, a in zip(columns, axes))
    key = "(" + ", ".join(axes) + ")"
    touching = " AND ".join(f"abs(a.{i} - b.{i}) <= 1" for i in axes)
    pick = ", ".join(f"b.{i} AS {i}" for i in axes)
    return f"""
WITH RECURSIVE z AS (SELECT *, {z} FROM {table}),
dense AS (SELECT {', '.join(axes)}, count(*) AS n, row_number() OVER (ORDER BY {', '.join(axes)}) AS id FROM z GROUP BY {', '.join(axes)} HAVING count(*) >= {min_samples}),
edge AS (SELECT a.id AS s, b.id AS t FROM dense AS a JOIN dense AS b ON {touching}),
reach AS (SELECT id AS v, id AS root FROM dense UNION SELECT edge.t, reach.root FROM reach JOIN edge ON edge.s = reach.v),
label AS (SELECT v, min(root) AS root FROM reach GROUP BY v),
size AS (SELECT root FROM label JOIN dense ON dense.id = label.v GROUP BY root HAVING sum(n) >= {min_size}),
num AS (SELECT root, dense_rank() OVER (ORDER BY root) - 1 AS cluster FROM size),
labelled AS (SELECT z.*, coalesce(num.cluster, -1) AS cluster FROM z LEFT JOIN dense ON {' AND '.join(f'z.{i} = dense.{i}' for i in axes)}
  LEFT JOIN label ON label.v = dense.id LEFT JOIN num ON num.root = label.root)
"""


_CLUSTERED = _cluster_sql(["latitude", "longitude"], "fx_events", _EPS, 25, 40)


@query("spatial_clusters", _CLUSTERED + "SELECT event_id, CAST(CASE WHEN (SELECT min(cluster) FROM labelled) = -1 THEN cluster + 1 ELSE cluster END AS INT) AS spatial_cluster FROM labelled")
def _(x):
    return zones.spatial_clusters(x.fx_events, _EPS, 25, 40).select("event_id", "spatial_cluster")


@query("spatial_clusters_fallback", "SELECT event_id, true AS has_cluster, CAST(10 AS BIGINT) AS n_clusters FROM fx_points")
def _(x):
    out = cut_lineage(x.spark, zones.spatial_clusters(x.fx_points, method="kmeans").select("event_id", "spatial_cluster"))
    return out.select("event_id", F.col("spatial_cluster").between(0, 9).alias("has_cluster"), F.lit(out.select("spatial_cluster").distinct().count()).cast("long").alias("n_clusters"))


_ZONES = _cluster_sql(["latitude", "longitude", "Final_Risk_Score"], "fx_scored", 0.25, 40, 60) + """,
med AS (SELECT cluster, median(Final_Risk_Score) AS m FROM labelled WHERE cluster >= 0 GROUP BY cluster),
cut AS (SELECT quantile_cont(m, 0.33) AS lo, quantile_cont(m, 0.66) AS hi FROM med),
zoned AS (SELECT row_id, CAST(labelled.cluster AS INT) AS "Risk_Cluster", CASE WHEN hi IS NULL THEN 'Uncategorized' WHEN labelled.cluster = -1 THEN 'Outlier/Noise'
  WHEN m >= hi THEN 'High-Risk Zone' WHEN m >= lo THEN 'Moderate-Risk Zone' ELSE 'Low-Risk Zone' END AS "Risk_Zone" FROM labelled CROSS JOIN cut LEFT JOIN med USING (cluster))
"""


@query("risk_zones", _ZONES + "SELECT * FROM zoned")
def _(x):
    return zones.risk_zones(x.fx_scored, 0.25, 40, 60).select("row_id", "Risk_Cluster", "Risk_Zone")


@query("zone_names", f"""
WITH med AS (SELECT l_partkey % 9 - 1 AS c, median(p_b * p_a) AS m FROM fx_preds WHERE l_partkey % 9 > 0 GROUP BY 1),
cut AS (SELECT quantile_cont(m, 0.33) AS lo, quantile_cont(m, 0.66) AS hi FROM med)
SELECT row_id, l_partkey % 9 - 1 AS "Risk_Cluster", CASE WHEN m IS NULL THEN 'Outlier/Noise' WHEN m >= hi THEN 'High-Risk Zone' WHEN m >= lo THEN 'Moderate-Risk Zone' ELSE 'Low-Risk Zone' END AS "Risk_Zone"
FROM fx_preds CROSS JOIN cut LEFT JOIN med ON med.c = l_partkey % 9 - 1
""")
def _(x):
    df = x.fx_preds.select("row_id", (F.col("l_partkey") % 9 - 1).alias("Risk_Cluster"), (F.col("p_b") * F.col("p_a")).alias("Final_Risk_Score"))
    return zones.name_zones(df).select("row_id", "Risk_Cluster", "Risk_Zone")


# ---- local experts --------------------------------------------------------------------------------------------------

_HAV = ("2 * 6371.0088E0 * atan2(sqrt(h), sqrt(1 - h))",
        "(sin(radians(e.latitude - t.latitude) / 2)) ** 2 + cos(radians(t.latitude)) * cos(radians(e.latitude)) * (sin(radians(e.longitude - t.longitude) / 2)) ** 2")
_TARGETS = "(SELECT s_suppkey AS target_id, CAST((s_suppkey * 7919) % 17801 AS DOUBLE) / 100 - 89 AS latitude, CAST((s_suppkey * 104729) % 36000 AS DOUBLE) / 100 - 180 AS longitude FROM supplier)"
_NEAR = f"""near AS (SELECT *, {_HAV[0]} AS dist FROM (SELECT t.target_id, e.event_id, e.flood_start_date, e.target, {_HAV[1]} AS h FROM {_TARGETS} AS t, fx_events AS e) AS d WHERE {_HAV[0]} <= 500)"""


def _targets(x):
    k = F.col("s_suppkey")
    return x.supplier.select(
        k.alias("target_id"), ((k * 7919) % 17801 / F.lit(100.0) - 89).alias("latitude"), ((k * 104729) % 36000 / F.lit(100.0) - 180).alias("longitude"))


def _repeated(df, key):
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select(key)


@query("haversine_distance", f"SELECT event_id, {r('2 * 6371.0088E0 * atan2(sqrt(h), sqrt(1 - h))', 4)} AS km FROM (SELECT event_id, sin(radians(48.2 - latitude) / 2) ** 2 + cos(radians(latitude)) * cos(radians(48.2)) * sin(radians(16.37 - longitude) / 2) ** 2 AS h FROM fx_events) AS s")
def _(x):
    km = geo.haversine_km(F.col("latitude"), F.col("longitude"), F.lit(48.2), F.lit(16.37))
    return rounded(x.fx_events.select("event_id", km.alias("km")), 4)


@query("gaussian_weights", f"SELECT event_id, {r('exp(-0.5E0 * (abs(latitude) * 10 / (250 + 1e-6)) ** 2)')} AS w FROM fx_events")
def _(x):
    return rounded(x.fx_events.select("event_id", risk.gaussian_weight(F.abs("latitude") * 10).alias("w")))


@query("local_samples", f"""
WITH {_NEAR}, flagged AS (SELECT *, flood_start_date >= DATE '2009-01-01' - 3650 AS recent FROM near),
kept AS (SELECT *, count(*) FILTER (recent) OVER (PARTITION BY target_id) AS n FROM flagged)
SELECT target_id, event_id, {r('dist', 3)} AS dist_km, recent AS is_recent, n AS n_recent, recent OR n < 20 AS in_recent_choice FROM kept
""")
def _(x):
    targets, now = _targets(x), F.lit("2009-01-01").cast("date")
    events = x.fx_events
    again = cut_lineage(x.spark, _repeated(events, "event_id")), cut_lineage(x.spark, _repeated(targets, "target_id"))
    marked = events.join(again[0].withColumn("_again", F.lit(True)), "event_id", "left")
    chosen, near = local.local_samples(targets, marked, now, minimum=20), local.local_samples(targets, marked, now)
    # whether a pair is chosen hangs on its target and its recency alone, so pairs need not meet pairs, but for ids that come twice
    twice = F.col("_again").isNotNull() | F.col("_target_again").isNotNull()
    part = lambda pairs: pairs.join(again[1].withColumn("_target_again", F.lit(True)), "target_id", "left")
    groups = cut_lineage(x.spark, chosen.select("target_id", "is_recent").distinct().withColumn("chosen", F.lit(True)))  # at most two rows a target
    once = part(near).where(~twice).join(groups, ["target_id", "is_recent"], "left").withColumn("chosen", F.col("chosen") & F.col("event_id").isNotNull())
    ids = part(chosen).where(twice).select("target_id", "event_id", F.lit(True).alias("chosen"))
    out = once.unionByName(part(near).where(twice).join(ids, ["target_id", "event_id"], "left"))
    return rounded(out.select("target_id", "event_id", "dist_km", "is_recent", "n_recent", F.coalesce("chosen", F.lit(False)).alias("in_recent_choice")), 3)


_RATE = f"""
WITH {_NEAR}, m AS (SELECT target_id, count(*) AS n, avg(dist) AS d, sum(exp(-0.5E0 * (dist / (250 + 1e-6)) ** 2) * (event_id % 3)) / sum(exp(-0.5E0 * (dist / (250 + 1e-6)) ** 2)) AS rate FROM near GROUP BY 1),
j AS (SELECT t.target_id, coalesce(n, 0) AS n_local, coalesce(d, 500) AS avg_dist_km, rate AS local_rate FROM {_TARGETS} AS t LEFT JOIN m USING (target_id))
"""


@query("local_event_rate", _RATE + f"SELECT target_id, n_local, {r('avg_dist_km', 3)} AS avg_dist_km, {r('local_rate', 5)} AS local_rate FROM j")
def _(x):
    events = x.fx_events.withColumn("label", F.col("event_id") % 3)
    out = local.local_event_rate(_targets(x), events, "label")
    return rounded(rounded(out.select("target_id", "n_local", "avg_dist_km", "local_rate"), 5).withColumn("avg_dist_km", F.round("avg_dist_km", 3)), 5)


_WEIGHTED = f"""
WITH j AS (SELECT l_suppkey, row_id, x2 * 40 AS n_local, x1 / 200 AS avg_dist_km, CASE WHEN l_partkey % 4 > 0 THEN p_a / 2 END AS local_rmse, CASE WHEN l_partkey % 3 > 0 THEN p_c / 3 END AS local_logloss,
  CASE WHEN l_partkey % 5 > 0 THEN p_b / 9 END AS local_var, p_b / 3 AS global_rmse, CASE WHEN l_suppkey % 6 > 0 THEN p_a END AS global_proba, CASE WHEN l_suppkey % 5 > 0 THEN p_c END AS local_proba FROM fx_preds),
w AS (SELECT *, greatest(1 / (global_rmse + 1e-6), 1e-6) AS g, greatest(CASE WHEN local_rmse <> 0 THEN 1 / (local_rmse + 1e-6) WHEN local_logloss <> 0 THEN exp(-local_logloss) ELSE 1 END
  * exp(-0.5E0 * (avg_dist_km / (250 + 1e-6)) ** 2) * (n_local / (n_local + 1000)) * CASE WHEN local_var IS NULL THEN 1 ELSE 1 / (local_var + 1e-6) END, 1e-6) AS l FROM j),
b AS (SELECT *, g / (g + l) AS w_global, l / (g + l) AS w_local FROM w),
f AS (SELECT *, coalesce(w_global * global_proba + w_local * local_proba, global_proba, local_proba) AS final_proba,
  0.4E0 * coalesce(1 - abs(global_proba - local_proba), 1) + 0.3E0 * least(1, n_local / 2000) + 0.3E0 / (1 + coalesce(local_var, 0)) AS conf FROM b)
"""


def _weighted(x):
    every = lambda c, k, v: F.when(F.col(c) % k > 0, v)
    return local.blend_weights(x.fx_preds.select(
        "row_id", (F.col("x2") * 40).alias("n_local"), (F.col("x1") / 200).alias("avg_dist_km"), every("l_partkey", 4, F.col("p_a") / 2).alias("local_rmse"),
        every("l_partkey", 3, F.col("p_c") / 3).alias("local_logloss"), every("l_partkey", 5, F.col("p_b") / 9).alias("local_var"), (F.col("p_b") / 3).alias("global_rmse"),
        every("l_suppkey", 6, F.col("p_a")).alias("global_proba"), every("l_suppkey", 5, F.col("p_c")).alias("local_proba"),
    ))


@query("blend_weights", _WEIGHTED + f"SELECT row_id, {r('w_global')} AS w_global, {r('w_local')} AS w_local FROM f")
def _(x):
    return rounded(_weighted(x).select("row_id", "w_global", "w_local"))


@query("combine_local_global", _WEIGHTED + f"""
SELECT row_id, {r('final_proba')} AS final_proba, CASE WHEN final_proba >= 0.5 THEN 1 WHEN final_proba < 0.5 THEN 0 END AS final_label,
  {r('CASE WHEN final_proba IS NULL THEN 0 ELSE least(greatest(conf, 0), 1) END')} AS confidence FROM f
""")
def _(x):
    return rounded(local.combine_local_global(_weighted(x)).select("row_id", "final_proba", "final_label", "confidence"))


@query("local_expert", """
SELECT count(*) AS n_samples, true AS model_fitted, true AS loss_is_finite, true AS rmse_in_range, true AS variance_in_range FROM fx_events
WHERE 2 * 6371.0088E0 * atan2(sqrt(h), sqrt(1 - h)) <= 3000
""".replace("FROM fx_events", "FROM (SELECT sin(radians(latitude) / 2) ** 2 + cos(radians(latitude)) * sin(radians(longitude) / 2) ** 2 AS h FROM fx_events) AS s"))
def _(x):
    place = x.supplier.where("s_suppkey = 1").select(F.lit(1).alias("target_id"), F.lit(0.0).alias("latitude"), F.lit(0.0).alias("longitude"))
    events = x.fx_events.withColumns({"label": (F.col("event_id") % 4 == 0).cast("int"), "days": F.col("flood_duration_days").cast("double"), "lat": F.col("latitude")})
    near = local.local_samples(place, events, F.lit("2009-01-01").cast("date"), radius_km=3000.0)
    model, calibrator, quality = train.local_expert(near, ["days", "lat"], "event_id", "label", "linear", maxIter=5)
    return x.spark.createDataFrame(
        [(quality["n_samples"], model is not None and calibrator is not None, 0 < quality["oof_logloss"] < 5, 0 < quality["oof_rmse"] < 0.6, 0 <= quality["oof_var"] < 0.25)],
        "n_samples long, model_fitted boolean, loss_is_finite boolean, rmse_in_range boolean, variance_in_range boolean")


@query("training_run", f"""
WITH h AS (SELECT label, row_number() OVER (PARTITION BY label ORDER BY md5(concat(row_id, '|42')), row_id) AS rn, count(*) OVER (PARTITION BY label) AS n FROM {_LABELLED} AS t)
SELECT count(*) AS holdout_rows, CAST(sum(label) AS BIGINT) AS holdout_positives, true AS ranks_well, true AS brier_in_range, true AS threshold_in_grid, true AS weights_sum FROM h WHERE rn <= n * 0.2E0
""")
def _(x):
    df = _training_rows(x).withColumn("x1", F.when(F.col("x2") > 3, F.col("x1")))
    run = training.run_training(df, ["x1", "x2", "p_a", "p_c"], "label", "row_id", 2, 0.2, _SMALL)
    cells = F.col("tp") + F.col("fp") + F.col("tn") + F.col("fn")
    return run["holdout"].select(
        cells.alias("holdout_rows"), (F.col("tp") + F.col("fn")).alias("holdout_positives"), (F.col("roc_auc") > 0.6).alias("ranks_well"), F.col("brier").between(0.0, 0.25).alias("brier_in_range"),
        F.col("threshold").between(0.1, 0.9).alias("threshold_in_grid"), (F.abs(F.col("weight_static") + F.col("weight_dynamic") + F.col("weight_full") - 1) < 1e-9).alias("weights_sum"))
