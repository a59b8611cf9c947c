"""Classification metrics, threshold sweeps and ensemble weight search.

Everything works on counts per distinct score or per threshold bin, so rows are never multiplied
by thresholds, and only ranking metrics need an order.
"""

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from floodframe import constants as K
from floodframe.functions.numbers import clamp
from floodframe.operators.ranking import running_totals
from floodframe.session import cut_lineage

_FIRST = K.THRESHOLD_PERCENTS[0]
_LAST = len(K.THRESHOLD_PERCENTS) - 1
_CONFUSION = ("tp", "fp", "tn", "fn")


def clip_probability(p: Column) -> Column:
    return clamp(p, K.PROBABILITY_EPS, 1.0 - K.PROBABILITY_EPS)


def _share(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def beta_name(tenths: int) -> str:
    return f"fbeta_{tenths // 10}_{tenths % 10}"


def confusion_metrics(betas: Sequence[int] = K.FBETA_TENTHS) -> dict[str, Column]:
    """Rates and scores from the columns ``tp fp tn fn``; an empty ratio is 0."""
    tp, fp, tn, fn = (F.col(c).cast("double") for c in _CONFUSION)
    tpr, tnr = _share(tp, tp + fn), _share(tn, tn + fp)
    mcc = F.try_divide(tp * tn - fp * fn, F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)))
    metrics = {
        "tpr": tpr, "tnr": tnr, "fpr": _share(fp, fp + tn), "fnr": _share(fn, fn + tp),
        "precision": _share(tp, tp + fp), "recall": tpr,
        "accuracy": _share(tp + tn, tp + fp + tn + fn),
        "balanced_accuracy": F.when(tp + fn == 0, tnr).when(tn + fp == 0, tpr).otherwise((tpr + tnr) / 2.0),
        "mcc": F.coalesce(mcc, F.lit(0.0)),
        "fp_plus_fn": F.col("fp") + F.col("fn"),
    }
    for tenths in betas:
        b2 = (tenths / 10) ** 2
        metrics[beta_name(tenths)] = _share((1 + b2) * tp, (1 + b2) * tp + b2 * fn + fp)
    return metrics


def _confusion(y: str, p: str, threshold: float) -> list[Column]:
    said = F.col(p) >= threshold
    yes = F.col(y) == 1
    tests = (yes & said, ~yes & said, ~yes & ~said, yes & ~said)
    return [F.count_if(t).alias(n) for t, n in zip(tests, _CONFUSION)]


def _losses(y: str, p: str) -> list[Column]:
    q, yes = clip_probability(F.col(p)), F.col(y) == 1
    return [
        F.avg(F.pow(q - F.col(y), F.lit(2.0))).alias("brier"),
        F.avg(-F.log(F.when(yes, q).otherwise(F.lit(1.0) - q))).alias("log_loss"),
    ]


def classification_metrics(df: DataFrame, y: str, p: str, threshold: float) -> DataFrame:
    """One row of threshold metrics, Brier score and log-loss."""
    counts = df.agg(*_confusion(y, p, threshold), *_losses(y, p))
    return counts.select(
        F.lit(float(threshold)).alias("threshold"), *_CONFUSION, "brier", "log_loss",
        *[c.alias(n) for n, c in confusion_metrics().items()],
    )


def ranking_metrics(df: DataFrame, y: str, p: str) -> DataFrame:
    """Tie-aware ROC area and step-wise average precision; one row."""
    counted = (
        df.groupBy(clip_probability(F.col(p)).alias("score"))
        .agg(F.count_if(F.col(y) == 1).alias("pos"), F.count_if(F.col(y) != 1).alias("neg"))
    )
    ranked = running_totals(counted, "score", ["pos", "neg"])
    pos, neg = F.col("pos").cast("double"), F.col("neg").cast("double")
    wins = pos * (F.col("neg_before") + neg / 2.0)
    hits = F.col("pos_total") - F.col("pos_before")  # positives scored at least this high
    flagged = hits + F.col("neg_total") - F.col("neg_before")
    n_pos, n_neg = F.max("pos_total"), F.max("neg_total")
    return ranked.agg(
        F.try_divide(F.sum(wins), (n_pos * n_neg).cast("double")).alias("roc_auc"),
        F.try_divide(F.sum(pos * hits / flagged), n_pos.cast("double")).alias("pr_auc"),
    )


def full_metrics(df: DataFrame, y: str, p: str, threshold: float) -> DataFrame:
    """Threshold and ranking metrics in one row."""
    ranks = ranking_metrics(df, y, p).select(F.struct("roc_auc", "pr_auc")).scalar()
    return classification_metrics(df, y, p, threshold).withColumn("_r", ranks).select("*", "_r.*").drop("_r")


# ---- thresholds ------------------------------------------------------------------------------

def threshold_bin(p: Column) -> Column:
    """Number of grid thresholds (0.10, 0.11, ... 0.90) at or below a score."""
    nearest = clamp(F.floor((p - _FIRST / 100) * 100.0 + 0.5), 0, _LAST)
    return (nearest + (p >= (nearest + _FIRST) / F.lit(100.0)).cast("int")).cast("int")


def _score(brier: Column) -> Column:
    """Selection score: fewest errors, then MCC, then Brier. Rounded so that equal choices tie."""
    return F.round(-F.col("fp_plus_fn") + F.col("mcc") - brier, 9)


def _bins_to_confusion(binned: DataFrame, by: Sequence[str]) -> DataFrame:
    """Confusion counts at every threshold from ``(by, bin, pos, neg)``; at most 82 bins per group."""
    by = list(by)
    downward = Window.partitionBy(*(by or [F.lit(0)])).orderBy(F.desc("bin")).rowsBetween(Window.unboundedPreceding, 0)
    group = Window.partitionBy(*(by or [F.lit(0)]))
    at = binned.select(
        *by, "bin",
        F.sum("pos").over(downward).alias("tp"), F.sum("neg").over(downward).alias("fp"),
        F.sum("pos").over(group).alias("_p"), F.sum("neg").over(group).alias("_n"),
    )
    return at.where(F.col("bin") > 0).select(
        *by, ((F.col("bin") + (_FIRST - 1)) / F.lit(100.0)).alias("threshold"),
        "tp", "fp", (F.col("_n") - F.col("fp")).alias("tn"), (F.col("_p") - F.col("tp")).alias("fn"),
    )


def _all_bins(counted: DataFrame, by: Sequence[str], groups: DataFrame | None = None) -> DataFrame:
    """Add empty bins, so every threshold has a row."""
    empty = (groups if groups is not None else counted.sparkSession.range(1).select()).withColumn(
        "bin", F.explode(F.sequence(F.lit(0), F.lit(_LAST + 1)))
    )
    zero = empty.withColumns({"pos": F.lit(0).cast("long"), "neg": F.lit(0).cast("long")})
    return counted.unionByName(zero).groupBy(*by, "bin").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))


def sweep_thresholds(df: DataFrame, y: str, p: str) -> DataFrame:
    """Metrics at each of the 81 grid thresholds, from one pass over the rows."""
    counted = df.groupBy(threshold_bin(F.col(p)).alias("bin")).agg(
        F.count_if(F.col(y) == 1).alias("pos"), F.count_if(F.col(y) != 1).alias("neg")
    )
    losses = df.agg(*_losses(y, p)).select(F.struct("brier", "log_loss")).scalar()
    at = _bins_to_confusion(_all_bins(counted, []), []).withColumn("_l", losses).select("*", "_l.*").drop("_l")
    scored = at.withColumns(confusion_metrics())
    return scored.withColumn("selection_score", _score(F.col("brier")))


def best_threshold(sweep: DataFrame) -> DataFrame:
    """The sweep row with the best selection score; the lowest threshold among equals."""
    return sweep.orderBy(F.desc("selection_score"), "threshold").limit(1)


# ---- blending -----------------------------------------------------------------------------------

def blended(columns: Sequence[str], weights: Sequence[float]) -> Column:
    total = F.lit(float(weights[0])) * F.col(columns[0])
    for c, w in list(zip(columns, weights))[1:]:
        total = total + F.lit(float(w)) * F.col(c)
    return total


def blend(df: DataFrame, columns: Sequence[str], weights: Sequence[float], threshold: float) -> DataFrame:
    """Append the weighted probability and the decision."""
    mixed = df.withColumn("blended", blended(columns, weights))
    return mixed.withColumn("prediction", (F.col("blended") >= threshold).cast("int"))


def weight_grid() -> list[tuple[float, float, float]]:
    """Weight triples on the 0.05 grid, each within the permitted range and summing to one."""
    steps = [i / 20 for i in K.WEIGHT_TWENTIETHS]
    low, high = K.WEIGHT_MIN - 1e-9, K.WEIGHT_MAX + 1e-9
    triples = ((a, b, 1.0 - a - b) for a in steps for b in steps)
    return [w for w in triples if min(w) >= low and max(w) <= high]


_WEIGHTS = ("weight_static", "weight_dynamic", "weight_full")


#: Score triples that meet all weights at a time.
_TRIPLES_AT_ONCE = 8_192


def _binned_blends(batches):
    """Counts and squared errors per weight triple and threshold bin of one task's ``(a, b, c, pos, neg)``; one row for each at most."""
    bins, grid = _LAST + 2, weight_grid()
    counts, squared = np.zeros((2, len(grid), bins)), np.zeros(len(grid))
    seen, unscored = False, [0, 0]
    for batch in batches:
        scored = np.ones(batch.num_rows, bool)
        for name in ("a", "b", "c"):
            scored &= np.asarray(batch.column(name).is_valid())
        a, b, c, pos, neg = (batch.column(n).to_numpy(zero_copy_only=False).astype(np.float64) for n in ("a", "b", "c", "pos", "neg"))
        unscored = [unscored[0] + int(pos[~scored].sum()), unscored[1] + int(neg[~scored].sum())]
        a, b, c, pos, neg = (v[scored] for v in (a, b, c, pos, neg))
        seen |= len(a) > 0
        for at in range(0, len(a), _TRIPLES_AT_ONCE):
            x, y, z, p, n = (v[at:at + _TRIPLES_AT_ONCE] for v in (a, b, c, pos, neg))
            for i, (u, v, w) in enumerate(grid):
                mixed = u * x + v * y + w * z
                nan = np.isnan(mixed)  # sorts above all numbers, as in the other columns' comparisons
                nearest = np.clip(np.where(nan, 0.0, np.floor((mixed - _FIRST / 100) * 100.0 + 0.5)), 0, _LAST)
                place = (nearest + ((mixed >= (nearest + _FIRST) / 100.0) | nan)).astype(np.int64)
                counts[0, i] += np.bincount(place, p, bins)
                counts[1, i] += np.bincount(place, n, bins)
                q = np.where(nan, 1.0 - K.PROBABILITY_EPS, np.clip(mixed, K.PROBABILITY_EPS, 1.0 - K.PROBABILITY_EPS))
                squared[i] += p @ ((1.0 - q) ** 2) + n @ (q * q)
    combo, place = np.nonzero(counts.sum(0))
    found, sums = counts[:, combo, place].astype(np.int64), np.zeros(len(combo))
    first = np.unique(combo, return_index=True)[1]
    sums[first] = squared[combo[first]]  # a triple's errors, with the first of its bins
    columns = [pa.array(combo, pa.int32()), pa.array(place, pa.int32()), pa.array(found[0]), pa.array(found[1]), pa.array(sums)]
    if seen:
        yield pa.RecordBatch.from_arrays(columns, _BINNED)
    if any(unscored):  # rows without a score count as rows, in no bin
        size = len(grid)
        yield pa.RecordBatch.from_arrays([
            pa.array(range(size), pa.int32()), pa.nulls(size, pa.int32()), *[pa.array([v] * size, pa.int64()) for v in unscored], pa.nulls(size, pa.float64())], _BINNED)


_BINNED = ["combo", "bin", "pos", "neg", "_sse"]


def search_weights(df: DataFrame, y: str, columns: Sequence[str]) -> DataFrame:
    """Metrics for every weight triple and threshold.

    Rows are first counted per distinct score triple. Each of those meets the 171 weight triples
    in place and is counted by threshold bin before anything is shuffled. Runs its jobs at once.
    """
    distinct = df.groupBy(*[F.col(c).cast("double").alias(n) for n, c in zip("abc", columns)]).agg(
        F.count_if(F.col(y) == 1).alias("pos"), F.count_if(F.col(y) != 1).alias("neg")
    )
    counted = distinct.mapInArrow(_binned_blends, "combo int, bin int, pos long, neg long, _sse double")
    counted = cut_lineage(df.sparkSession, counted.groupBy("combo", "bin").agg(*[F.sum(c).alias(c) for c in _BINNED[2:]]))  # read twice
    grid = F.array(*[F.struct(*[F.lit(w).alias(n) for w, n in zip(triple, _WEIGHTS)]) for triple in weight_grid()])
    binned = counted.withColumn("_w", F.get(grid, F.col("combo"))).select("_w.*", *_BINNED[1:])
    brier = binned.groupBy(*_WEIGHTS).agg((F.sum("_sse") / F.sum(F.col("pos") + F.col("neg"))).alias("brier"))
    empty = df.sparkSession.range(1).select(F.inline(grid))
    at = _bins_to_confusion(_all_bins(binned.drop("_sse"), _WEIGHTS, empty), _WEIGHTS)
    scored = at.join(brier, list(_WEIGHTS)).withColumns(confusion_metrics())
    return scored.withColumn("selection_score", _score(F.col("brier")))


def best_weights(search: DataFrame) -> DataFrame:
    """The best weight triple and threshold; the first in grid order among equals."""
    return search.orderBy(F.desc("selection_score"), *_WEIGHTS[:2], "threshold").limit(1)


def top_combinations(search: DataFrame, n: int = 10) -> DataFrame:
    """Weight and threshold combinations with the fewest errors."""
    return search.orderBy("fp_plus_fn", *_WEIGHTS[:2], "threshold").limit(n)


def evaluate_blend(
    df: DataFrame, y: str, columns: Sequence[str], weights: Sequence[float], threshold: float
) -> DataFrame:
    """All metrics of one weight triple and threshold."""
    row = full_metrics(blend(df, columns, weights, threshold), y, "blended", threshold)
    named = {n: F.lit(float(w)) for n, w in zip(_WEIGHTS, weights)}
    return row.withColumns({**named, "fbeta_default": F.col(beta_name(20))})


def backtest(df: DataFrame, y: str, p: str, threshold: float = 0.5) -> DataFrame:
    """Back-test scores, with the critical success index."""
    m = full_metrics(df, y, p, threshold)
    hits, wrong = F.col("tp"), F.col("fn") + F.col("fp")
    return m.select(
        F.col("pr_auc").alias("average_precision"), "roc_auc", F.col("fbeta_1_0").alias("f1_score"),
        "precision", "recall",
        (hits / F.greatest(F.lit(1), hits + wrong)).alias("csi"),
        (F.col("tp") + F.col("fp") + F.col("tn") + F.col("fn")).alias("events"),
    )


# ---- logs of runs -----------------------------------------------------------------------------------

def cv_summary(folds: DataFrame) -> DataFrame:
    """Mean and sample deviation per metric of ``(metric, fold, value)``; deviation 0 for a single fold."""
    return folds.groupBy("metric").agg(
        F.avg("value").alias("mean"), F.coalesce(F.stddev_samp("value"), F.lit(0.0)).alias("std")
    )


def fold_metrics(df: DataFrame, y: str, p: str, threshold: float = 0.5, fold: str = "fold") -> DataFrame:
    """Confusion metrics per fold in long form."""
    counts = df.groupBy(fold).agg(*_confusion(y, p, threshold), *_losses(y, p))
    metrics = {**confusion_metrics((10, 15, 20, 25, 30)), "brier": F.col("brier"), "log_loss": F.col("log_loss")}
    wide = counts.select(fold, *[c.cast("double").alias(n) for n, c in metrics.items()])
    return wide.unpivot([fold], list(metrics), "metric", "value")


def trial_log(trials: DataFrame, params: Sequence[str]) -> DataFrame:
    """Per trial: mean errors, MCC and Brier over its folds, and its parameters as JSON."""
    return trials.groupBy("trial_number").agg(
        F.max("objective_value").alias("objective_value"),
        F.avg("fp_plus_fn").alias("mean_fp_plus_fn"),
        F.avg("mcc").alias("mean_mcc"),
        F.avg("brier").alias("mean_brier"),
        F.to_json(F.struct(*[F.first(c).alias(c) for c in params])).alias("params"),
    )


def oof_long(df: DataFrame, columns: Sequence[str], keys: Sequence[str], y: str) -> DataFrame:
    """Calibrated out-of-fold scores, one row per model and sample."""
    return df.unpivot([*keys, y], list(columns), "model", "calibrated_proba").withColumnRenamed(y, "target")
