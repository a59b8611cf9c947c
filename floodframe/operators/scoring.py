"""Risk columns, priorities and report tables."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from floodframe import constants as K
from floodframe.functions.numbers import clamp
from floodframe.functions.risk import action_trigger
from floodframe.operators.cleaning import sample_rows
from floodframe.operators.metrics import blended
from floodframe.operators.ranking import exact_quantiles


def risk_columns(
    df: DataFrame, columns: Sequence[str], weights: Sequence[float], threshold: float, half_width: Column | None = None
) -> DataFrame:
    """Blend calibrated probabilities into score, interval, uncertainty and class."""
    p = blended(columns, weights)
    spread = F.lit(0.0) if half_width is None else half_width
    return df.withColumn("Risk_Probability", p).withColumns({
        "Final_Risk_Score": F.col("Risk_Probability"),
        "Risk_Lower_90": clamp(F.col("Risk_Probability") - spread, low=0.0),
        "Risk_Upper_90": clamp(F.col("Risk_Probability") + spread, high=1.0),
        "Uncertainty": spread,
        "Prediction": (F.col("Risk_Probability") >= threshold).cast("int"),
    })


def interval_width(df: DataFrame) -> Column:
    if {"Risk_Lower_90", "Risk_Upper_90"} <= set(df.columns):
        return F.col("Risk_Upper_90") - F.col("Risk_Lower_90")
    return F.col("Uncertainty").cast("double")


def operational_priority(df: DataFrame, threshold: float = 0.5, probability: str = "Final_Risk_Score", rules=K.ACTION_RULES) -> DataFrame:
    """Priority from probability and interval width against the width terciles, and the action it triggers."""
    wide = df.withColumn("_width", interval_width(df))
    q = exact_quantiles(wide, ["_width"], [1 / 3, 2 / 3])
    enough = F.max("n") > 0
    cuts = q.agg(F.struct(*[
        F.coalesce(F.when(enough, F.max(f"q{i}")), F.lit(d)).alias(n)
        for i, (n, d) in enumerate(zip(("low", "high"), K.PRIORITY_WIDTH_DEFAULTS))
    ])).scalar()
    p, w = F.col(probability), F.col("_width")
    label = (
        F.when((p >= threshold) & (w < F.col("_cut.low")), "High risk (confident)")
        .when((p >= threshold) & (w >= F.col("_cut.low")), "High risk (uncertain)")
        .when((p < threshold) & (w >= F.col("_cut.high")), "Investigate (uncertain)")
        .otherwise("Low risk (confident)")
    )
    return wide.withColumn("_cut", cuts).withColumns({
        "Operational_Priority": label, "Action_Trigger": action_trigger(p, w, rules),
    }).drop("_width", "_cut")


def report_summary(df: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Headline figures of a scored region; one row."""
    score, present = F.col("Final_Risk_Score"), set(df.columns)
    average = lambda c: F.avg(c) if c in present else F.lit(None).cast("double")
    row = df.agg(
        F.avg(score).alias("avg_risk_score"),
        F.max(score).alias("max_risk_score"),
        average("Risk_Lower_90").alias("avg_risk_lower_90"),
        average("Risk_Upper_90").alias("avg_risk_upper_90"),
        F.avg(interval_width(df)).alias("avg_uncertainty"),
        (F.avg((score >= threshold).cast("int")) * 100).alias("high_risk_area_pct"),
    ).withColumn("operating_threshold", F.lit(float(threshold)))
    return row.withColumn("dominant_land_cover", _dominant(df) if "Land_Cover_Type" in present else F.lit("N/A"))


def _dominant(df: DataFrame) -> Column:
    counted = df.where("Land_Cover_Type IS NOT NULL").groupBy("Land_Cover_Type").agg(F.count(F.lit(1)).alias("n"))
    return counted.agg(F.min_by("Land_Cover_Type", F.struct(-F.col("n"), F.col("Land_Cover_Type")))).scalar()


def shares(df: DataFrame, column: str) -> DataFrame:
    """Share of rows per value."""
    total = df.where(F.col(column).isNotNull()).agg(F.count(F.lit(1))).scalar()
    counted = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    return counted.select(column, (F.col("n") / total).alias("share"))


def global_importance(df: DataFrame, vector: str, names: Sequence[str] | None = None) -> DataFrame:
    """Mean absolute attribution per position, largest first."""
    name = F.element_at(F.array(*[F.lit(n) for n in names]), F.col("pos") + 1) if names else F.concat(F.lit("f"), F.col("pos"))
    return (
        df.where(F.col(vector).isNotNull()).select(F.posexplode(vector).alias("pos", "v"))
        .groupBy("pos").agg(F.avg(F.abs(F.col("v").cast("double"))).alias("importance"))
        .select(name.alias("feature"), "importance")
        .orderBy(F.desc("importance"), "feature")
    )


def binned_curve(df: DataFrame, x: str, y: str = "Final_Risk_Score", bins: int = 19) -> DataFrame:
    """Mean of ``y`` in equal-width bins of ``x`` between its 1st and 99th percentile; empty bins have a null mean."""
    q = exact_quantiles(df, [x], [0.01, 0.99]).agg(F.struct(F.max("q0").alias("lo"), F.max("q1").alias("hi"))).scalar()
    keyed = df.select(F.col(x).cast("double").alias("_x"), F.col(y).alias("_y")).withColumn("_q", q)
    width = (F.col("_q.hi") - F.col("_q.lo")) / bins
    number = F.greatest(F.ceil(F.try_divide(F.col("_x") - F.col("_q.lo"), width)), F.lit(1))
    means = (
        keyed.where(F.col("_x").between(F.col("_q.lo"), F.col("_q.hi")))
        .groupBy(F.least(number, F.lit(bins)).alias("bin")).agg(F.avg("_y").alias("mean_score"), F.count(F.lit(1)).alias("n"))
    )
    every = df.sparkSession.range(1, bins + 1).select(F.col("id").alias("bin")).withColumn("_q", q)
    centre = F.col("_q.lo") + (F.col("bin") - 0.5) * width
    return every.withColumn("centre", centre).join(means, "bin", "left").select(
        "bin", "centre", "mean_score", F.coalesce("n", F.lit(0)).alias("n")
    )


def histogram(df: DataFrame, value: Column, bins: int = 20, low: float = 0.0, high: float = 1.0) -> DataFrame:
    """Rows per equal-width bin; the last bin includes its upper edge."""
    number = F.floor((value - low) / ((high - low) / bins))
    return (
        df.where(value.between(low, high))
        .groupBy(F.least(number, F.lit(bins - 1)).alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    )


def width_histogram(df: DataFrame, bins: int = 20, high: float = 1.0) -> DataFrame:
    """Histogram of interval widths, negative ones counting as 0."""
    return histogram(df, clamp(interval_width(df), low=0.0), bins, 0.0, high)


def map_points(df: DataFrame, key: str, n: int | None = None, seed: int = K.SEED) -> DataFrame:
    """Map feed: all scored points, or a repeatable sample of ``n``, with the centre of all of them."""
    centre = df.agg(F.struct(F.avg("latitude").alias("centre_lat"), F.avg("longitude").alias("centre_lon"))).scalar()
    chosen = df if n is None else sample_rows(df, n, key, seed)
    return chosen.withColumn("_c", centre).select("*", "_c.*").drop("_c")


def coverage(df: DataFrame, requested: int, minimum: float = K.MIN_COVERAGE_RATIO) -> DataFrame:
    """Rows asked for and returned, their ratio, and whether it is below the minimum."""
    ratio = F.col("returned") / max(1, requested)
    return df.agg(F.count(F.lit(1)).alias("returned")).select(
        F.lit(int(requested)).alias("requested"), "returned",
        ratio.alias("coverage_ratio"), (ratio < minimum).alias("low_coverage"),
    )
