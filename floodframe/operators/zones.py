"""Density clusters on standardised coordinates, and risk zones."""

from collections.abc import Sequence
from itertools import product

from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame, Window, functions as F

from floodframe import constants as K
from floodframe.operators.ranking import exact_quantiles
from floodframe.session import cut_lineage


def standardised(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Append ``_z0, _z1, ...``: columns centred and divided by their population deviation (1 if zero)."""
    stats = df.agg(F.struct(*[
        F.struct(F.avg(c).alias("m"), F.coalesce(F.nullif(F.stddev_pop(c), F.lit(0.0)), F.lit(1.0)).alias("s")).alias(c)
        for c in columns
    ])).scalar()
    z = {f"_z{i}": (F.col(c) - F.col(f"_stats.{c}.m")) / F.col(f"_stats.{c}.s") for i, c in enumerate(columns)}
    return df.withColumn("_stats", stats).withColumns(z).drop("_stats")


def connected_components(edges: DataFrame, vertices: DataFrame) -> DataFrame:
    """``(v, label)`` with the smallest vertex of each component as label.

    Each round takes the smallest label among neighbours and then follows labels to their own
    labels, so long chains close in few rounds. Runs until nothing changes.
    """
    spark = vertices.sparkSession
    edges = cut_lineage(spark, edges.select("src", "dst"))
    labels = cut_lineage(spark, vertices.select("v", F.col("v").alias("label")))
    while True:
        best = edges.join(labels, edges["dst"] == labels["v"]).groupBy("src").agg(F.min("label").alias("near"))
        hooked = labels.join(best, labels["v"] == best["src"], "left").select(
            "v", F.least("label", F.coalesce("near", "label")).alias("label"), F.col("label").alias("old")
        )
        hooked = cut_lineage(spark, hooked)
        parent = hooked.select(F.col("v").alias("_p"), F.col("label").alias("_root"))
        jumped = cut_lineage(spark, hooked.join(parent, hooked["label"] == parent["_p"]).select("v", "old", F.col("_root").alias("label")))
        labels = jumped.select("v", "label")
        if jumped.where(F.col("label") != F.col("old")).isEmpty():
            return labels


def density_clusters(
    df: DataFrame, columns: Sequence[str], eps: float = 0.25, min_samples: int = 5, min_cluster_size: int = 20,
    output: str = "spatial_cluster",
) -> DataFrame:
    """Append a cluster number, -1 for noise.

    Standardised space is cut into cells of width ``eps``; cells with ``min_samples`` rows are
    dense, touching dense cells form a cluster, clusters below ``min_cluster_size`` are noise. Only
    cells, not rows, enter the iteration.
    """
    axes = [f"_i{i}" for i in range(len(columns))]
    cell = F.struct(*axes)
    keyed = standardised(df, columns).withColumns({a: F.floor(F.col(f"_z{i}") / eps) for i, a in enumerate(axes)})
    keyed = keyed.drop(*[f"_z{i}" for i in range(len(columns))])
    dense = keyed.groupBy(*axes).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_samples)
    dense = cut_lineage(df.sparkSession, dense)
    moves = [m for m in product((-1, 0, 1), repeat=len(axes)) if any(m)]
    shift = F.explode(F.array(*[F.struct(*[F.lit(d).cast("long").alias(a) for d, a in zip(m, axes)]) for m in moves]))
    beside = dense.withColumn("_m", shift).select(
        cell.alias("src"), F.struct(*[(F.col(a) + F.col(f"_m.{a}")).alias(a) for a in axes]).alias("dst")
    )
    vertices = dense.select(cell.alias("v"), "n")
    edges = beside.join(vertices.select(F.col("v").alias("dst")), "dst")
    labels = connected_components(edges, vertices)
    sizes = labels.join(vertices, "v").groupBy("label").agg(F.sum("n").alias("size")).where(F.col("size") >= min_cluster_size)
    numbered = sizes.select("label", (F.dense_rank().over(Window.orderBy("label")) - 1).alias(output))  # clusters only
    by_cell = labels.join(numbered, "label").select(*[F.col(f"v.{a}").alias(a) for a in axes], output)
    return keyed.join(by_cell, axes, "left").withColumn(output, F.coalesce(output, F.lit(-1))).drop(*axes)


def spatial_clusters(
    df: DataFrame, eps: float = 0.25, min_samples: int = 5, min_cluster_size: int = 20,
    method: str = "density", k: int = 10, seed: int = K.SEED,
) -> DataFrame:
    """Clusters of places for spatial cross-validation, numbered from 0.

    ``density`` puts noise, if there is any, first; data without a dense cell are one cluster of noise. ``kmeans`` makes ``k`` clusters
    on standardised coordinates, for data known to have no dense places. Runs jobs at once.
    """
    if method == "kmeans":
        z = standardised(df, ["latitude", "longitude"])
        vectors = VectorAssembler(inputCols=["_z0", "_z1"], outputCol="_vector").transform(z)
        model = KMeans(k=k, seed=seed, featuresCol="_vector", predictionCol="spatial_cluster").fit(vectors)
        return model.transform(vectors).drop("_vector", "_z0", "_z1")
    if method != "density":
        raise ValueError(f"unknown method {method!r}")
    clustered = cut_lineage(df.sparkSession, density_clusters(df, ["latitude", "longitude"], eps, min_samples, min_cluster_size))
    least = clustered.agg(F.min("spatial_cluster")).scalar()
    return clustered.withColumn("spatial_cluster", F.col("spatial_cluster") + F.when(least == -1, 1).otherwise(0))


def name_zones(df: DataFrame, cluster: str = "Risk_Cluster", score: str = "Final_Risk_Score") -> DataFrame:
    """Zone names from the cluster's median score against the thirds of all cluster medians."""
    medians = exact_quantiles(df.where(F.col(cluster) != -1), [score], [0.5], [cluster]).select(cluster, F.col("q0").alias("_median"))
    low, high = K.ZONE_QUANTILES
    cuts = medians.agg(F.percentile("_median", F.array(F.lit(low), F.lit(high)))).scalar()
    name = (
        F.when(F.col("_cuts").isNull(), "Uncategorized")
        .when(F.col(cluster) == -1, "Outlier/Noise")
        .when(F.col("_median").isNull(), "Uncategorized")
        .when(F.col("_median") >= F.col("_cuts")[1], "High-Risk Zone")
        .when(F.col("_median") >= F.col("_cuts")[0], "Moderate-Risk Zone")
        .otherwise("Low-Risk Zone")
    )
    return df.join(medians, cluster, "left").withColumn("_cuts", cuts).withColumn("Risk_Zone", name).drop("_cuts", "_median")


def risk_zones(
    df: DataFrame, eps: float = 0.25, min_samples: int = 5, min_cluster_size: int = 10, score: str = "Final_Risk_Score"
) -> DataFrame:
    """Append ``Risk_Cluster`` and ``Risk_Zone``, clustering on place and score. Runs jobs at once."""
    clustered = density_clusters(
        df, ["latitude", "longitude", score], eps, min_samples, min_cluster_size, "Risk_Cluster"
    )
    return name_zones(clustered, "Risk_Cluster", score)
