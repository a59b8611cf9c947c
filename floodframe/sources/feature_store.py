"""Feature tables cached under a hash of their identifiers."""

from collections.abc import Callable, Mapping, Sequence
from hashlib import sha256

from pyspark.sql import DataFrame, SparkSession


def feature_key(key: Mapping[str, object]) -> str:
    """Sixteen hex digits for a set of identifiers, whatever their order."""
    text = ",".join(f"{name}={key[name]}" for name in sorted(key))
    return sha256(text.encode()).hexdigest()[:16]


def feature_path(key: Mapping[str, object], folder: str) -> str:
    return f"{folder.rstrip('/')}/{feature_key(key)}.parquet"


def save_features(df: DataFrame, key: Mapping[str, object], folder: str) -> str:
    path = feature_path(key, folder)
    df.write.mode("overwrite").option("partitionOverwriteMode", "static").parquet(path)
    return path


def has_features(spark: SparkSession, key: Mapping[str, object], folder: str) -> bool:
    """Whether a finished table is stored under the key."""
    marker = spark._jvm.org.apache.hadoop.fs.Path(feature_path(key, folder) + "/_SUCCESS")
    return marker.getFileSystem(spark._jsc.hadoopConfiguration()).exists(marker)


def load_features(spark: SparkSession, key: Mapping[str, object], folder: str) -> DataFrame | None:
    return spark.read.parquet(feature_path(key, folder)) if has_features(spark, key, folder) else None


def load_or_compute(
    spark: SparkSession, key: Mapping[str, object], df: DataFrame, compute: Callable[[DataFrame], DataFrame],
    folder: str, on: Sequence[str],
) -> DataFrame:
    """Features of every row of ``df``, computing only rows whose ``on`` columns the cached table lacks.

    New rows are appended to the cache. Runs a look-up job, and the computation where something is missing.
    """
    cached, on = load_features(spark, key, folder), list(on)
    if cached is None:
        save_features(compute(df), key, folder)
    else:
        missing = df.join(cached.select(*on).distinct(), on, "left_anti")
        if not missing.isEmpty():
            compute(missing).write.mode("append").parquet(feature_path(key, folder))
    return load_features(spark, key, folder).join(df.select(*on).distinct(), on, "left_semi")
