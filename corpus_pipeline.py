"""Training-corpus pipeline: quality, near duplicates, repeated passages, decontamination, packing.

Each stage takes ``(spark, docs, sf_dir)`` and works on all rows its predecessor kept; all but the last return the columns of ``docs``.
Defined results: a null id takes no part in duplicate search and is kept; rows that repeat an id leave the second stage as one; a text is
null or empty throughout if it was; an empty table stays empty; extra columns ride along up to the last stage, whatever their names.
"""

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from floodframe.llm import classifier, decontaminate, neardup, packing, passages
from floodframe.llm.common import bounded, prepare, scratch_path, table

#: Words of a shingle of the near-duplicate stage.
SHINGLE = 5


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents the quality classifier accepts."""
    prepare(spark)
    return classifier.accepted(docs, classifier.fit(docs, table(spark, sf_dir, "labels")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group, by five-word shingles."""
    prepare(spark)
    return neardup.one_of_each(docs, SHINGLE)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages an earlier document holds."""
    prepare(spark)
    return passages.without_repeats(docs, passages.repeated_passages(docs))


def benchmark_free(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item occurs."""
    prepare(spark)
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the remaining documents in training sequences."""
    prepare(spark)
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("benchmark_free", benchmark_free),
    ("pack", pack),
]

#: Learned scores, sketches and tokenizers have no SQL form; the stages are tested one by one against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
