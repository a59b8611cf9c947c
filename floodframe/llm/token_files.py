"""Token ids in ORC files, in document order.

Documents are dealt by ranges of their id and sorted, so a file's stripes hold ascending ids: integer run-length encoding packs the
ids, row indexes and Bloom filters on ``doc_id`` let a reader skip stripes, and stripes are read in parallel. Each row carries
the number of its range (``part``) and its place in it, so that a document's position among all ids follows from sums per range.

Defined results: a null or empty text is the end id alone; a null id sorts first; rows that repeat a document are written each, ordered
by their text's hash; an empty table gives empty files; other columns are ignored.
"""

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from floodframe.llm.tokens import encoder

OPTIONS = {"orc.bloom.filter.columns": "doc_id", "orc.bloom.filter.fpp": "0.01", "orc.create.index": "true",
           "orc.row.index.stride": "10000", "orc.stripe.size": str(64 << 20), "compression": "zstd"}


def write_tokens(docs: DataFrame, path: str, tokenizer: str) -> None:
    """Write ``part``, ``place``, ``doc_id`` and ``ids`` of ``docs(doc_id, text)`` under ``path``, replacing nothing."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    order = [F.col("doc_id"), F.xxhash64("text")]

    def run(batches):
        part, place = TaskContext.get().partitionId(), 0
        for batch in batches:
            ids = encoder(tokenizer).encode(batch.column("text").to_pylist())
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
            flat = np.concatenate(ids).astype(np.int32) if ids else np.zeros(0, np.int32)
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(n, part, np.int32)), pa.array(np.arange(place, place + n)), batch.column("doc_id"), pa.ListArray.from_arrays(offsets, flat)],
                ["part", "place", "doc_id", "ids"])
            place += n

    rows = docs.select("doc_id", "text").repartitionByRange(*order).sortWithinPartitions(*order)
    rows.mapInArrow(run, f"part int, place long, doc_id {kind}, ids array<int>").write.options(**OPTIONS).orc(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """The rows of the files."""
    return spark.read.orc(path)


def token_index(spark: SparkSession, path: str) -> DataFrame:
    """Per document, from the files: ``start`` among all ids, ``n_tokens`` and ``ids_crc32``."""
    stored = read_tokens(spark, path)
    kind = stored.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            ids = batch.column("ids")
            at, flat = ids.offsets.to_numpy(), ids.values.to_numpy().astype("<u4")
            crc = [zlib.crc32(flat[a:b].tobytes()) for a, b in zip(at[:-1], at[1:])]
            yield pa.RecordBatch.from_arrays(
                [batch.column("part"), batch.column("place"), batch.column("doc_id"), pa.array(np.diff(at).astype(np.int64)), pa.array(crc, pa.int64())],
                ["part", "place", "doc_id", "n_tokens", "ids_crc32"])

    rows = stored.mapInArrow(run, f"part int, place long, doc_id {kind}, n_tokens long, ids_crc32 long")
    # one row per range: small however large the corpus
    sums = stored.groupBy("part").agg(F.sum(F.size("ids").cast("long")).alias("n"))
    before = sums.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    own = F.sum("n_tokens").over(Window.partitionBy("part").orderBy("place")) - F.col("n_tokens")
    return rows.withColumn("own", own).join(before, "part").select("doc_id", (F.col("before") + F.col("own")).alias("start"), "n_tokens", "ids_crc32")
