"""Enrichment of event files as they arrive."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from floodframe.sources.sinks import write_half_month


def stream_enrich(
    spark: SparkSession, in_dir: str, out_dir: str, checkpoint: str, schema: str,
    enrich: Callable[[DataFrame], DataFrame], fmt: str = "parquet", day: str = "flood_start_date",
    files_per_trigger: int | None = None, name_glob: str | None = None,
) -> StreamingQuery:
    """Process the files that have arrived since the last run and stop.

    Each batch goes to ``batch_id=<n>`` under ``out_dir``, replaced as a whole if the batch is retried, so
    a batch that fails half-way leaves no duplicates and two batches never overwrite each other's months.
    """
    reader = spark.readStream.format(fmt).schema(schema)
    if fmt == "csv":
        reader = reader.option("header", True)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    if name_glob:
        reader = reader.option("pathGlobFilter", name_glob)

    def write_batch(batch: DataFrame, batch_id: int) -> None:
        write_half_month(enrich(batch), f"{out_dir}/batch_id={batch_id}", day)

    return (
        reader.load(in_dir).writeStream.foreachBatch(write_batch)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
