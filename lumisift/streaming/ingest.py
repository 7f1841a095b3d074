"""Resumable ingestion: a stream over a folder of new files, each handled once.

The checkpoint records which files are done, so a restart goes on where it stopped; each batch is
written under its number, so that a batch that is repeated after a failure replaces itself.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery


def ingest(spark: SparkSession, source: str, schema: str, out: str, checkpoint: str, transform: Callable[[DataFrame], DataFrame], kind: str = "parquet", files_per_batch: int = 1000) -> StreamingQuery:
    """Handles the files that are there and ends."""

    def write(batch: DataFrame, number: int) -> None:
        transform(batch).write.mode("overwrite").parquet(f"{out}/batch={number}")

    rows = spark.readStream.format(kind).schema(schema).option("maxFilesPerTrigger", files_per_batch).load(source)
    return rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
