"""Incremental ingestion by Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery


def ingest(spark: SparkSession, folder: str, schema: str, key: str, checkpoint: str, sink: Callable[[DataFrame, int], None]) -> StreamingQuery:
    """New parquet files of a folder, one row a key and batch, to ``sink``; ends when all are read."""
    s = spark.readStream.schema(schema).parquet(folder)
    once = lambda df, n: sink(df.dropDuplicates([key]), n)
    return s.writeStream.foreachBatch(once).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
