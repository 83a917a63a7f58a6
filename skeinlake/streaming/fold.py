"""Structured Streaming ingest of the operation log.

Each micro-batch is appended to the raw log under its batch number; a batch
that runs again overwrites its own folder, so nothing counts twice.  Files may
arrive out of order: the state is folded by lsn and not by arrival.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..sources.store import fold


def ingest(spark: SparkSession, source: str, schema: T.StructType, target: str, files_per_batch: int = 4, every: str | None = None) -> StreamingQuery:
    """Follow a folder of log files; without ``every`` take what is there and stop."""
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(source)

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{target}/log/batch={number}")

    out = stream.writeStream.foreachBatch(write).option("checkpointLocation", f"{target}/progress")
    return (out.trigger(processingTime=every) if every else out.trigger(availableNow=True)).start()


def state(spark: SparkSession, target: str, attrs: list[str]) -> DataFrame:
    return fold(spark.read.parquet(f"{target}/log").drop("batch"), attrs)
