"""Streams over the append-only log: exactly-once appends and windowed counts. An extension: batch logs need none of it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType


def file_stream(spark: SparkSession, path: str, schema: StructType, files_per_batch: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def windowed_counts(events: DataFrame, time: str, kind: str, width: str, late: str) -> DataFrame:
    """Tumbling windows per kind; rows later than the watermark are dropped once their window is closed."""
    return (
        events.withWatermark(time, late).groupBy(F.window(time, width), kind)
        .agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), kind, "n", "total")
    )


def append_once(events: DataFrame, target: str, checkpoint: str, key: str) -> StreamingQuery:
    """Append to a Parquet log; a batch that is retried after a failure overwrites itself (its id is its partition)."""

    def write(batch: DataFrame, number: int) -> None:
        batch.dropDuplicates([key]).write.mode("overwrite").parquet(f"{target}/batch={number}")

    return events.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
