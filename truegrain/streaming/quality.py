"""Structured Streaming forms (R1-R6): batches, windowed quality, duplicates."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery


def read_files(spark: SparkSession, path: str, schema: T.StructType, kind: str = "parquet", files_per_trigger: int | None = None, **options: str) -> DataFrame:
    """Files as they come."""
    reader = spark.readStream.format(kind).schema(schema).options(**options)
    return (reader.option("maxFilesPerTrigger", files_per_trigger) if files_per_trigger else reader).load(path)


def batches(df: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """``handle`` gets every micro-batch; a batch that was begun when
    the driver failed comes again under the same number."""
    return df.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def window_quality(events: DataFrame, time: str, value: Column, low: float, high: float, window: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Rows, missing and out-of-range values per event-time window; on a stream,
    windows close when the watermark passes them.  Partial sums are made before
    the shuffle, so a window with a third of all rows is no single task's work."""
    df = events.withColumn("_t", F.col(time).cast("timestamp"))
    df = df.withWatermark("_t", late) if df.isStreaming else df
    out = df.groupBy(F.window("_t", window).alias("w")).agg(
        F.count("*").alias("rows"), F.sum(value.isNull().cast("long")).alias("nulls"), F.sum(F.coalesce((value < low) | (value > high), F.lit(False)).cast("long")).alias("out_of_range"),
    )
    return out.select(F.col("w.start").cast("timestamp_ntz").alias("window_start"), "rows", "nulls", "out_of_range")


def deduplicated(events: DataFrame, keys: list[str], time: str, late: str = "1 hour") -> DataFrame:
    """The first row of each key within the watermark; state is bounded
    by the keys of that span."""
    df = events.withColumn("_t", F.col(time).cast("timestamp"))
    df = df.withWatermark("_t", late).dropDuplicatesWithinWatermark(keys) if df.isStreaming else df.dropDuplicates(keys)
    return df.drop("_t")


def duplicate_counts(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys of more than one row, by partially aggregated counts."""
    return df.groupBy(*keys).agg(F.count("*").alias("count")).where("count > 1")


def run_to_table(df: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """All that is there now, through the stream, as a table in memory (tests)."""
    query = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()
    return df.sparkSession.table(name)
