"""Minute statistics over a stream of finished downloads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..operators.stats import minute_stats


def downloads_stream(spark: SparkSession, path: str, schema: T.StructType, files_per_trigger: int = 1) -> DataFrame:
    """A stream over a folder of Parquet files of downloads."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def stream_minute_stats(downloads: DataFrame, ts: str = "ts", late: str = "2 minutes", **columns: str) -> DataFrame:
    """The windows of ``minute_stats`` as a streaming aggregate; rows later than ``late`` are dropped."""
    timed = downloads.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)
    return minute_stats(timed, ts, **columns)


def run_to_table(stats: DataFrame, name: str, checkpoint: str, mode: str = "update") -> StreamingQuery:
    """Process all that is there into an in-memory table (for tests and small inputs)."""
    query = stats.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query
