"""Structured Streaming forms of the job, ingest and review flows.

Windows and watermarks are extensions; the flows themselves also exist as batch operators, and both give the same states.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronotile.operators.review import latest


def file_stream(spark: SparkSession, path: str, schema) -> DataFrame:
    """ST4: new Parquet files of a folder as a stream."""
    return spark.readStream.schema(schema).parquet(path)


def new_paths(stream: DataFrame, delay: str = "1 day") -> DataFrame:
    """ST4: each path once; the state of older ones is dropped by the watermark on ``ts``."""
    return stream.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay).dropDuplicatesWithinWatermark(["path"])


def counts_by_window(stream: DataFrame, size: str = "1 hour", delay: str = "10 minutes") -> DataFrame:
    """Events and their value by type in tumbling windows; rows later than the watermark are dropped."""
    timed = stream.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay)
    return timed.groupBy(F.window("ts", size), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("value")).select(F.col("window.start").alias("start"), "event_type", "n", "value")


def keep_latest(path: str):
    """ST5, ST2: a ``foreachBatch`` function that appends each batch to the log at ``path``, once per batch id.

    A batch that is run again after a failure overwrites its own folder, so the log holds it once. ``read_latest`` gives the states.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return write


def read_latest(spark: SparkSession, path: str) -> DataFrame:
    """States of all regions from the log that ``keep_latest`` wrote."""
    return latest(spark.read.parquet(path).drop("batch"))
