"""Counts by time window, over a table or over a stream of files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def tumbling_counts(rows: DataFrame, time: str, key: str, width: str = "1 hour", late: str | None = None) -> DataFrame:
    """(key, h, n): rows of each key in each window; on a stream rows may come late by ``late``."""
    if late is not None:
        # a watermark needs an instant; the session's time zone is UTC, so that the clock stays the same
        rows = rows.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)
    counts = rows.groupBy(key, F.window(time, width)).agg(F.count("*").alias("n"))
    return counts.select(key, F.col("window.start").cast("timestamp_ntz").alias("h"), "n")


def stream(spark: SparkSession, folder: str, like: DataFrame, files_at_a_time: int = 1) -> DataFrame:
    """Parquet files of a folder as they come, with the columns of a table."""
    return spark.readStream.schema(like.schema).option("maxFilesPerTrigger", files_at_a_time).parquet(folder)
