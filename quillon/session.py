"""A session with the settings that results and plans depend on."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: What results depend on, and what keeps plans adaptive. Sizes are left to the cluster.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.parquet.filterPushdown": "true",
    "spark.sql.parquet.inferTimestampNTZ.enabled": "true",
}


def session(master: str | None = None, **settings: str) -> SparkSession:
    """The running session, or a new one; ``settings`` are added to SETTINGS."""
    builder = SparkSession.builder.appName("quillon")
    if master:
        builder = builder.master(master)
    for name, value in (SETTINGS | settings).items():
        builder = builder.config(name, value)
    return builder.getOrCreate()
