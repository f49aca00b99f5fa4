"""Session factory: UTC, ANSI, adaptive execution, and partitions sized for the input."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(app: str = "plenum", master: str | None = None, **conf: str) -> SparkSession:
    """A session whose physical choices are left to adaptive execution.

    Shuffles start wide and are coalesced at run time; skewed join partitions are
    split; scans take 128 MB a task. Settings given by keyword (dots written as
    double underscores) or by the cluster win.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.ansi.enabled": "true",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.files.maxPartitionBytes": "128m",
        "spark.sql.parquet.filterPushdown": "true",
    }
    for key, value in {**defaults, **{k.replace("__", "."): v for k, v in conf.items()}}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
