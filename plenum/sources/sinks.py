"""Sinks: GeoJSON features, telemetry and age-gated snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

COVERAGE = ["matter", "item", "monolithic", "synced", "pending"]


def coverage_tier(counts: dict[str, Column]) -> Column:
    """First tier with a count above zero; pending if none has."""
    out = F.lit("pending")
    for tier in reversed(COVERAGE[:-1]):
        if tier in counts:
            out = F.when(F.coalesce(counts[tier], F.lit(0)) > 0, tier).otherwise(out)
    return out


def features(rows: DataFrame, geometry: str, properties: list[str]) -> DataFrame:
    """One GeoJSON feature a row as text; ``geometry`` holds GeoJSON already."""
    head = F.concat(F.lit('{"type":"Feature","geometry":'), F.coalesce(geometry, F.lit("null")), F.lit(',"properties":'))
    return rows.select(F.concat(head, F.to_json(F.struct(*properties)), F.lit("}")).alias("value"))


def write_features(rows: DataFrame, geometry: str, properties: list[str], path: str) -> None:
    """Features as line-delimited GeoJSON, the form that tile builders read in parallel."""
    features(rows, geometry, properties).write.mode("overwrite").text(path)


def telemetry(parts: dict[str, DataFrame]) -> DataFrame:
    """Grouped results as rows (``part``, ``row`` as JSON) of one snapshot."""
    out = None
    for name, df in parts.items():
        rows = df.select(F.lit(name).alias("part"), F.to_json(F.struct("*")).alias("row"))
        out = rows if out is None else out.unionByName(rows)
    assert out is not None, "no parts"
    return out


def snapshot(spark: SparkSession, path: str, compute, now, least_age_seconds: int = 3600) -> DataFrame:
    """The stored snapshot if it is younger than the age, else a new one, appended with its time (``computed_at``)."""
    from py4j.protocol import Py4JError
    from pyspark.errors import AnalysisException

    stamp = F.lit(now).cast("timestamp")
    try:
        stored = spark.read.parquet(path)
        newest = stored.agg(F.max("computed_at").alias("t"))
        fresh = newest.where(F.unix_seconds(stamp) - F.unix_seconds("t") < least_age_seconds)
        if fresh.count():
            return stored.join(F.broadcast(newest), F.col("computed_at") == F.col("t")).drop("t")
    except (AnalysisException, Py4JError):
        pass  # nothing stored yet
    compute().withColumn("computed_at", stamp).write.mode("append").parquet(path)
    return spark.read.parquet(path).where(F.col("computed_at") == stamp)
