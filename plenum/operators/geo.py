"""Audit of geometry columns. Repair, areas and the spatial join are in :mod:`plenum.operators.shapes`."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def geometry_audit(df: DataFrame, geometry: str = "geom", srid: int = 4326) -> DataFrame:
    """Rows, missing geometries, and those that name another reference system (column ``srid``), in one row."""
    return df.agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.col(geometry).isNull()).alias("missing"), F.count_if(F.col(geometry).isNotNull() & ~F.col("srid").eqNullSafe(srid)).alias("wrong_srid"))
