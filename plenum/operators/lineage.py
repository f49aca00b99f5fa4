"""Lineage cuts for jobs of several passes."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame


def settled(df: DataFrame) -> DataFrame:
    """``df`` computed once, by a reliable checkpoint in the folder that ``spark.checkpoint.dir`` names.

    Only a session on one machine may do without the setting and gets a temporary
    folder; on a cluster without it this raises.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="plenum-checkpoint-"))
    return df.checkpoint(eager=True)
