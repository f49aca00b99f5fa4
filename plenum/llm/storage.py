"""Shared-storage helpers: lineage cuts that survive the loss of executors."""

from __future__ import annotations

import gc
import tempfile
import time
import uuid

from pyspark.sql import DataFrame, SparkSession

_written: dict[str, list[str]] = {}  # folders by application, for release()


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors and the driver share.

    It is the one the cluster names in ``spark.checkpoint.dir``. Only a session
    that runs on one machine may do without: it gets a temporary folder. On a
    cluster without the setting this raises, for executors don't see the driver's folders.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    if sc.getCheckpointDir() is None:
        if not named and not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="plenum-checkpoint-"))
    return (named or sc.getCheckpointDir()).rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared folder by a reliable checkpoint."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def fresh_path(spark: SparkSession, name: str) -> str:
    """A folder for one table or archive in the shared folder; :func:`release` removes it."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _written.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet in the shared folder and read again: compressed and column-prunable."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Remove the folder of a table from :func:`written` that nothing reads any more."""
    spark = df.sparkSession
    paths = _written.get(spark.sparkContext.applicationId, [])
    for folder in {file.rsplit("/", 1)[0].rsplit("/", 1)[1] for file in df.inputFiles()}:
        for name in [x for x in paths if x.endswith(f"/{folder}")]:
            path = spark._jvm.org.apache.hadoop.fs.Path(name)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
            paths.remove(name)


def release(spark: SparkSession) -> int:
    """Remove the intermediate folders of this application and return how many there were.

    Results of operators read them until they are saved, so call it after that.
    (Checkpoints are Spark's own: ``spark.cleaner.referenceTracking.cleanCheckpoints`` removes those.)
    """
    paths = _written.pop(spark.sparkContext.applicationId, [])
    jvm, conf = spark._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for name in paths:
        path = jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(conf).delete(path, True)
    return len(paths)


def drop_shuffles(spark: SparkSession) -> None:
    """Have Spark remove the shuffle files of plans that nothing refers to any more.

    Its cleaner follows the driver's garbage collection, which on a driver with
    memory to spare comes too late for steps that each shuffle the corpus. The
    plan of the step before is let go by the first collection, its shuffles by the second,
    or the third if its last events were still on their way to listeners.
    """
    gc.collect()
    for _ in range(3):
        spark._jvm.System.gc()
        time.sleep(0.5)


def shuffle_width(spark: SparkSession, rows: int, per_task: int) -> int:
    """Partitions for ``rows``: the session's setting, or more if a task would get over ``per_task`` rows."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // per_task))
