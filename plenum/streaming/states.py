"""Structured Streaming forms of the incremental operators."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def windowed_counts(events: DataFrame, time: str, keys: list[str], width: str, lateness: str, slide: str | None = None) -> DataFrame:
    """Counts of tumbling (or sliding) event-time windows; rows later than ``lateness`` after the newest are dropped."""
    window = F.window(time, width, slide) if slide else F.window(time, width)
    counted = events.withWatermark(time, lateness).groupBy(window.alias("w"), *keys).agg(F.count(F.lit(1)).alias("n"))
    return counted.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *keys, "n")


def sessions(events: DataFrame, time: str, key: str, gap: str, lateness: str) -> DataFrame:
    """Sessions of a key that end when nothing comes for ``gap``."""
    grouped = events.withWatermark(time, lateness).groupBy(key, F.session_window(time, gap).alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return grouped.select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def unseen(rows: DataFrame, key: list[str], time: str, lateness: str) -> DataFrame:
    """Rows whose key was not seen within the watermark: the feed reader's set difference."""
    return rows.withWatermark(time, lateness).dropDuplicatesWithinWatermark(key)


def moved_rows(rows: DataFrame) -> DataFrame:
    """Changes of a stream of (``key``, ``fingerprint``): a key is new once, then moves when its fingerprint differs from the last."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        out = []
        for batch in batches:
            for mark in batch["fingerprint"]:
                if mark != last:
                    out.append((key[0], "new" if last is None else "moved", mark))
                    last = mark
        state.update((last,))
        yield pd.DataFrame(out, columns=["key", "change", "fingerprint"])

    shape = "key string, change string, fingerprint string"
    return rows.groupBy("key").applyInPandasWithState(step, shape, "last string", "append", GroupStateTimeout.NoTimeout)


def desired_states(intents: DataFrame) -> DataFrame:
    """Accepted intents of a stream of (``key``, ``generation``, ``version``).

    An intent is accepted if its generation is newer than the key's and its
    version differs; so stragglers change nothing and A, B, A opens A again.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        generation, version = state.get if state.exists else (-1, None)
        rows = pd.concat(list(batches)).sort_values("generation")
        out = []
        for g, v in zip(rows["generation"], rows["version"]):
            if g > generation:
                if v != version:
                    out.append((key[0], int(g), v))
                generation, version = int(g), v
        state.update((generation, version))
        yield pd.DataFrame(out, columns=["key", "generation", "version"])

    shape = "key string, generation long, version string"
    return intents.groupBy("key").applyInPandasWithState(step, shape, "generation long, version string", "append", GroupStateTimeout.NoTimeout)


def leases(heartbeats: DataFrame, minutes: int, most: int = 3) -> DataFrame:
    """Jobs whose heartbeats (``job``, ``at``) stop: reclaimed after ``minutes`` of event time, dead at the third time."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        failures = state.get[0] if state.exists else 0
        if state.hasTimedOut:
            failures += 1
            yield pd.DataFrame({"job": [key[0]], "failures": [failures], "status": ["dead_letter" if failures >= most else "pending"]})
            if failures >= most:
                state.remove()
            else:
                state.update((failures,))
            return
        newest = max(b["at"].max() for b in batches)
        state.update((failures,))
        due = int(newest.timestamp() * 1000) + minutes * 60_000
        state.setTimeoutTimestamp(max(due, state.getCurrentWatermarkMs() + 1))

    timed = heartbeats.withWatermark("at", "0 seconds")
    return timed.groupBy("job").applyInPandasWithState(step, "job string, failures int, status string", "failures int", "append", GroupStateTimeout.EventTimeTimeout)


def merge_batches(stream: DataFrame, path: str, key: str, generation: str, checkpoint: str, buckets: int = 64):
    """Keep the newest row of each key under ``path``, in buckets of the key's hash.

    A micro-batch is merged into the buckets that it touches only, each written as
    a new version; the others stay. Versions are named by batch id, so a batch that
    is run again writes the same place. :func:`merged` reads the newest of each bucket.
    """
    from plenum.operators.incremental import compact

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        rows = batch.withColumn("bucket", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")).persist()
        touched = [r[0] for r in rows.select("bucket").distinct().collect()]  # at most ``buckets`` numbers
        for n in touched:
            before = latest_version(spark, f"{path}/bucket={n}", batch_id)
            mine = rows.where(F.col("bucket") == n).select(*batch.columns)
            every = mine if before is None else mine.unionByName(spark.read.schema(batch.schema).parquet(before))
            compact(every, key, generation).select(*batch.columns).write.mode("overwrite").parquet(f"{path}/bucket={n}/version={batch_id:012d}")
        rows.unpersist()

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).outputMode("append")


def merged(spark, path: str, schema, buckets: int = 64) -> DataFrame:
    """The newest complete version of every bucket that :func:`merge_batches` wrote."""
    found = [v for n in range(buckets) if (v := latest_version(spark, f"{path}/bucket={n}"))]
    return spark.read.schema(schema).parquet(*found) if found else spark.createDataFrame([], schema)


def latest_version(spark, path: str, before: int | None = None) -> str | None:
    """Newest complete version folder (with its success marker) under ``path``, earlier than ``before`` if given."""
    jvm = spark._jvm
    root = jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(root):
        return None
    found = []
    for status in fs.listStatus(root):
        name = status.getPath().getName()
        number = int(name.split("=")[1]) if name.startswith("version=") else -1
        if number >= 0 and (before is None or number < before) and fs.exists(jvm.org.apache.hadoop.fs.Path(status.getPath(), "_SUCCESS")):
            found.append((number, status.getPath().toString()))
    return max(found)[1] if found else None


def recount_changed(batch: DataFrame, votes: DataFrame, member: str) -> DataFrame:
    """Counts of only the members a micro-batch touches: the set-wise form of a counter trigger."""
    touched = batch.select(member).distinct()
    return votes.join(touched, member, "left_semi").groupBy(member).agg(F.count(F.lit(1)).alias("votes"))


def expired(time: Column, now: Column, days: int) -> Column:
    """True for rows past their retention."""
    return time < now - F.expr(f"interval {days} days")
