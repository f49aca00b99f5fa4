"""A work queue that several processes claim from: every job goes to one of them at a time.

The queue's state is a log of changes (:class:`CommitLog`), each a small Parquet folder with
the rows it sets. A claimer reads the state, writes the rows it wants to set and
commits them under the next number. If someone else took that number, what it read
is out of date: it drops its rows, reads again and claims anew.
"""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plenum.sources.commits import CommitLog

SHAPE = "job string, status string, worker string, until timestamp, attempts int"
SNAPSHOT_EVERY = 32  # changes after which the next one writes the whole state


class ClaimQueue:
    """Claims on jobs (named by a string) under ``path``: ``claimed`` until a time, ``done``, ``dead``, or free again."""

    def __init__(self, spark: SparkSession, path: str, most_attempts: int = 3, snapshot_every: int = SNAPSHOT_EVERY) -> None:
        self.spark, self.path, self.most, self.every = spark, path.rstrip("/"), most_attempts, snapshot_every
        self.log = CommitLog(spark, f"{self.path}/log")

    def state(self, entries: list[dict] | None = None) -> DataFrame:
        """Newest row of each job that was ever claimed."""
        entries = self.log.entries() if entries is None else entries
        first = max((i for i, e in enumerate(entries) if e["whole"]), default=0)
        rows = None
        for number, entry in enumerate(entries[first:]):
            part = self.spark.read.schema(SHAPE).parquet(f"{self.path}/{entry['rows']}").withColumn("number", F.lit(number))
            rows = part if rows is None else rows.unionByName(part)
        if rows is None:
            return self.spark.createDataFrame([], SHAPE)
        newest = rows.groupBy("job").agg(F.max_by(F.struct("status", "worker", "until", "attempts"), "number").alias("at"))
        return newest.select("job", "at.*")

    def _change(self, kind: str, rows_of) -> DataFrame:
        """Commit the rows that ``rows_of`` makes of the state, and return them."""
        made = None

        def propose(entries: list[dict]) -> dict | None:
            nonlocal made
            if made is not None:
                self._drop(made)
            now = self.state(entries)
            made = f"{self.path}/rows-{uuid.uuid4().hex}"
            rows = rows_of(now).select("job", "status", "worker", F.col("until").cast("timestamp").alias("until"), F.col("attempts").cast("int").alias("attempts"))
            rows.write.parquet(made)
            if self.spark.read.schema(SHAPE).parquet(made).isEmpty():
                return None
            folder, whole = made.rsplit("/", 1)[1], sum(1 for _ in entries) % self.every == self.every - 1
            if whole:
                mine = self.spark.read.schema(SHAPE).parquet(made)
                folder = f"{folder}-whole"
                now.join(mine, "job", "left_anti").unionByName(mine).write.parquet(f"{self.path}/{folder}")
            return {"kind": kind, "rows": folder, "whole": whole}

        if self.log.transact(propose) is None:
            self._drop(made)
            return self.spark.createDataFrame([], SHAPE)
        return self.spark.read.schema(SHAPE).parquet(made)

    def _drop(self, folder: str) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(folder)
        self.log.fs.delete(path, True)

    def claim(self, jobs: DataFrame, order: list[Column], worker: str, n: int, now: dt.datetime, seconds: int) -> DataFrame:
        """Claim up to ``n`` of ``jobs`` (``job`` and what ``order`` needs) for ``worker``, and return the claims.

        Free are jobs never claimed, released, or claimed until before ``now`` (their
        worker is taken for lost). A job whose last attempt ran out becomes ``dead`` in the same change.
        ``job`` is unique and not null in ``jobs``.
        """
        until = F.lit(now) + F.expr(f"interval {int(seconds)} seconds")

        def rows(state: DataFrame) -> DataFrame:
            known = state.withColumnsRenamed({c: f"__{c}" for c in ("status", "worker", "until", "attempts")})
            joined = jobs.join(known, "job", "left")
            lapsed = (F.col("__status") == "claimed") & (F.col("__until") <= F.lit(now))
            free = F.col("__status").isNull() | (F.col("__status") == "free") | lapsed
            tries = F.coalesce("__attempts", F.lit(0))
            spent = joined.where(lapsed & (tries >= self.most)).select("job", F.lit("dead").alias("status"), F.col("__worker").alias("worker"), F.col("__until").alias("until"), tries.alias("attempts"))
            taken = joined.where(free & (tries < self.most)).orderBy(*order, "job").limit(n)
            return taken.select("job", F.lit("claimed").alias("status"), F.lit(worker).alias("worker"), until.alias("until"), (tries + 1).alias("attempts")).unionByName(spent)

        return self._change("claim", rows).where("status = 'claimed'")

    def _held(self, state: DataFrame, ids: DataFrame, worker: str) -> DataFrame:
        return state.join(ids.select("job").distinct(), "job", "left_semi").where((F.col("status") == "claimed") & (F.col("worker") == worker))

    def finish(self, ids: DataFrame, worker: str) -> DataFrame:
        """Mark ``ids`` done, and return them. A job that ``worker`` no longer holds stays as it is."""
        return self._change("finish", lambda state: self._held(state, ids, worker).withColumn("status", F.lit("done")))

    def fail(self, ids: DataFrame, worker: str) -> DataFrame:
        """Give ``ids`` back, or let them be dead once their attempts are used up."""
        left = F.when(F.col("attempts") >= self.most, "dead").otherwise("free")
        return self._change("fail", lambda state: self._held(state, ids, worker).withColumn("status", left))

    def renew(self, ids: DataFrame, worker: str, now: dt.datetime, seconds: int) -> DataFrame:
        """Hold ``ids`` for longer; what another worker holds by now is not among the rows returned."""
        until = F.lit(now) + F.expr(f"interval {int(seconds)} seconds")
        return self._change("renew", lambda state: self._held(state, ids, worker).withColumn("until", until))
