"""Keyed streaming state that ends: intents in order, moved rows and leases, on event-time timers.

Each operator keeps what has not settled and the last settled fact in one value, for
a call on the state costs more than the rows that a key has within the lateness.
A timer settles rows once the watermark has passed them, so rows that come out of
order within the lateness allowed give the batch result; rows behind the watermark come
out marked ``late`` and change nothing. A key that hears nothing for ``keep`` is forgotten, so the
state follows the keys active of late, not all keys ever seen.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
GRAIN_MS = 60_000  # timers are due at whole minutes


@contextmanager
def rocksdb(spark: SparkSession):
    """Start the queries of this block with the state store that timers need; the session's setting comes back after."""
    before = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, ROCKSDB)
    try:
        yield
    finally:
        spark.conf.set(PROVIDER, before)


def due(at: int) -> int:
    """The timer, in milliseconds, that settles a row of time ``at`` (microseconds)."""
    return (at // 1000 // GRAIN_MS + 1) * GRAIN_MS


class InOrder(StatefulProcessor):
    """Settle a key's (``at``, ``generation``, ``version``) rows in order once the watermark has passed them.

    A key has a timer for the earliest row that waits, or, where none waits, for its
    forgetting; what it settles sets the next one. Each call on timers or state is a message to the JVM, so there are few.

    Subclasses say in :meth:`step` what a settled row gives, from the last settled one.
    """

    columns = ["key", "generation", "version", "change"]

    def __init__(self, keep_us: int) -> None:
        self.keep = keep_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", "rows string")

    def read(self) -> tuple[list[tuple], tuple | None]:
        """Rows that wait, and the last settled one."""
        held = self.state.get()
        waiting, last = json.loads(held[0]) if held is not None else ([], None)
        return [tuple(x) for x in waiting], tuple(last) if last is not None else None

    def write(self, waiting: list[tuple], last: tuple | None) -> None:
        if waiting or last is not None:
            self.state.update((json.dumps([waiting, last]),))
        else:
            self.state.clear()

    def step(self, row: tuple, last: tuple | None) -> str | None:
        raise NotImplementedError

    def advanced(self, name: str, waiting: list[tuple], last: tuple | None, mark: int) -> tuple[list[tuple], tuple | None, list[tuple]]:
        """Rows that still wait, the last settled one, and what those settled by the watermark give."""
        out, rest = [], [x for x in waiting if x[0] >= mark]
        for row in sorted((x for x in waiting if x[0] < mark), key=lambda x: (x[1], x[0])):
            if last is not None and row[0] - last[0] > self.keep:
                last = None  # so long ago that the key would be forgotten
            if last is not None and row[1] <= last[1]:
                continue  # superseded
            change = self.step(row, last)
            if change:
                out.append((name, row[1], row[2], change))
            last = row
        if last is not None and mark - last[0] > self.keep and not rest:
            last = None
        return rest, last, out

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        mark = max(0, timerValues.getCurrentWatermarkInMs()) * 1000
        out, fresh = [], []
        for batch in rows:
            for row in zip(batch["at"].tolist(), batch["generation"].tolist(), batch["version"].tolist()):
                if row[0] < mark:
                    out.append((key[0], row[1], row[2], "late"))
                else:
                    fresh.append(row)
        if fresh:  # what the watermark has passed settles here too, so that its timer finds nothing left to write
            waiting, last = self.read()
            rest, last, settled = self.advanced(key[0], waiting + fresh, last, mark)
            self.write(rest, last)
            self.handle.registerTimer(due(min(x[0] for x in rest)))
            out += settled
        if out:
            yield pd.DataFrame(out, columns=self.columns)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        mark = timerValues.getCurrentWatermarkInMs() * 1000
        waiting, before = self.read()
        rest, last, out = self.advanced(key[0], waiting, before, mark)
        if len(rest) < len(waiting) or last != before:
            self.write(rest, last)
            if rest:
                self.handle.registerTimer(due(min(x[0] for x in rest)))
            elif last is not None:
                self.handle.registerTimer(due(last[0] + self.keep) + GRAIN_MS)
        if out:
            yield pd.DataFrame(out, columns=self.columns)

    def close(self) -> None:
        pass


class Intents(InOrder):
    """An intent is ``accepted`` if its version differs from the key's last; a repeated one changes nothing."""

    def step(self, row: tuple, last: tuple | None) -> str | None:
        return "accepted" if last is None or row[2] != last[2] else None


class Moves(InOrder):
    """A row is ``new`` once for a key, then ``moved`` when its fingerprint (``version``) differs from the last."""

    def step(self, row: tuple, last: tuple | None) -> str | None:
        return "new" if last is None else "moved" if row[2] != last[2] else None


def settled(rows: DataFrame, processor: InOrder, lateness: str) -> DataFrame:
    """``rows`` (``key`` string, ``at`` timestamp, ``generation`` long, ``version`` string) through ``processor``.

    The watermark is on ``at``, but the processor gets it as a number, so Spark leaves
    rows behind the watermark in, and they can be reported. Null versions count as a value; null keys or times do not come in.
    """
    timed = rows.where("key is not null and at is not null").withWatermark("at", lateness)
    plain = timed.select("key", F.unix_micros("at").alias("at"), "generation", "version")
    shape = "key string, generation long, version string, change string"
    return plain.groupBy("key").transformWithStateInPandas(processor, shape, "Append", "EventTime")


def accepted_intents(rows: DataFrame, lateness: str = "10 minutes", keep_seconds: int = 7 * 86400) -> DataFrame:
    """``key``, ``generation``, ``version`` and ``change`` (``accepted`` or ``late``) of a stream of intents; start it inside :func:`rocksdb`."""
    return settled(rows, Intents(keep_seconds * 1_000_000), lateness)


def moves(rows: DataFrame, lateness: str = "10 minutes", keep_seconds: int = 7 * 86400) -> DataFrame:
    """``key``, ``generation``, ``version`` (the fingerprint) and ``change`` (``new``, ``moved`` or ``late``)."""
    return settled(rows, Moves(keep_seconds * 1_000_000), lateness)


def accepted_in_batch(rows: DataFrame, keep_seconds: int = 7 * 86400) -> DataFrame:
    """The batch form of :func:`accepted_intents` for rows whose generations rise with their times."""
    once = rows.where("key is not null and at is not null").groupBy("key", "generation").agg(F.min_by(F.struct("at", "version"), "at").alias("x")).select("key", "generation", "x.*")
    order = Window.partitionBy("key").orderBy("generation")
    gap = F.unix_micros("at") - F.unix_micros(F.lag("at").over(order)) > keep_seconds * 1_000_000
    changed = F.lag("at").over(order).isNull() | gap | ~F.col("version").eqNullSafe(F.lag("version").over(order))
    return once.withColumn("__open", changed).where("__open").select("key", "generation", "version", F.lit("accepted").alias("change"))


class Leases(StatefulProcessor):
    """Jobs whose heartbeats stop for ``wait`` are handed back, and dead at the ``most``-th time or after ``keep`` without a sign."""

    columns = ["job", "failures", "status"]

    def __init__(self, wait_us: int, keep_us: int, most: int) -> None:
        self.wait, self.keep, self.most = wait_us, keep_us, most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("lease", "newest long, failures int, running boolean")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        newest, failures, _ = tuple(self.state.get()) if self.state.exists() else (0, 0, False)
        newest = max([newest, *(int(b["at"].max()) for b in rows if len(b))])
        self.state.update((newest, failures, True))
        self.handle.registerTimer(max(due(newest + self.wait), timerValues.getCurrentWatermarkInMs() + 1))
        yield pd.DataFrame([], columns=self.columns)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        out, mark = [], timerValues.getCurrentWatermarkInMs() * 1000
        if self.state.exists():
            newest, failures, running = tuple(self.state.get())
            if running and newest + self.wait < mark:
                failures += 1
                out.append((key[0], failures, "dead_letter" if failures >= self.most else "pending"))
                if failures >= self.most:
                    self.state.clear()
                else:
                    self.state.update((newest, failures, False))
                    self.handle.registerTimer(due(max(newest + self.keep, mark)) + GRAIN_MS)
            elif not running and newest + self.keep < mark:
                out.append((key[0], failures, "abandoned"))
                self.state.clear()
        yield pd.DataFrame(out, columns=self.columns)

    def close(self) -> None:
        pass


def leases(heartbeats: DataFrame, minutes: int, most: int = 3, keep_seconds: int = 86400, lateness: str = "0 seconds") -> DataFrame:
    """``job``, ``failures`` and ``status`` (``pending``, ``dead_letter``, ``abandoned``) of jobs whose heartbeats (``job`` string, ``at``) stop."""
    timed = heartbeats.where("job is not null and at is not null").withWatermark("at", lateness).select("job", F.unix_micros("at").alias("at"))
    return timed.groupBy("job").transformWithStateInPandas(Leases(minutes * 60_000_000, keep_seconds * 1_000_000, most), "job string, failures int, status string", "Append", "EventTime")
