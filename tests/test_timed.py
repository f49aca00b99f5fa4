"""Timed keyed state: equal to the batch form, late rows reported, state bounded."""

import datetime as dt
import random

from plenum.streaming import timed

SHAPE = "key string, at timestamp, generation long, version string"
T0 = dt.datetime(2024, 3, 1)


def run(spark, folder, batches, make, schema=SHAPE):
    """Rows of each micro-batch, and the number of state rows after it."""
    for i, batch in enumerate(batches):
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(f"{folder}/in/{i:04d}")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in/*")
    got, sizes = [], []
    with timed.rocksdb(spark):
        query = make(stream).writeStream.foreachBatch(lambda df, n: got.append([tuple(r) for r in df.collect()])).option("checkpointLocation", f"{folder}/ck").trigger(availableNow=True).start()
    query.awaitTermination(240)
    assert query.exception() is None
    sizes = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]
    return [row for batch in got for row in batch], sizes


def at(minutes):
    return T0 + dt.timedelta(minutes=minutes)


def test_intents_out_of_order_equal_the_batch(spark, tmp_path):
    rng = random.Random(4)
    rows = [(f"k{rng.randrange(4)}", at(2 * g), g, rng.choice("AB")) for g in range(90)]
    held = sorted(rows, key=lambda r: r[1] + dt.timedelta(minutes=rng.uniform(0, 8)))  # shuffled, but less than the lateness
    batches = [held[i : i + 15] for i in range(0, 90, 15)] + [[("end", at(9999), 0, "Z")]]
    got, _ = run(spark, tmp_path, batches, lambda s: timed.accepted_intents(s, "10 minutes", keep_seconds=3600))
    want = [tuple(r) for r in timed.accepted_in_batch(spark.createDataFrame(rows, SHAPE), keep_seconds=3600).collect()]
    assert sorted(got) == sorted(want)


def test_late_and_superseded_rows(spark, tmp_path):
    batches = [[("k", at(0), 1, "A")], [("k", at(60), 2, "B"), ("other", at(100), 1, "X")], [("k", at(10), 5, "LATE"), ("k", at(95), 2, "C")], [("end", at(500), 0, "Z")]]
    got, _ = run(spark, tmp_path, batches, lambda s: timed.accepted_intents(s, "10 minutes"))
    assert sorted(got) == [("k", 1, "A", "accepted"), ("k", 2, "B", "accepted"), ("k", 5, "LATE", "late"), ("other", 1, "X", "accepted")]


def test_moves_and_forgotten_keys(spark, tmp_path):
    batches = [[("k", at(0), 1, "p")], [("k", at(30), 2, "p"), ("k", at(31), 3, "q")], [("k", at(300), 4, "q"), (None, at(300), 1, "x")], [("end", at(900), 0, "z")]]
    got, _ = run(spark, tmp_path, batches, lambda s: timed.moves(s, "1 minute", keep_seconds=3600))
    assert sorted(got) == [("k", 1, "p", "new"), ("k", 3, "q", "moved"), ("k", 4, "q", "new")]  # after four hours k is new again


def test_state_is_bounded(spark, tmp_path):
    batches = [[(f"k{i}-{j}", at(60 * i), 1, "A") for j in range(20)] for i in range(12)]
    got, sizes = run(spark, tmp_path, batches, lambda s: timed.accepted_intents(s, "10 minutes", keep_seconds=3600))
    assert len(got) == 20 * 11 and max(sizes) <= 20 * 4 * 3, sizes  # the keys of a few hours, each with a value, list or timer; 240 keys in all
    assert sizes[-1] <= max(sizes[:6])


def test_leases_end(spark, tmp_path):
    batches = [[("a", at(0)), ("b", at(0))], [("b", at(8)), ("c", at(11))], [("c", at(15))], [("a", at(20)), ("b", at(21)), ("c", at(21))], [("c", at(60))], [("c", at(70))], [("c", at(3000))], [("c", at(3001))]]
    got, sizes = run(spark, tmp_path, batches, lambda s: timed.leases(s, minutes=5, most=2, keep_seconds=36000), "job string, at timestamp")
    assert [g for g in got if g[0] == "a"] == [("a", 1, "pending"), ("a", 2, "dead_letter")]
    assert ("b", 1, "pending") in got and sizes[-1] <= 3


class Calls:
    """State of one key as the processors call it, with a count of the timers set."""

    def __init__(self):
        self.value, self.timers = None, []

    def getValueState(self, *_):  # noqa: N802
        return self

    def get(self):
        return self.value

    def update(self, x):
        self.value = x

    def clear(self):
        self.value = None

    def registerTimer(self, t):  # noqa: N802
        self.timers.append(t)

    def watermark(self, ms):
        self.ms = ms
        return self

    def getCurrentWatermarkInMs(self):  # noqa: N802
        return self.ms


def test_a_key_has_one_timer_for_all_its_rows():
    """Rows of many minutes set one timer at a time, every row settles in order, and the key is forgotten."""
    import pandas as pd

    day = 86_400_000
    calls, rule = Calls(), timed.Intents(3600 * 1_000_000)
    rule.init(calls)
    rows = pd.DataFrame([(day * 1000 + i * 60_000_000, i, "AB"[i % 2]) for i in range(50)], columns=["at", "generation", "version"])
    assert list(rule.handleInputRows(("k",), iter([rows]), calls.watermark(day))) == [] and len(calls.timers) == 1
    got, fired = [], 0
    for minute in range(0, 400, 10):
        calls.watermark(day + minute * 60_000)
        while due := [t for t in calls.timers if t <= calls.ms]:
            calls.timers = [t for t in calls.timers if t not in due]
            for _ in due:
                fired += 1
                got += [tuple(r) for part in rule.handleExpiredTimer(("k",), calls, None) for r in part.itertuples(index=False)]
    assert got == [("k", i, "AB"[i % 2], "accepted") for i in range(50)] and fired <= 8
    assert calls.value is None and calls.timers == []
