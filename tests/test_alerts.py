"""Phrase alerts against brute force, on items and on matters."""

import datetime as dt
import random

from pyspark.sql import functions as F

from plenum.operators import alerts

ITEMS = "item_id long, meeting_id string, banana string, date date, status string, title string, summary string"
DAY = dt.date(2025, 1, 10)


def test_overlapping_phrases_inside_words(spark):
    rng = random.Random(6)
    texts = [(i, "".join(rng.choice("ab cé😀") for _ in range(rng.randint(0, 60)))) for i in range(200)] + [(900, None), (901, ""), (902, "x" * 200_000 + "needle" + "y" * 9)]
    phrases = sorted({"".join(rng.choice("ab cé😀") for _ in range(rng.randint(1, 5))) for _ in range(120)}) + ["needle", "a", "aa", "", None]
    want = sorted((i, p) for i, t in texts for p in set(phrases) if t and p and p in t)
    docs, asked = spark.createDataFrame(texts, "doc long, body string").repartition(3), spark.createDataFrame([(p,) for p in phrases], "phrase string")
    for most in (alerts.GROUP_CHARS, 40):  # one automaton, and some ten
        assert sorted(map(tuple, alerts.phrase_hits(docs, "doc", F.col("body"), asked, most).collect())) == want
    assert alerts.phrase_hits(docs, "doc", F.col("body"), asked.limit(0)).count() == 0


def test_items_track(spark):
    items = [
        (1, "m1", "oak", DAY, None, "Park plan", "text ## Summary\nA rezoning near the park. ## More"), (2, "m1", "oak", DAY, "cancelled", "rezoning", ""), (3, "m2", "elm", DAY, None, "rezoning", None),
        (4, "m3", "oak", dt.date(2024, 1, 1), None, "rezoning", None), (5, "m4", "oak", DAY, None, "Rezoning", "parking"), (6, "m4", "oak", DAY, None, None, None),
    ]
    rows = [(7, ["oak"], ["zoning", "park"], True), (8, ["oak", "elm"], ["park", "zoning"], True), (9, ["oak"], ["zoning"], False), (10, [], ["zoning"], True), (11, None, ["zoning"], True), (12, ["oak"], [], True)]
    wanted = spark.createDataFrame(rows, "alert_id long, cities array<string>, keywords array<string>, active boolean")
    seen = spark.createDataFrame([(8, 1)], "alert_id long, item_id long")
    got = alerts.match_items(wanted, spark.createDataFrame(items, ITEMS), F.lit(dt.date(2025, 1, 1)), seen)
    assert sorted((r["alert_id"], r["item_id"], r["keyword"], r["context"]) for r in got.collect()) == [(7, 1, "zoning", "A rezoning near the park."), (7, 5, "zoning", "parking"), (8, 3, "zoning", ""), (8, 5, "park", "parking")]


def test_matters_track_and_both(spark):
    matters = spark.createDataFrame([("a", "oak", "Bridge", "new bridge", DAY), ("b", "oak", None, "bridge repair", DAY), ("c", "oak", "Bridge", None, dt.date(2024, 1, 1))], "matter_id string, banana string, title string, summary string, last_seen date")
    steps = [("a", "i2", "m2", DAY, "passed"), ("a", "i1", "m1", dt.date(2025, 1, 2), "heard"), ("c", "i9", "m9", DAY, "heard")]
    appearances = spark.createDataFrame(steps, "matter_id string, item_id string, meeting_id string, date date, action string")
    wanted = spark.createDataFrame([(1, ["oak"], ["bridge", "Bridge"], None)], "alert_id long, cities array<string>, keywords array<string>, active boolean")
    got = {r["matter_id"]: r for r in alerts.match_matters(wanted, matters, appearances, F.lit(dt.date(2025, 1, 1))).collect()}
    assert sorted(got) == ["a", "b"] and [s["action"] for s in got["a"]["timeline"]] == ["heard", "passed"] and (got["a"]["item_id"], got["a"]["keyword"]) == ("i2", "bridge")
    assert got["b"]["timeline"] == [] and got["b"]["item_id"] is None
    items = spark.createDataFrame([("i1", "m1", "oak", DAY, None, "bridge", None)], ITEMS.replace("item_id long", "item_id string"))
    both = alerts.match_both(wanted, items, matters.withColumnRenamed("x", "y"), appearances, F.lit(dt.date(2025, 1, 1)))
    assert sorted((r["match_type"], r["id"], r["n_steps"] or 0) for r in both.collect()) == [("keyword", "i1", 0), ("matter", "a", 2), ("matter", "b", 0)]
