"""Phrase alerts over items and matters: every text is read once for thousands of phrases.

Phrases go into Aho-Corasick automata, as many as their size asks for; a task runs its
Arrow batches through an automaton and gives the phrases it met, by number. Alerts, cities
and orders of preference follow as joins and windows.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plenum.operators.keyed import latest_per_key

GROUP_CHARS = 1 << 21  # characters of phrases that one automaton holds; more phrases take more passes over the texts


def phrase_groups(phrases: DataFrame, most: int) -> Iterator[list[str]]:
    """Distinct phrases in lists of about ``most`` characters; the driver has one list at a time."""
    total = phrases.agg(F.coalesce(F.sum(F.length("phrase") + 1), F.lit(0))).first()[0]
    groups = -(-total // most)
    dealt = phrases.withColumn("group", F.pmod(F.xxhash64("phrase"), F.lit(max(1, groups))))
    for g in range(groups):
        yield [r[0] for r in dealt.where(F.col("group") == g).select("phrase").collect()]


def phrase_hits(items: DataFrame, item_id: str, text: Column, phrases: DataFrame, most: int = GROUP_CHARS) -> DataFrame:
    """``item_id`` and ``phrase`` for every phrase (column ``phrase``) that ``text`` holds, once each.

    Containment is case-sensitive and by characters: a phrase may begin and end inside words, and
    phrases may overlap. Null and empty phrases and null texts match nothing.
    """
    wanted = phrases.where("phrase <> ''").select("phrase").distinct()
    source = items.select(F.col(item_id), text.cast("string").alias("__text")).where("__text is not null")
    id_type = source.schema[item_id].dataType
    out = items.sparkSession.createDataFrame([], f"{item_id} {id_type.simpleString()}, phrase string")
    for group in phrase_groups(wanted, most):
        if not group:
            continue
        listed = items.sparkSession.sparkContext.broadcast(group)  # of at most about ``most`` characters

        def run(batches: Iterator[pa.RecordBatch], listed=listed) -> Iterator[pa.RecordBatch]:
            import ahocorasick

            automaton = ahocorasick.Automaton()
            for number, phrase in enumerate(listed.value):
                automaton.add_word(phrase, number)
            automaton.make_automaton()
            for batch in batches:
                rows, found = [], []
                for i, value in enumerate(batch.column(1)):
                    met = sorted({number for _, number in automaton.iter(value.as_py())})
                    rows += [i] * len(met)
                    found += [listed.value[n] for n in met]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), pa.array(found, pa.string())], [item_id, "phrase"])

        out = out.unionByName(source.mapInArrow(run, f"{item_id} {id_type.simpleString()}, phrase string"))
    return out


def alert_phrases(alerts: DataFrame) -> DataFrame:
    """Keywords of active alerts with a city: ``alert_id``, ``cities``, ``place`` and ``phrase``."""
    live = alerts.where(F.coalesce("active", F.lit(True)) & (F.size(F.coalesce("cities", F.array())) > 0))
    return live.select("alert_id", "cities", F.posexplode("keywords").alias("place", "phrase")).where("phrase <> ''")


def first_matches(alerts: DataFrame, rows: DataFrame, row_id: str, text: Column, seen: DataFrame | None, most: int) -> DataFrame:
    """First keyword of each alert that a row of one of its cities (``banana``) holds: ``alert_id``, ``row_id``, ``keyword``."""
    wanted = alert_phrases(alerts)
    hits = phrase_hits(rows, row_id, text, wanted.select("phrase"), most)
    hits = hits.join(rows.select(row_id, "banana").distinct(), row_id).join(wanted, "phrase").where(F.array_contains("cities", F.col("banana")))
    if seen is not None:
        hits = hits.join(seen.select("alert_id", row_id).distinct(), ["alert_id", row_id], "left_anti")
    return latest_per_key(hits, ["alert_id", row_id], [F.col("place")]).select("alert_id", row_id, F.col("phrase").alias("keyword"))


def match_items(alerts: DataFrame, items: DataFrame, since: Column, seen: DataFrame | None = None, most: int = GROUP_CHARS) -> DataFrame:
    """Items of meetings since ``since`` that are not cancelled, with the first matching keyword of each alert.

    ``alerts``: ``alert_id``, ``cities``, ``keywords`` (arrays, in order of preference), ``active``. ``items``: ``item_id`` (unique), ``meeting_id``, ``banana``,
    ``date``, ``status``, ``title``, ``summary``. Pairs of ``seen`` (``alert_id``, ``item_id``) are left out. A match carries the start of the summary as context.
    """
    current = items.where((F.col("date") >= since) & ~F.coalesce(F.lower("status").isin("cancelled", "postponed"), F.lit(False)))
    text = F.concat_ws("\n", "title", "summary")
    found = first_matches(alerts, current, "item_id", text, seen, most)
    section = F.regexp_extract(F.coalesce("summary", F.lit("")), r"(?s)## Summary(.*?)(?:##|$)", 1)
    clean = F.when(F.col("summary").contains("## Summary"), F.regexp_replace(section, r"^\s+|\s+$", "")).otherwise(F.coalesce("summary", F.lit("")))
    return found.join(current.select("item_id", "meeting_id", "date", F.substring(clean, 1, 300).alias("context")), "item_id")


def match_matters(alerts: DataFrame, matters: DataFrame, appearances: DataFrame, since: Column, seen: DataFrame | None = None, most: int = GROUP_CHARS) -> DataFrame:
    """Matters last seen since ``since``, one match for each alert, with the matter's timeline and its latest appearance.

    ``matters``: ``matter_id`` (unique), ``banana``, ``title``, ``summary``, ``last_seen``. ``appearances``: ``matter_id``, ``item_id``, ``meeting_id``, ``date``, ``action``.
    The timeline is in order of date, then item; a matter without appearances has an empty one.
    """
    current = matters.where(F.col("last_seen") >= since)
    found = first_matches(alerts, current, "matter_id", F.concat_ws("\n", "title", "summary"), seen, most)
    steps = appearances.join(found.select("matter_id").distinct(), "matter_id", "left_semi")
    line = F.array_sort(F.collect_list(F.struct("date", "item_id", "meeting_id", "action")))
    timelines = steps.groupBy("matter_id").agg(line.alias("timeline"))
    latest = F.when(F.size("timeline") > 0, F.element_at("timeline", -1))
    joined = found.join(timelines, "matter_id", "left").withColumn("timeline", F.coalesce("timeline", F.array().cast(timelines.schema["timeline"].dataType)))
    return joined.withColumn("item_id", latest["item_id"]).withColumn("meeting_id", latest["meeting_id"])


def match_both(alerts: DataFrame, items: DataFrame, matters: DataFrame, appearances: DataFrame, since: Column, seen_items: DataFrame | None = None, seen_matters: DataFrame | None = None) -> DataFrame:
    """Both tracks in one frame: ``alert_id``, ``match_type`` (``keyword`` or ``matter``), ``id``, ``keyword``, ``item_id``, ``meeting_id``, ``n_steps`` of the timeline."""
    a = match_items(alerts, items, since, seen_items)
    b = match_matters(alerts, matters, appearances, since, seen_matters)
    columns = ["alert_id", "match_type", "id", "keyword", "item_id", "meeting_id", "n_steps"]
    a = a.withColumn("match_type", F.lit("keyword")).withColumn("id", F.col("item_id")).withColumn("n_steps", F.lit(None).cast("int"))
    b = b.withColumn("match_type", F.lit("matter")).withColumn("id", F.col("matter_id")).withColumn("n_steps", F.size("timeline"))
    return a.select(*columns).unionByName(b.select(*columns))
