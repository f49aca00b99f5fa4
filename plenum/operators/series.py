"""Time series: calendar spines, and numbering runs with resets."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def weekly_counts(df: DataFrame, time: str, id_column: str, user: str, weeks: int = 8) -> DataFrame:
    """Counts of the ``weeks`` complete Monday weeks before the newest row's, zero-filled.

    The spine comes from a one-row frame with the newest time, so no bound is
    fetched by the driver; weeks are counted before they meet the spine.
    """
    week = F.date_trunc("week", time).cast("date")
    newest = df.agg(F.date_trunc("week", F.max(time)).cast("date").alias("hi"))
    spine = newest.select(F.explode(F.sequence(F.date_sub("hi", 7 * weeks), F.date_sub("hi", 7), F.expr("interval 7 days"))).alias("week"))
    counts = df.groupBy(week.alias("week")).agg(F.count(id_column).alias("n"), F.count_distinct(user).alias("users"))
    return spine.join(counts, "week", "left").select(F.col("week").cast("string").alias("week"), F.coalesce("n", F.lit(0)).cast("long").alias("n"), F.coalesce("users", F.lit(0)).cast("long").alias("users"))


# What makes a fall of numbers a new run.
RUN_LEAST_HIGH = 20  # a run must have come so far
RUN_DAYS = 120  # in which the new run has to show itself
RUN_NEW_NUMBERS = 10  # distinct low numbers it has to show
RUN_OLD_SHARE = 0.2  # numbers of the old range among them, at most
RUN_SLACK = 10  # a number so far past the mark is carried over


class Run:
    """High-water mark of a numbering series, aware of stragglers of the run before."""

    def __init__(self) -> None:
        self.high, self.old = 0, 0

    def may_restart(self, number: int) -> bool:
        return self.high >= RUN_LEAST_HIGH and number <= max(3, self.high // 10)

    def proven(self, soon: list[int]) -> bool:
        low = [n for n in soon if n <= self.high // 2]
        return len(set(low)) >= RUN_NEW_NUMBERS and len(soon) - len(low) < RUN_OLD_SHARE * len(soon)

    def restart(self, number: int) -> None:
        self.high, self.old = number, self.high

    def see(self, number: int) -> None:
        straggler = self.old and number > self.high + RUN_SLACK and number > self.old // 2
        if not straggler:
            self.high = max(self.high, number)
            if self.high > self.old // 2:
                self.old = 0


def run_starts(rows: list[tuple]) -> list:
    """Days on which a new run begins, of (day, number) rows in order."""
    run, out = Run(), []
    for i, (day, number) in enumerate(rows):
        if run.may_restart(number) and run.proven([n for d, n in rows[i:] if (d - day).days <= RUN_DAYS]):
            out.append(day)
            run.restart(number)
        else:
            run.see(number)
    return out


def numbering_runs(occurrences: DataFrame) -> DataFrame:
    """Starts of every run after the first of each ``series`` of (``day``, ``number``).

    The scan needs state and a look ahead, so each series is one pandas group;
    repeated (day, number) pairs are dropped first with map-side combining, which
    bounds a group by its distinct numbers a day.
    """

    def scan(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["day", "number"])
        found = run_starts(list(zip(pdf["day"], pdf["number"])))
        return pd.DataFrame({"series": pd.Series([pdf["series"].iloc[0]] * len(found), dtype="int64"), "start": pd.Series(found, dtype=object)})

    distinct = occurrences.select("series", "day", "number").distinct()
    return distinct.groupBy("series").applyInPandas(scan, "series long, start date")
