"""The public query surface over domain tables: functions from DataFrames to DataFrames."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plenum.functions.text import banana_key, city_state, context
from plenum.operators import search
from plenum.operators.fuzzy import close_names, name_index
from plenum.operators.keyed import latest_per_key
from plenum.plans.scans import clamp_limit

CLOSED = ("cancelled", "postponed")


def open_status(status: Column) -> Column:
    """Unknown status counts as open."""
    return status.isNull() | ~F.lower(status).isin(*CLOSED)


@dataclass
class Records:
    """The domain tables; each query reads only what it needs of them."""

    jurisdictions: DataFrame
    meetings: DataFrame
    items: DataFrame
    matters: DataFrame | None = None
    votes: DataFrame | None = None

    def city_meetings(self, banana: str, limit: int | None = None, offset: int = 0) -> DataFrame:
        rows = self.meetings.where(F.col("banana") == banana)
        return rows.orderBy(F.col("date").desc_nulls_last(), "id").offset(offset).limit(clamp_limit(limit))

    def upcoming(self, banana: str, start: Column, end: Column, limit: int | None = None) -> DataFrame:
        rows = self.meetings.where((F.col("banana") == banana) & F.col("date").between(start, end) & open_status(F.col("status")))
        return rows.orderBy("date", "id").limit(clamp_limit(limit))

    def meeting(self, meeting_id: str) -> DataFrame:
        """One meeting with its items nested in order."""
        items = self.items.where(F.col("meeting_id") == meeting_id).groupBy("meeting_id").agg(F.array_sort(F.collect_list(F.struct("sequence", F.col("id").alias("item_id"), "title", "summary"))).alias("items"))
        return self.meetings.where(F.col("id") == meeting_id).join(items, F.col("id") == F.col("meeting_id"), "left").drop("meeting_id")

    def search_items(self, query: str, banana: str | None = None, limit: int | None = None) -> DataFrame:
        """Items with all words of the query, or whose file number holds it; the snippet is made for the page only."""
        wanted = search.query_terms(query)
        text = F.concat_ws(" ", "title", "summary")
        hit = F.coalesce(F.contains(F.col("matter_file"), F.lit(query)), F.lit(False))
        if wanted:
            hit = hit | search.contains_all(text, wanted)
        rows = self.items.where(hit).join(self.meetings.select(F.col("id").alias("meeting_id"), "banana", "date"), "meeting_id")
        if banana:
            rows = rows.where(F.col("banana") == banana)
        page = rows.orderBy(F.col("date").desc_nulls_first(), "sequence", "id").limit(clamp_limit(limit))
        return page.withColumn("snippet", context(text, wanted[0] if wanted else query))

    def matter_timeline(self, matter_id: str) -> DataFrame:
        rows = self.items.where(F.col("matter_id") == matter_id).join(self.meetings.select(F.col("id").alias("meeting_id"), "date", F.col("title").alias("meeting_title")), "meeting_id")
        return rows.orderBy(F.col("date").asc_nulls_last(), "meeting_id", "sequence")

    def city_matters(self, banana: str, limit: int | None = None, offset: int = 0) -> DataFrame:
        """A page of matters that have items, newest first, each with its timeline nested."""
        own = self.items.where("matter_id is not null").join(self.meetings.where(F.col("banana") == banana).select(F.col("id").alias("meeting_id"), "date"), "meeting_id")
        page = own.groupBy("matter_id").agg(F.max("date").alias("last_seen"), F.count(F.lit(1)).alias("appearances")).orderBy(F.col("last_seen").desc_nulls_last(), "matter_id").offset(offset).limit(clamp_limit(limit))
        nested = own.join(F.broadcast(page.select("matter_id")), "matter_id").groupBy("matter_id").agg(F.array_sort(F.collect_list(F.struct("date", "meeting_id", F.col("id").alias("item_id")))).alias("timeline"))
        return page.join(nested, "matter_id")

    def member_record(self, member_id: str, limit: int | None = None) -> DataFrame:
        assert self.votes is not None
        return self.votes.where(F.col("council_member_id") == member_id).orderBy(F.col("vote_date").desc_nulls_last(), "matter_id").limit(clamp_limit(limit))

    def city_by_zip(self, zipcode: str, zips: DataFrame) -> DataFrame:
        return zips.where(F.col("zipcode") == zipcode).join(self.jurisdictions, "banana")

    def find_city(self, text: str) -> DataFrame:
        """Jurisdictions for what a user typed: a zip code is for :meth:`city_by_zip`; city with state exactly, a city
        alone in any state (several rows: the caller offers the choice), else close names, best first."""
        spark = self.jurisdictions.sparkSession
        asked = spark.createDataFrame([(text,)], "t string").select(city_state(F.col("t")).alias("c")).select("c.city", "c.state")
        key = asked.select(banana_key(F.col("city"), F.coalesce("state", F.lit(""))).alias("key"), "state")
        by_name = F.lower(F.regexp_replace("name", r"[^A-Za-z0-9]", ""))
        named = self.jurisdictions.withColumn("key", F.concat(by_name, F.upper("state"))).withColumn("bare", by_name)
        hits = named.join(F.broadcast(key.withColumnRenamed("key", "asked").withColumnRenamed("state", "asked_state")), (F.col("key") == F.col("asked")) | (F.col("asked_state").isNull() & (F.col("bare") == F.col("asked"))))
        return hits.drop("key", "bare", "asked", "asked_state").orderBy(F.col("population").desc_nulls_last(), "banana")

    def close_cities(self, text: str, names: list[str] | None = None) -> DataFrame:
        """Known names close to what was typed, best first: of all jurisdictions, or of a list of names."""
        spark = self.jurisdictions.sparkSession
        known = self.jurisdictions if names is None else spark.createDataFrame([(n,) for n in names], "name string")
        return close_names(spark.createDataFrame([(text,)], "name string"), name_index(known)).orderBy("rank").select("name")

    def happening(self, happening: DataFrame, banana: str, now: Column, limit: int | None = None) -> DataFrame:
        rows = happening.where((F.col("banana") == banana) & (F.col("expires_at") > now)).join(self.meetings.select(F.col("id").alias("meeting_id"), "status", "date"), "meeting_id")
        return rows.where(open_status(F.col("status"))).orderBy("rank", "meeting_id").limit(clamp_limit(limit))

    def latest_meetings(self) -> DataFrame:
        return latest_per_key(self.meetings, ["banana"], [F.col("date").desc_nulls_last(), F.col("id")])
