"""Event journeys, patterns, drop-offs, trending and retention (survey 2.5, 2.17)."""

from __future__ import annotations

from pyspark.sql import functions as F

from plenum.operators.keyed import latest_per_key
from plenum.plans.base import query
from plenum.sources.tables import table


def paths(events, first: int | None = None):
    """Event names of each user in order of time; with ``first``, only that many.

    With a bound the first events are ranked before they are collected, so a user
    with very many events sends only a few.
    """
    if first is not None:
        events = latest_per_key(events, ["user_id"], [F.col("ts"), F.col("event_id")], n=first)
    steps = F.array_sort(F.collect_list(F.struct("ts", "event_id", "event_type")))
    return events.groupBy("user_id").agg(F.transform(steps, lambda x: x["event_type"]).alias("path"))


@query(
    "path_patterns",
    "SELECT pattern, count(*) AS n FROM (SELECT user_id, string_agg(event_type, ' > ' ORDER BY ts, event_id) AS pattern FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS r FROM events) WHERE r <= 5 GROUP BY user_id) GROUP BY pattern ORDER BY n DESC, pattern LIMIT 20",
)
def path_patterns(spark, sf_dir):
    found = paths(table(spark, sf_dir, "events"), first=5).select(F.array_join("path", " > ").alias("pattern"))
    return found.groupBy("pattern").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "pattern").limit(20)


@query("user_journeys", "SELECT user_id, count(*) AS steps, string_agg(event_type, '>' ORDER BY ts, event_id) AS journey FROM events GROUP BY user_id ORDER BY steps DESC, user_id LIMIT 25")
def user_journeys(spark, sf_dir):
    """Lengths are counted first; only the journeys on the page are collected."""
    events = table(spark, sf_dir, "events")
    longest = events.groupBy("user_id").agg(F.count(F.lit(1)).alias("steps")).orderBy(F.desc("steps"), "user_id").limit(25)
    found = paths(events.join(F.broadcast(longest.select("user_id")), "user_id"))
    return longest.join(found, "user_id").select("user_id", "steps", F.array_join("path", ">").alias("journey"))


@query("last_event_dropoff", "SELECT event_type, count(*) AS n FROM (SELECT user_id, arg_max(event_type, (ts, event_id)) AS event_type FROM events GROUP BY user_id) GROUP BY 1")
def last_event_dropoff(spark, sf_dir):
    last = table(spark, sf_dir, "events").groupBy("user_id").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("event_type"))
    return last.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


@query(
    "trending_entities",
    "SELECT json_extract_string(props, '$.k') AS entity, count(*) AS engagement, count(DISTINCT coalesce(CASE WHEN user_id % 4 <> 0 THEN user_id END, 1000000 + event_id % 97)) AS uniques FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 7 DAY GROUP BY 1 ORDER BY engagement DESC, entity LIMIT 100",
)
def trending_entities(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    newest = events.agg(F.max("ts").alias("newest"))
    recent = events.crossJoin(F.broadcast(newest)).where(F.expr("ts >= newest - interval 7 days"))  # one row
    who = F.coalesce(F.when(F.col("user_id") % 4 != 0, F.col("user_id")), 1000000 + F.col("event_id") % 97)
    ranked = recent.groupBy(F.get_json_object("props", "$.k").alias("entity")).agg(F.count(F.lit(1)).alias("engagement"), F.count_distinct(who).alias("uniques"))
    return ranked.orderBy(F.desc("engagement"), "entity").limit(100)


@query("retention_window", "SELECT event_type, count(*) FILTER (WHERE ts < TIMESTAMP '2024-01-23') AS expired, count(*) FILTER (WHERE ts >= TIMESTAMP '2024-01-23') AS live FROM events GROUP BY 1")
def retention_window(spark, sf_dir):
    old = F.col("ts") < F.lit("2024-01-23").cast("timestamp_ntz")
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count_if(old).alias("expired"), F.count_if(~old).alias("live"))


@query("session_windows", "WITH g AS (SELECT *, coalesce(ts >= lag(ts) OVER w + INTERVAL 30 MINUTE, true)::INT AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM g) SELECT user_id, min(ts) AS started, count(*) AS n FROM s GROUP BY user_id, s")
def session_windows(spark, sf_dir):
    """Sessions of a user with less than half an hour between events."""
    events = table(spark, sf_dir, "events").withColumn("at", F.col("ts").cast("timestamp"))
    rows = events.groupBy("user_id", F.session_window("at", "30 minutes")).agg(F.min("ts").alias("started"), F.count(F.lit(1)).alias("n"))
    return rows.select("user_id", "started", "n")


@query(
    "lateness",
    "SELECT e.event_id, round((epoch_us(e.ts) - epoch_us(f.first_ts)) / 3600000000.0, 1) AS hours_late FROM events e JOIN (SELECT user_id, min(ts) AS first_ts FROM events GROUP BY 1) f USING (user_id) WHERE e.ts > f.first_ts + INTERVAL 6 HOUR AND e.ts >= TIMESTAMP '2024-01-27' AND e.event_type = 'signup'",
)
def lateness(spark, sf_dir):
    """Late additions: created over six hours after their parent and within the last days."""
    events = table(spark, sf_dir, "events")
    first = events.groupBy("user_id").agg(F.min("ts").alias("first_ts"))
    late = events.where("event_type = 'signup' and ts >= timestamp_ntz'2024-01-27'").join(first, "user_id").where(F.expr("ts > first_ts + interval 6 hours"))
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    return late.select("event_id", F.round((micros("ts") - micros("first_ts")) / 3_600_000_000.0, 1).alias("hours_late"))
