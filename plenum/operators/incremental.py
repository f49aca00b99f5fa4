"""Change signals, desired-state queues and outboxes as batch operators over append logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plenum.operators.keyed import latest_per_key


def compact(log: DataFrame, key: str, generation: str) -> DataFrame:
    """Current state of each key: its row of the newest generation (aggregated map-side)."""
    rest = [c for c in log.columns if c != key]
    top = log.groupBy(key).agg(F.max_by(F.struct(*rest), F.col(generation)).alias("__row"))
    return top.select(key, "__row.*")


def desired_state(log: DataFrame, key: str, generation: str, version: str, tombstone: str | None = None) -> DataFrame:
    """Desired work of each key from all intents.

    The newest generation wins. ``reopened`` is true if its version differs from
    the one before in order of generation, so A, B, A opens A again; a repeated
    version changes nothing. A tombstone as newest intent leaves no open work.
    """
    from pyspark.sql import Window

    order = Window.partitionBy(key).orderBy(generation)
    marked = log.withColumn("__before", F.lag(version).over(order)).withColumn("reopened", ~F.col(version).eqNullSafe(F.col("__before")))
    current = compact(marked.drop("__before"), key, generation)
    return current if tombstone is None else current.withColumn("open", ~F.coalesce(F.col(tombstone), F.lit(False)))


def unresolved(intents: DataFrame, fulfilled: DataFrame, key: str, version: str, generation: str) -> DataFrame:
    """Intents neither fulfilled at their version nor superseded by a newer one of their key."""
    newest = intents.groupBy(key).agg(F.max(generation).alias(generation))
    return intents.join(newest, [key, generation], "left_semi").join(fulfilled.select(key, version).distinct(), [key, version], "left_anti")


def first_per_aggregate(events: DataFrame, aggregate: str, generation: str, ready: Column) -> DataFrame:
    """Oldest unpublished event of each aggregate, if it is ready: later ones wait for it."""
    rest = [c for c in events.columns if c != aggregate]
    oldest = events.groupBy(aggregate).agg(F.min_by(F.struct(*rest), F.col(generation)).alias("__row")).select(aggregate, "__row.*")
    return oldest.where(ready)


def claim(jobs: DataFrame, lane: str, order: list[Column], n: int) -> DataFrame:
    """Up to ``n`` ready jobs of each lane in order; a batch claims by rank, so no locks are needed."""
    return latest_per_key(jobs, [lane], order, n=n, rank="place")


def after_failure(retries: Column, priority: Column, failed_at: Column, most: int = 3, floor_seconds: int = 30) -> Column:
    """State after a failed attempt: another try with exponential delay and lower priority, or dead letter."""
    times = F.coalesce(retries, F.lit(0)) + 1
    delay = (floor_seconds * F.pow(F.lit(2), times - 1)).cast("long")
    dead = times >= most
    return F.struct(
        times.alias("retry_count"),
        F.when(dead, "dead_letter").otherwise("pending").alias("status"),
        F.when(~dead, priority - 10 * times).alias("priority"),
        F.when(~dead, F.timestamp_seconds(F.unix_seconds(failed_at) + delay)).alias("ready_at"),
    )


def stale(status: Column, heartbeat: Column, now: Column, minutes: int) -> Column:
    """True for running work whose last sign of life is older than ``minutes``."""
    return (status == "processing") & (F.unix_seconds(now) - F.unix_seconds(heartbeat) > 60 * minutes)


def quiet_interval(streak: Column, floor: int, step: int, ceiling: int) -> Column:
    return F.least(F.lit(ceiling), F.lit(floor) + step * streak)


def failure_interval(failures: Column, floor: int, ceiling: int) -> Column:
    return F.least(F.lit(ceiling).cast("double"), floor * F.pow(F.lit(2.0), F.greatest(failures - 1, F.lit(0)))).cast("long")


def targeted_range(dates: Column, pad_days: int = 3, widest_days: int = 60) -> Column:
    """Padded range of hint dates; null if there are none or they lie too far apart."""
    low, high = F.array_min(dates), F.array_max(dates)
    return F.when(F.date_diff(high, low) <= widest_days, F.struct(F.date_sub(low, pad_days).alias("start"), F.date_add(high, pad_days).alias("end")))


def row_diff(previous: DataFrame, rows: DataFrame, key: str, fingerprint: str) -> DataFrame:
    """Keys that are new or whose rows' fingerprints, folded without regard to order, moved."""
    fold = lambda df, name: df.groupBy(key).agg(F.sort_array(F.collect_set(fingerprint)).alias(name))
    both = fold(rows, "now").join(fold(previous, "then"), key, "left")
    kind = F.when(F.col("then").isNull(), "new").when(F.col("then") != F.col("now"), "moved")
    return both.select(key, kind.alias("change")).where("change is not null")


def dirty_state(signals: DataFrame, key: str, at: str, dates: str, full: str, cleared: DataFrame | None = None) -> DataFrame:
    """Dirty keys: since when, all hinted dates, whether a full pass is needed.

    ``cleared`` has the start (``started_at``) of the last finished sync of a key; signals
    seen before it are settled, later ones are not.
    """
    if cleared is not None:
        signals = signals.join(cleared, key, "left").where(F.col("started_at").isNull() | (F.col(at) >= F.col("started_at")))
    hints = F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.coalesce(dates, F.array().cast("array<date>"))))))
    return signals.groupBy(key).agg(F.min(at).alias("dirty_since"), hints.alias("dirty_dates"), F.bool_or(full).alias("dirty_full"))


def feed_keys(body: Column) -> Column:
    """Identity keys of the entries of an RSS, Atom or HTML feed."""
    text = F.coalesce(body, F.lit(""))
    guids = F.regexp_extract_all(text, F.lit(r"(?is)<(?:guid|id)\b[^>]*>\s*(.*?)\s*</(?:guid|id)>"))
    links = F.regexp_extract_all(text, F.lit(r"(?is)<link>\s*(.*?)\s*</link>"))
    anchors = F.regexp_extract_all(text, F.lit(r'(?is)<a\b[^>]*href="([^"]+)"'))
    return F.array_distinct(F.when(F.size(guids) > 0, guids).when(F.size(links) > 0, links).otherwise(anchors))


def after_watermark(rows: DataFrame, state: DataFrame, key: str, modified: str, slack_seconds: int = 1) -> DataFrame:
    """Rows modified after their source's watermark, less some slack; a source without one is at its baseline and yields none."""
    joined = rows.join(state.select(key, "watermark"), key)
    return joined.where(F.unix_micros(modified) > F.unix_micros("watermark") - slack_seconds * 1_000_000).drop("watermark")


def retry_ledger(attempts: DataFrame, key: str, at: str, most: int = 5, floor_seconds: int = 3600) -> DataFrame:
    """Attempts of each key, whether they are used up, and when to try again."""
    counted = attempts.groupBy(key).agg(F.count(F.lit(1)).alias("attempts"), F.max(at).alias("last_at"))
    delay = F.least(F.lit(7 * 86400.0), floor_seconds * F.pow(F.lit(2.0), F.col("attempts") - 1)).cast("long")
    return counted.withColumn("permanent", F.col("attempts") >= most).withColumn("retry_after", F.when(F.col("attempts") < most, F.timestamp_seconds(F.unix_seconds("last_at") + delay)))


def activity(outbox: DataFrame, now: Column) -> DataFrame:
    """Counts of active, dead and ready events, and the next attempt's time, in one row."""
    live = F.col("status").isin("pending", "leased")
    return outbox.agg(
        F.count_if(live).alias("active"),
        F.count_if(F.col("status") == "dead").alias("dead"),
        F.count_if((F.col("status") == "pending") & (F.col("ready_at") <= now)).alias("ready"),
        F.min(F.when(F.col("status") == "pending", F.col("ready_at"))).alias("next_attempt"),
    )


def batch_lane(job_type: Column, date: Column, now: Column, past_days: int, future_days: int) -> Column:
    """True for meeting jobs whose date is outside the urgent window; a missing date belongs to neither lane (null)."""
    urgent = date.between(now - F.expr(f"interval {past_days} days"), now + F.expr(f"interval {future_days} days"))
    return F.when(job_type != "meeting", F.lit(False)).otherwise(~urgent)


def recovered(rows: DataFrame, status: str, heartbeat: str, now: Column, minutes: int) -> DataFrame:
    """Runs past their heartbeat closed as abandoned; others as they are."""
    late = stale(F.col(status), F.col(heartbeat), now, minutes)
    return rows.withColumn(status, F.when(late, "abandoned").otherwise(F.col(status)))


def lease(jobs: DataFrame, order: list[Column], n: int, owner: str, until: Column) -> DataFrame:
    """Up to ``n`` due jobs with their lease: a collector's batch."""
    return jobs.orderBy(*order).limit(n).withColumn("lease_owner", F.lit(owner)).withColumn("lease_until", until)
