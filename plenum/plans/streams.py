"""Timed keyed state (survey 17.2, 17.9) over the event table, run as a stream to its end."""

from __future__ import annotations

from pyspark.sql import functions as F

from plenum.plans.base import query
from plenum.sources.commits import shared_folder
from plenum.sources.tables import table
from plenum.streaming import timed

PARTS = 6  # files the events arrive in, by time
KEEP = 86400  # seconds after which a user is forgotten


@query(
    "timed_intents",
    f"""WITH e AS (SELECT CAST(user_id AS VARCHAR) AS key, epoch_us(ts) AS generation, arg_min(event_type, event_id) AS version FROM events GROUP BY 1, 2),
    l AS (SELECT *, lag(version) OVER w AS before, lag(generation) OVER w AS then_ FROM e WINDOW w AS (PARTITION BY key ORDER BY generation))
    SELECT key, generation, version, 'accepted' AS change FROM l WHERE then_ IS NULL OR generation - then_ > {KEEP}000000 OR version <> before""",
)
def timed_intents(spark, sf_dir):
    """Each event is an intent of its user; those that change the user's state are accepted, whatever the order within a day."""
    events = table(spark, sf_dir, "events")
    rows = events.groupBy("user_id", "ts").agg(F.min_by("event_type", "event_id").alias("version"))
    at = F.col("ts").cast("timestamp")
    rows = rows.select(F.col("user_id").cast("string").alias("key"), at.alias("at"), F.unix_micros(at).alias("generation"), "version").persist()
    path = shared_folder(spark, "timed")
    low, high = rows.agg(F.min("generation"), F.max("generation")).first()
    width = (high - low) // PARTS + 1 if low is not None else 1
    for part in range(PARTS):  # one after another, so that they arrive in this order
        rows.where(F.floor((F.col("generation") - F.lit(low)) / width) == part).coalesce(1).write.parquet(f"{path}/in/{part}")
    end = rows.agg(F.lit("").alias("key"), (F.max("at") + F.expr("interval 30 days")).alias("at"), F.lit(0).cast("long").alias("generation"), F.lit("").alias("version")).where("at is not null")
    end.write.parquet(f"{path}/in/{PARTS}")  # moves the watermark past all events
    schema = rows.schema
    rows.unpersist()
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/in/*")
    with timed.rocksdb(spark):
        run = timed.accepted_intents(stream, "1 day", KEEP).writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/ck").trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.schema("key string, generation long, version string, change string").parquet(f"{path}/out")
