"""Merges, change capture and queues (survey 2.8, 2.17) over derived snapshots."""

from __future__ import annotations

from pyspark.sql import functions as F

from plenum.operators import incremental, merge
from plenum.plans.base import query
from plenum.sources.tables import table, tables


def snapshots(spark, sf_dir):
    """Two states of orders: some rows go, some come, some change."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority", F.round(F.col("o_totalprice") * 100).cast("long").alias("cents"))
    before = orders.where("o_orderkey % 10 <> 1")
    status = F.when(F.col("o_orderkey") % 7 == 0, F.lit("X")).otherwise(F.col("o_orderstatus"))
    price = F.when(F.col("o_orderkey") % 11 == 0, F.lit(None)).otherwise(F.col("cents") + F.when(F.col("o_orderkey") % 5 == 0, 1).otherwise(0))
    after = orders.where("o_orderkey % 10 <> 2").withColumn("o_orderstatus", status).withColumn("cents", price)
    return before, after


SNAPSHOTS = """b AS (SELECT o_orderkey, o_orderstatus, o_orderpriority, CAST(round(o_totalprice * 100) AS BIGINT) AS cents FROM orders WHERE o_orderkey % 10 <> 1),
a AS (SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN 'X' ELSE o_orderstatus END AS o_orderstatus, o_orderpriority,
  CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE CAST(round(o_totalprice * 100) AS BIGINT) + CASE WHEN o_orderkey % 5 = 0 THEN 1 ELSE 0 END END AS cents FROM orders WHERE o_orderkey % 10 <> 2)"""


@query(
    "snapshot_diff",
    f"WITH {SNAPSHOTS} SELECT coalesce(b.o_orderkey, a.o_orderkey) AS o_orderkey, CASE WHEN b.o_orderkey IS NULL THEN 'insert' WHEN a.o_orderkey IS NULL THEN 'delete' ELSE 'update' END AS change, concat_ws(',', CASE WHEN a.o_orderstatus IS DISTINCT FROM b.o_orderstatus THEN 'o_orderstatus' END, CASE WHEN a.cents IS DISTINCT FROM b.cents THEN 'cents' END) AS fields FROM b FULL JOIN a ON a.o_orderkey = b.o_orderkey WHERE b.o_orderkey IS NULL OR a.o_orderkey IS NULL OR a.o_orderstatus IS DISTINCT FROM b.o_orderstatus OR a.cents IS DISTINCT FROM b.cents",
)
def snapshot_diff(spark, sf_dir):
    before, after = snapshots(spark, sf_dir)
    found = merge.changed_rows(before, after, ["o_orderkey"], ["o_orderstatus", "cents"])
    return found.select("o_orderkey", "change", F.array_join("fields", ",").alias("fields"))


@query(
    "revision_capture",
    f"WITH {SNAPSHOTS} SELECT a.o_orderkey, 'o_orderstatus' AS field, b.o_orderstatus AS old, a.o_orderstatus AS new FROM a JOIN b ON a.o_orderkey = b.o_orderkey WHERE a.o_orderstatus IS DISTINCT FROM b.o_orderstatus",
)
def revision_capture(spark, sf_dir):
    before, after = snapshots(spark, sf_dir)
    found = merge.revisions(before, after, ["o_orderkey"], ["o_orderstatus", "cents"])
    flat = found.select("o_orderkey", F.explode("changes").alias("field", "c")).where("field = 'o_orderstatus'")
    return flat.select("o_orderkey", "field", "c.old", "c.new")


@query(
    "freeze_upsert",
    f"WITH {SNAPSHOTS} SELECT coalesce(b.o_orderkey, a.o_orderkey) AS o_orderkey, CASE WHEN b.o_orderpriority = '1-URGENT' THEN b.o_orderstatus ELSE coalesce(a.o_orderstatus, b.o_orderstatus) END AS o_orderstatus, coalesce(b.o_orderpriority, a.o_orderpriority) AS o_orderpriority, CASE WHEN a.cents IS NULL OR b.cents >= a.cents THEN b.cents ELSE a.cents END AS cents FROM b FULL JOIN a ON a.o_orderkey = b.o_orderkey",
)
def freeze_upsert(spark, sf_dir):
    before, after = snapshots(spark, sf_dir)
    frozen = F.col("old.o_orderpriority") == "1-URGENT"
    policies = {"o_orderpriority": merge.keep, "cents": merge.largest}
    return merge.upsert(before, after, ["o_orderkey"], policies, frozen_if=frozen, frozen=["o_orderstatus"])


@query(
    "reconcile_links",
    "WITH s AS (SELECT DISTINCT l_orderkey, l_partkey % 50 AS m FROM lineitem WHERE l_linenumber <= 4), d AS (SELECT DISTINCT l_orderkey, l_partkey % 50 AS m FROM lineitem WHERE l_linenumber >= 3) SELECT 'deleted' AS action, count(*) AS n FROM (SELECT * FROM s EXCEPT SELECT * FROM d) UNION ALL SELECT 'inserted', count(*) FROM (SELECT * FROM d EXCEPT SELECT * FROM s)",
)
def reconcile_links(spark, sf_dir):
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_partkey") % 50).alias("m"))
    gone, new = merge.reconcile(items.where("l_linenumber <= 4"), items.where("l_linenumber >= 3"), ["l_orderkey", "m"])
    count = lambda df, name: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("action"), "n")
    return count(gone, "deleted").unionByName(count(new, "inserted"))


@query(
    "sponsor_links",
    "WITH s AS (SELECT o_orderkey, lower(trim(x)) AS name, min(i) AS pos FROM (SELECT o_orderkey, unnest(string_split(o_orderpriority || '-' || o_orderstatus || '-' || o_orderpriority, '-')) AS x, generate_subscripts(string_split(o_orderpriority || '-' || o_orderstatus || '-' || o_orderpriority, '-'), 1) - 1 AS i FROM orders) WHERE trim(x) <> '' GROUP BY 1, 2) SELECT o_orderkey, name, CAST(pos AS INTEGER) AS pos, pos = min(pos) OVER (PARTITION BY o_orderkey) AS is_primary FROM s",
)
def sponsor_links(spark, sf_dir):
    names = F.split(F.concat_ws("-", "o_orderpriority", "o_orderstatus", "o_orderpriority"), "-", -1)
    return merge.ordered_links(table(spark, sf_dir, "orders").select("o_orderkey", names.alias("names")), "o_orderkey", "names")


@query("insert_if_absent", "SELECT l_suppkey AS k, 'stored' AS origin FROM lineitem WHERE l_suppkey < 40 GROUP BY 1 UNION ALL SELECT s_suppkey, 'new' FROM supplier WHERE s_suppkey NOT IN (SELECT l_suppkey FROM lineitem WHERE l_suppkey < 40)")
def insert_if_absent(spark, sf_dir):
    lineitem, supplier = tables(spark, sf_dir, "lineitem", "supplier")
    stored = lineitem.where("l_suppkey < 40").select(F.col("l_suppkey").alias("k")).distinct().withColumn("origin", F.lit("stored"))
    return merge.append_absent(stored, supplier.select(F.col("s_suppkey").alias("k"), F.lit("new").alias("origin")), ["k"])


@query("counter_upsert", "SELECT user_id, count(*) AS request_count, max(ts) AS last_requested FROM events WHERE event_type = 'view' GROUP BY user_id")
def counter_upsert(spark, sf_dir):
    asked = table(spark, sf_dir, "events").where("event_type = 'view'")
    return asked.groupBy("user_id").agg(F.count(F.lit(1)).alias("request_count"), F.max("ts").alias("last_requested"))


@query(
    "desired_state_compaction",
    "WITH l AS (SELECT user_id, event_id, event_type AS version, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS before FROM events) SELECT user_id, event_id, version, version IS DISTINCT FROM before AS reopened, version <> 'error' AS open FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS n FROM l) WHERE n = 1",
)
def desired_state_compaction(spark, sf_dir):
    log = table(spark, sf_dir, "events").select("user_id", "event_id", F.col("event_type").alias("version"), (F.col("event_type") == "error").alias("gone"))
    return incremental.desired_state(log, "user_id", "event_id", "version", tombstone="gone").select("user_id", "event_id", "version", "reopened", "open")


@query(
    "unresolved_intents",
    "WITH i AS (SELECT user_id, event_id, event_type AS version FROM events WHERE event_type <> 'view'), f AS (SELECT DISTINCT user_id, 'click' AS version FROM events WHERE value > 50) SELECT i.user_id, i.event_id, i.version FROM i WHERE event_id = (SELECT max(event_id) FROM i j WHERE j.user_id = i.user_id) AND NOT EXISTS (SELECT 1 FROM f WHERE f.user_id = i.user_id AND f.version = i.version)",
)
def unresolved_intents(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    intents = events.where("event_type <> 'view'").select("user_id", "event_id", F.col("event_type").alias("version"))
    fulfilled = events.where("value > 50").select("user_id", F.lit("click").alias("version")).distinct()
    return incremental.unresolved(intents, fulfilled, "user_id", "version", "event_id").select("user_id", "event_id", "version")


@query(
    "retry_backoff_state",
    "SELECT event_id, CAST(user_id % 4 AS INTEGER) + 1 AS retry_count, CASE WHEN user_id % 4 + 1 >= 3 THEN 'dead_letter' ELSE 'pending' END AS status, CASE WHEN user_id % 4 + 1 < 3 THEN epoch(ts)::BIGINT + 30 * CAST(pow(2, user_id % 4) AS BIGINT) END AS ready_at FROM (SELECT *, date_trunc('second', ts) AS t FROM events WHERE event_type = 'error')".replace("epoch(ts)::BIGINT", "CAST(floor(epoch(ts)) AS BIGINT)"),
)
def retry_backoff_state(spark, sf_dir):
    failed = table(spark, sf_dir, "events").where("event_type = 'error'")
    state = incremental.after_failure((F.col("user_id") % 4).cast("int"), F.lit(100), F.col("ts").cast("timestamp"))
    return failed.select("event_id", state.alias("s")).select("event_id", "s.retry_count", "s.status", F.unix_seconds("s.ready_at").alias("ready_at"))


@query(
    "claim_per_lane",
    "SELECT lane, o_orderkey, CAST(place AS INTEGER) AS place FROM (SELECT CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'urgent' ELSE 'batch' END AS lane, o_orderkey, row_number() OVER (PARTITION BY CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'urgent' ELSE 'batch' END ORDER BY o_orderpriority, o_orderdate, o_orderkey) AS place FROM orders WHERE o_orderstatus = 'O') WHERE place <= 10",
)
def claim_per_lane(spark, sf_dir):
    lane = F.when(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"), "urgent").otherwise("batch")
    ready = table(spark, sf_dir, "orders").where("o_orderstatus = 'O'").withColumn("lane", lane)
    return incremental.claim(ready, "lane", [F.col("o_orderpriority"), F.col("o_orderdate"), F.col("o_orderkey")], 10).select("lane", "o_orderkey", "place")


@query(
    "row_fingerprint_diff",
    "WITH p AS (SELECT o_custkey, list_sort(list(DISTINCT o_orderstatus)) AS f FROM orders WHERE o_orderdate < TIMESTAMP '1999-01-01' GROUP BY 1), n AS (SELECT o_custkey, list_sort(list(DISTINCT o_orderstatus)) AS f FROM orders GROUP BY 1) SELECT n.o_custkey, CASE WHEN p.f IS NULL THEN 'new' ELSE 'moved' END AS change FROM n LEFT JOIN p USING (o_custkey) WHERE p.f IS NULL OR p.f <> n.f",
)
def row_fingerprint_diff(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    return incremental.row_diff(orders.where("o_orderdate < timestamp_ntz'1999-01-01'"), orders, "o_custkey", "o_orderstatus")


@query(
    "intervals",
    "SELECT user_id, n, least(86400, 900 + 600 * n) AS quiet, CAST(least(86400, 60 * pow(2, greatest(n - 1, 0))) AS BIGINT) AS failure FROM (SELECT user_id, count(*) FILTER (WHERE event_type = 'error') AS n FROM events GROUP BY 1)",
)
def intervals(spark, sf_dir):
    counts = table(spark, sf_dir, "events").groupBy("user_id").agg(F.count_if(F.col("event_type") == "error").alias("n"))
    return counts.select("user_id", "n", incremental.quiet_interval(F.col("n"), 900, 600, 86400).alias("quiet"), incremental.failure_interval(F.col("n"), 60, 86400).alias("failure"))


@query(
    "dirty_keys",
    "WITH c AS (SELECT user_id, min(ts) AS started_at FROM events WHERE event_type = 'purchase' GROUP BY 1) SELECT e.user_id, min(ts) AS dirty_since, count(DISTINCT CAST(ts AS DATE)) AS n_dates, bool_or(event_type = 'error') AS dirty_full FROM events e LEFT JOIN c ON c.user_id = e.user_id WHERE e.event_type <> 'purchase' AND (started_at IS NULL OR ts >= started_at) GROUP BY 1",
)
def dirty_keys(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    cleared = events.where("event_type = 'purchase'").groupBy("user_id").agg(F.min("ts").alias("started_at"))
    signals = events.where("event_type <> 'purchase'").select("user_id", "ts", F.array(F.col("ts").cast("date")).alias("dates"), (F.col("event_type") == "error").alias("full"))
    found = incremental.dirty_state(signals, "user_id", "ts", "dates", "full", cleared)
    return found.select("user_id", "dirty_since", F.size("dirty_dates").cast("long").alias("n_dates"), "dirty_full")


@query(
    "enqueue_decisions",
    "SELECT l_orderkey, NOT bool_and(l_returnflag = 'R' OR l_linestatus = 'F') AS enqueue FROM lineitem GROUP BY l_orderkey",
)
def enqueue_decisions(spark, sf_dir):
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", F.when(F.col("l_returnflag") == "R", "s").alias("summary"), F.when(F.col("l_linestatus") == "F", "f").alias("reason"))
    return merge.meeting_decision(items, "l_orderkey", "summary", "reason")
