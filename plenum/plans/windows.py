"""Ranking, first and last, gap filling and nested timelines (survey 2.5, 2.12)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from plenum.operators.keyed import gaps_and_islands, latest_per_key
from plenum.operators.series import numbering_runs, weekly_counts
from plenum.plans.base import query
from plenum.sources.tables import table, tables


@query(
    "weekly_trend_gapfill",
    "WITH b AS (SELECT date_trunc('week', max(ts)) AS hi FROM events), s AS (SELECT unnest(generate_series((SELECT hi FROM b)::TIMESTAMP - INTERVAL 56 DAY, (SELECT hi FROM b)::TIMESTAMP - INTERVAL 7 DAY, INTERVAL 7 DAY)) AS week) SELECT CAST(CAST(s.week AS DATE) AS VARCHAR) AS week, count(e.event_id) AS n, count(DISTINCT e.user_id) AS users FROM s LEFT JOIN events e ON date_trunc('week', e.ts) = s.week GROUP BY 1",
)
def weekly_trend_gapfill(spark, sf_dir):
    """Eight complete weeks before the newest one, zero where nothing happened."""
    return weekly_counts(table(spark, sf_dir, "events"), "ts", "event_id", "user_id", weeks=8)


@query("latest_per_key", "SELECT o_custkey, o_orderkey, o_orderdate FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC NULLS LAST, o_orderkey DESC) AS n FROM orders) WHERE n = 1")
def latest_rows(spark, sf_dir):
    order = [F.col("o_orderdate").desc_nulls_last(), F.desc("o_orderkey")]
    return latest_per_key(table(spark, sf_dir, "orders"), ["o_custkey"], order).select("o_custkey", "o_orderkey", "o_orderdate")


@query(
    "drift_last_two",
    "WITH r AS (SELECT user_id, event_type, json_extract_string(props, '$.k') AS k, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) SELECT a.user_id, b.event_type AS old_type, a.event_type AS new_type, a.k IS DISTINCT FROM b.k AS moved FROM r a JOIN r b ON a.user_id = b.user_id AND a.n = 1 AND b.n = 2 WHERE a.event_type IS DISTINCT FROM b.event_type",
)
def drift_last_two(spark, sf_dir):
    """Newest two audits of each entity, next to each other by a lead instead of a self join."""
    events = table(spark, sf_dir, "events").select("user_id", "event_id", "ts", "event_type", F.get_json_object("props", "$.k").alias("k"))
    newest = latest_per_key(events, ["user_id"], [F.desc("ts"), F.desc("event_id")], n=2, rank="n")
    order = Window.partitionBy("user_id").orderBy("n")
    pairs = newest.withColumn("old_type", F.lead("event_type").over(order)).withColumn("old_k", F.lead("k").over(order)).where("n = 1 and old_type is not null")
    changed = pairs.where(~F.col("event_type").eqNullSafe(F.col("old_type")))
    return changed.select("user_id", "old_type", F.col("event_type").alias("new_type"), (~F.col("k").eqNullSafe(F.col("old_k"))).alias("moved"))


@query("round_robin_interleave", "SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS turn FROM documents")
def round_robin_interleave(spark, sf_dir):
    """Every row with its turn; read in order of turn and source, the sources take turns."""
    turn = F.row_number().over(Window.partitionBy("source").orderBy("doc_id"))
    return table(spark, sf_dir, "documents").select("doc_id", "source", turn.cast("long").alias("turn"))


@query(
    "best_record_dedup",
    "SELECT l_orderkey, m, l_linenumber FROM (SELECT l_orderkey, l_partkey % 3 AS m, l_linenumber, row_number() OVER (PARTITION BY l_orderkey, l_partkey % 3 ORDER BY (l_returnflag = 'R')::INT * 2 + (l_quantity > 25)::INT + (l_discount > 0.05)::INT DESC, l_linenumber) AS n FROM lineitem) WHERE n = 1",
)
def best_record_dedup(spark, sf_dir):
    score = (F.col("l_returnflag") == "R").cast("int") * 2 + (F.col("l_quantity") > 25).cast("int") + (F.col("l_discount") > 0.05).cast("int")
    items = table(spark, sf_dir, "lineitem").withColumn("m", F.col("l_partkey") % 3)
    return latest_per_key(items, ["l_orderkey", "m"], [score.desc(), F.col("l_linenumber")]).select("l_orderkey", "m", "l_linenumber")


@query(
    "mode_per_group",
    "SELECT c_nationkey, o_orderpriority, n FROM (SELECT c_nationkey, o_orderpriority, count(*) AS n, row_number() OVER (PARTITION BY c_nationkey ORDER BY count(*) DESC, o_orderpriority) AS r FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2) WHERE r = 1",
)
def mode_per_group(spark, sf_dir):
    orders, customer = tables(spark, sf_dir, "orders", "customer")
    counts = orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).groupBy("c_nationkey", "o_orderpriority").agg(F.count(F.lit(1)).alias("n"))
    return latest_per_key(counts, ["c_nationkey"], [F.desc("n"), F.col("o_orderpriority")])


@query(
    "paged_nested_timeline",
    "WITH p AS (SELECT p_partkey FROM part WHERE p_size = 10 ORDER BY p_partkey LIMIT 20 OFFSET 5) SELECT p_partkey, o_orderkey, o_orderdate, row_number() OVER (PARTITION BY p_partkey ORDER BY o_orderdate, o_orderkey, l_linenumber) AS place FROM p JOIN lineitem ON l_partkey = p_partkey JOIN orders ON o_orderkey = l_orderkey",
)
def paged_nested_timeline(spark, sf_dir):
    """Page first, then join and nest; shown flattened."""
    part, lineitem, orders = tables(spark, sf_dir, "part", "lineitem", "orders")
    page = part.where("p_size = 10").select("p_partkey").orderBy("p_partkey").offset(5).limit(20)
    rows = lineitem.join(F.broadcast(page), F.col("l_partkey") == F.col("p_partkey")).join(orders, F.col("o_orderkey") == F.col("l_orderkey"))
    nested = rows.groupBy("p_partkey").agg(F.array_sort(F.collect_list(F.struct("o_orderdate", "o_orderkey", "l_linenumber"))).alias("timeline"))
    flat = nested.select("p_partkey", F.posexplode("timeline").alias("i", "t"))
    return flat.select("p_partkey", "t.o_orderkey", "t.o_orderdate", (F.col("i") + 1).cast("long").alias("place"))


@query(
    "status_runs",
    "WITH a AS (SELECT o_custkey, o_orderstatus, row_number() OVER w AS p, row_number() OVER w - row_number() OVER (PARTITION BY o_custkey, o_orderstatus ORDER BY o_orderdate, o_orderkey) AS g FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)) SELECT o_custkey, o_orderstatus, CAST(min(p) AS INTEGER) AS first_at, CAST(max(p) AS INTEGER) AS last_at, count(*) AS length FROM a GROUP BY o_custkey, o_orderstatus, g",
)
def status_runs(spark, sf_dir):
    return gaps_and_islands(table(spark, sf_dir, "orders"), ["o_custkey"], "o_orderstatus", [F.col("o_orderdate"), F.col("o_orderkey")])


@query(
    "conversation_fold",
    "SELECT conv_id, count(*) AS turns, string_agg(role, '>' ORDER BY turn, role) AS roles, CAST(sum(length(text)) AS BIGINT) AS chars FROM conversations GROUP BY conv_id",
)
def conversation_fold(spark, sf_dir):
    turns = F.array_sort(F.collect_list(F.struct("turn", "role")))
    folded = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count(F.lit(1)).alias("turns"), turns.alias("t"), F.sum(F.length("text")).alias("chars"))
    return folded.select("conv_id", "turns", F.array_join(F.transform("t", lambda x: x["role"]), ">").alias("roles"), "chars")


@query("numbering_runs")
def numbering_run_starts(spark, sf_dir):
    """Starts of runs in which numbers count up, one series a user."""
    events = table(spark, sf_dir, "events").select(F.col("user_id").alias("series"), F.col("ts").cast("date").alias("day"), F.get_json_object("props", "$.k").try_cast("int").alias("number"))
    return numbering_runs(events.where("number is not null"))


@query("array_helpers", "SELECT event_id, CAST(list_sum([CAST(x AS INTEGER) FOR x IN string_split(replace(CAST(user_id AS VARCHAR), '0', '1'), '')]) AS BIGINT) AS digit_sum, len(string_split(event_type, 'i')) AS parts FROM events")
def array_helpers(spark, sf_dir):
    digits = F.split(F.regexp_replace(F.translate(F.col("user_id").cast("string"), "0", "1"), "(?<=.)(?=.)", ","), ",", -1)
    total = F.aggregate(F.transform(digits, lambda d: d.cast("long")), F.lit(0).cast("long"), lambda a, d: a + d)
    return table(spark, sf_dir, "events").select("event_id", total.alias("digit_sum"), F.size(F.split("event_type", "i", -1)).cast("long").alias("parts"))
