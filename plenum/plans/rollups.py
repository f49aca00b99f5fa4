"""Aggregations (survey 2.4) and dashboards (2.20)."""

from __future__ import annotations

from pyspark.sql import functions as F

from plenum.plans.base import query
from plenum.sources.tables import table, tables


def cents(column: str):
    """Money as whole cents: exact sums in any order."""
    return F.round(F.col(column) * 100).cast("long")


@query("popular_topics", "SELECT event_type, count(*) AS n FROM events GROUP BY event_type ORDER BY n DESC, event_type LIMIT 10")
def popular_topics(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "event_type").limit(10)


@query(
    "parent_stats_union",
    "WITH s AS (SELECT o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT' UNION SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R') SELECT n_nationkey, n_name, count(o.o_orderkey) AS total, count(CASE WHEN o.o_totalprice > 100000 THEN 1 END) AS with_packet, count(s.o_orderkey) AS summarized FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey LEFT JOIN orders o ON o.o_custkey = c_custkey LEFT JOIN s ON s.o_orderkey = o.o_orderkey GROUP BY 1, 2",
)
def parent_stats_union(spark, sf_dir):
    nation, customer, orders, lineitem = tables(spark, sf_dir, "nation", "customer", "orders", "lineitem")
    direct = orders.where("o_orderpriority = '1-URGENT'").select(F.col("o_orderkey").alias("k"))
    through = lineitem.where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("k"))
    done = direct.union(through).distinct()
    rows = orders.join(done, F.col("o_orderkey") == F.col("k"), "left").join(customer, F.col("o_custkey") == F.col("c_custkey"))
    stats = rows.groupBy("c_nationkey").agg(F.count("o_orderkey").alias("total"), F.count_if(F.col("o_totalprice") > 100000).alias("with_packet"), F.count("k").alias("summarized"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return nation.join(stats, F.col("n_nationkey") == F.col("c_nationkey"), "left").select("n_nationkey", "n_name", zero("total"), zero("with_packet"), zero("summarized"))


@query("has_any_child_flag", "SELECT l_orderkey, bool_or(l_returnflag = 'R') AS any_returned, bool_and(l_linestatus = 'F') AS all_complete FROM lineitem GROUP BY l_orderkey")
def has_any_child_flag(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.bool_or(F.col("l_returnflag") == "R").alias("any_returned"), F.bool_and(F.col("l_linestatus") == "F").alias("all_complete"))


@query(
    "filtered_rollup",
    "SELECT date_trunc('month', o_orderdate)::TIMESTAMP AS month, count(*) AS items, count(*) FILTER (WHERE l_discount > 0.05) AS discounted, count(DISTINCT o_custkey) AS customers, count(DISTINCT l_partkey) FILTER (WHERE l_returnflag = 'R') AS returned_parts, CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS BIGINT) AS cents FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1",
)
def filtered_rollup(spark, sf_dir):
    lineitem, orders = tables(spark, sf_dir, "lineitem", "orders")
    rows = lineitem.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    month = F.date_trunc("month", "o_orderdate").cast("timestamp_ntz").alias("month")
    return rows.groupBy(month).agg(
        F.count(F.lit(1)).alias("items"),
        F.count_if(F.col("l_discount") > 0.05).alias("discounted"),
        F.count_distinct("o_custkey").alias("customers"),
        F.count_distinct(F.when(F.col("l_returnflag") == "R", F.col("l_partkey"))).alias("returned_parts"),
        F.sum(cents("l_extendedprice")).alias("cents"),
    )


@query(
    "percentile_latency",
    "SELECT event_type, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, round(quantile_cont(value, 0.5) FILTER (WHERE user_id % 2 = 0), 6) AS even_p50, round(median(epoch_us(ts) / 3600000000.0), 6) AS median_hour FROM events GROUP BY event_type",
)
def percentile_latency(spark, sf_dir):
    even = F.when(F.col("user_id") % 2 == 0, F.col("value"))
    hours = F.unix_micros(F.col("ts").cast("timestamp")) / 3_600_000_000.0
    return table(spark, sf_dir, "events").groupBy("event_type").agg(
        F.round(F.percentile("value", F.lit(0.5)), 6).alias("p50"),
        F.round(F.percentile("value", F.lit(0.95)), 6).alias("p95"),
        F.round(F.percentile(even, F.lit(0.5)), 6).alias("even_p50"),
        F.round(F.median(hours), 6).alias("median_hour"),
    )


@query("percentile_sketch")
def percentile_sketch(spark, sf_dir):
    """The mergeable form for very large groups: bounded state, approximate ranks and distinct counts."""
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.percentile_approx("value", [0.5, 0.95], 10000).alias("p50_p95"), F.approx_count_distinct("user_id").alias("users"))


@query(
    "rating_histogram",
    "WITH r AS (SELECT user_id, 1 + CAST(event_id % 5 AS INTEGER) AS rating FROM events) SELECT user_id, count(*) AS ratings, round(CAST(sum(rating) AS BIGINT) / count(*), 2) AS average, count(*) FILTER (WHERE rating = 1) AS r1, count(*) FILTER (WHERE rating = 2) AS r2, count(*) FILTER (WHERE rating = 3) AS r3, count(*) FILTER (WHERE rating = 4) AS r4, count(*) FILTER (WHERE rating = 5) AS r5 FROM r GROUP BY user_id",
)
def rating_histogram(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("user_id", (1 + F.col("event_id") % 5).cast("int").alias("rating"))
    bars = [F.count_if(F.col("rating") == i).alias(f"r{i}") for i in range(1, 6)]
    return rows.groupBy("user_id").agg(F.count(F.lit(1)).alias("ratings"), F.round(F.sum("rating") / F.count(F.lit(1)), 2).alias("average"), *bars)


@query(
    "low_rated_entities",
    "SELECT user_id, CAST(sum(1 + event_id % 5) AS BIGINT) / count(*) AS average, count(*) AS ratings FROM events GROUP BY user_id HAVING CAST(sum(1 + event_id % 5) AS BIGINT) / count(*) < 2.95 AND count(*) >= 30",
)
def low_rated_entities(spark, sf_dir):
    rated = table(spark, sf_dir, "events").groupBy("user_id").agg((F.sum(1 + F.col("event_id") % 5) / F.count(F.lit(1))).alias("average"), F.count(F.lit(1)).alias("ratings"))
    return rated.where("average < 2.95 and ratings >= 30")


@query(
    "yes_rate_profile",
    "SELECT p_type AS topic, count(*) FILTER (WHERE l_returnflag = 'R') AS yes, count(*) FILTER (WHERE l_returnflag = 'A') AS no, count(*) FILTER (WHERE l_returnflag NOT IN ('R', 'A')) AS other, CASE WHEN count(*) FILTER (WHERE l_returnflag IN ('R', 'A')) > 0 THEN round(count(*) FILTER (WHERE l_returnflag = 'R') / count(*) FILTER (WHERE l_returnflag IN ('R', 'A')), 3) END AS yes_rate FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1",
)
def yes_rate_profile(spark, sf_dir):
    lineitem, part = tables(spark, sf_dir, "lineitem", "part")
    rows = lineitem.join(part, F.col("l_partkey") == F.col("p_partkey")).withColumnRenamed("p_type", "topic")
    flag = F.col("l_returnflag")
    counts = rows.groupBy("topic").agg(F.count_if(flag == "R").alias("yes"), F.count_if(flag == "A").alias("no"), F.count_if(~flag.isin("R", "A")).alias("other"))
    return counts.withColumn("yes_rate", F.when(F.col("yes") + F.col("no") > 0, F.round(F.col("yes") / (F.col("yes") + F.col("no")), 3)))


@query(
    "motion_union_rollup",
    "WITH m AS (SELECT l_orderkey AS k, 'explicit' AS kind, count(*) FILTER (WHERE l_returnflag = 'A') > 0 AND count(*) FILTER (WHERE l_returnflag = 'R') > 0 AS divided FROM lineitem WHERE l_linestatus = 'F' GROUP BY 1 UNION ALL SELECT o_orderkey, 'inferred', o_orderstatus = 'P' FROM orders WHERE o_orderpriority = '5-LOW') SELECT kind, count(*) AS motions, count(*) FILTER (WHERE divided) AS divided FROM m GROUP BY kind",
)
def motion_union_rollup(spark, sf_dir):
    lineitem, orders = tables(spark, sf_dir, "lineitem", "orders")
    ballots = lineitem.where("l_linestatus = 'F'").groupBy(F.col("l_orderkey").alias("k")).agg((F.bool_or(F.col("l_returnflag") == "A") & F.bool_or(F.col("l_returnflag") == "R")).alias("divided"))
    inferred = orders.where("o_orderpriority = '5-LOW'").select(F.col("o_orderkey").alias("k"), (F.col("o_orderstatus") == "P").alias("divided"))
    every = ballots.withColumn("kind", F.lit("explicit")).unionByName(inferred.withColumn("kind", F.lit("inferred")))
    return every.groupBy("kind").agg(F.count(F.lit(1)).alias("motions"), F.count_if("divided").alias("divided"))


@query(
    "json_metric_rollup",
    "SELECT event_type, CAST(sum(TRY_CAST(json_extract_string(props, '$.k') AS BIGINT)) AS BIGINT) AS total, count(json_extract_string(props, '$.k')) AS present, max(TRY_CAST(json_extract_string(props, '$.k') AS BIGINT)) AS most FROM events GROUP BY event_type",
)
def json_metric_rollup(spark, sf_dir):
    k = F.get_json_object("props", "$.k")
    number = k.try_cast("long")
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.sum(number).alias("total"), F.count(k).alias("present"), F.max(number).alias("most"))


@query(
    "hourly_performance",
    "SELECT date_trunc('hour', ts)::TIMESTAMP AS hour, event_type, value > 50 AS slow, count(*) AS n, CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS total FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 24 HOUR GROUP BY 1, 2, 3",
)
def hourly_performance(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    newest = events.agg(F.max("ts").alias("newest"))  # one row
    recent = events.crossJoin(F.broadcast(newest)).where(F.expr("ts >= newest - interval 24 hours"))
    hour = F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("hour")
    return recent.groupBy(hour, "event_type", (F.col("value") > 50).alias("slow")).agg(F.count(F.lit(1)).alias("n"), F.sum(cents("value")).alias("total"))


@query("ordered_ids_per_group", "SELECT o_custkey, count(*) AS n, list_sort(list(o_orderkey)) AS ids FROM orders GROUP BY o_custkey HAVING count(*) > 12")
def ordered_ids_per_group(spark, sf_dir):
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list("o_orderkey")).alias("ids")).where("n > 12")


@query("status_count_map", "SELECT o_orderpriority, count(*) FILTER (WHERE o_orderstatus = 'F') AS f, count(*) FILTER (WHERE o_orderstatus = 'O') AS o, count(*) FILTER (WHERE o_orderstatus = 'P') AS p FROM orders GROUP BY 1")
def status_count_map(spark, sf_dir):
    """Counts by status as a map, shown by its entries."""
    counts = table(spark, sf_dir, "orders").groupBy("o_orderpriority", "o_orderstatus").agg(F.count(F.lit(1)).alias("n"))
    maps = counts.groupBy("o_orderpriority").agg(F.map_from_entries(F.collect_list(F.struct("o_orderstatus", "n"))).alias("m"))
    return maps.select("o_orderpriority", *[F.coalesce(F.try_element_at("m", F.lit(s)), F.lit(0)).cast("long").alias(s.lower()) for s in "FOP"])


@query("duplicate_measure", "SELECT l_orderkey, count(*) - count(DISTINCT l_quantity) AS repeats FROM lineitem GROUP BY l_orderkey HAVING count(*) - count(DISTINCT l_quantity) > 0")
def duplicate_measure(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg((F.count(F.lit(1)) - F.count_distinct("l_quantity")).alias("repeats")).where("repeats > 0")


@query(
    "two_level_aggregate",
    "SELECT o_orderpriority, count(*) AS meetings, CAST(sum(items) AS BIGINT) AS items, round(CAST(sum(items) AS BIGINT) / count(*), 1) AS mean_items, max(items) AS most FROM (SELECT o_orderkey, o_orderpriority, count(l_orderkey) AS items FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1, 2) GROUP BY 1",
)
def two_level_aggregate(spark, sf_dir):
    orders, lineitem = tables(spark, sf_dir, "orders", "lineitem")
    counts = lineitem.groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"))
    per = orders.join(counts, F.col("o_orderkey") == F.col("l_orderkey"), "left").select("o_orderpriority", F.coalesce("n", F.lit(0)).alias("items"))
    return per.groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("meetings"), F.sum("items").alias("items"), F.round(F.sum("items") / F.count(F.lit(1)), 1).alias("mean_items"), F.max("items").alias("most"))


@query(
    "vote_tally",
    "SELECT l_orderkey, count(*) FILTER (WHERE v = 'yes') AS yes, count(*) FILTER (WHERE v = 'no') AS no, count(*) FILTER (WHERE v = 'present') AS present FROM (SELECT l_orderkey, CASE l_returnflag WHEN 'R' THEN 'yes' WHEN 'A' THEN 'no' ELSE 'present' END AS v FROM lineitem) GROUP BY 1",
)
def vote_tally(spark, sf_dir):
    known = F.create_map(F.lit("R"), F.lit("yes"), F.lit("A"), F.lit("no"))
    votes = table(spark, sf_dir, "lineitem").select("l_orderkey", F.coalesce(F.try_element_at(known, F.col("l_returnflag")), F.lit("present")).alias("v"))
    return votes.groupBy("l_orderkey").agg(*[F.count_if(F.col("v") == x).alias(x) for x in ("yes", "no", "present")])


@query("monotone_bounds", "SELECT l_orderkey, least(min(l_shipdate), min(o_orderdate)) AS first_seen, greatest(max(l_shipdate), max(o_orderdate)) AS last_seen FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1")
def monotone_bounds(spark, sf_dir):
    lineitem, orders = tables(spark, sf_dir, "lineitem", "orders")
    ships = lineitem.groupBy("l_orderkey").agg(F.min("l_shipdate").alias("a"), F.max("l_shipdate").alias("b"))
    return ships.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select("l_orderkey", F.least("a", "o_orderdate").alias("first_seen"), F.greatest("b", "o_orderdate").alias("last_seen"))


@query(
    "coverage_tiers",
    "WITH c AS (SELECT n_nationkey, n_name, (SELECT count(*) FROM supplier WHERE s_nationkey = n_nationkey AND s_acctbal > 8000) AS matters, (SELECT count(*) FROM customer WHERE c_nationkey = n_nationkey AND c_acctbal > 9900) AS items, (SELECT count(*) FROM customer WHERE c_nationkey = n_nationkey AND c_mktsegment = 'BUILDING') AS monolithic FROM nation) SELECT n_nationkey, n_name, CASE WHEN matters > 0 THEN 'matter' WHEN items > 0 THEN 'item' WHEN monolithic > 0 THEN 'monolithic' ELSE 'pending' END AS tier, CASE WHEN matters > 0 THEN matters WHEN items > 0 THEN items ELSE monolithic END AS n FROM c",
)
def coverage_tiers(spark, sf_dir):
    nation, supplier, customer = tables(spark, sf_dir, "nation", "supplier", "customer")
    rich = supplier.groupBy("s_nationkey").agg(F.count_if(F.col("s_acctbal") > 8000).alias("matters"))
    ours = customer.groupBy("c_nationkey").agg(F.count_if(F.col("c_acctbal") > 9900).alias("items"), F.count_if(F.col("c_mktsegment") == "BUILDING").alias("monolithic"))
    rows = nation.join(rich, F.col("n_nationkey") == F.col("s_nationkey"), "left").join(ours, F.col("n_nationkey") == F.col("c_nationkey"), "left").fillna(0, ["matters", "items", "monolithic"])
    tier = F.when(F.col("matters") > 0, "matter").when(F.col("items") > 0, "item").when(F.col("monolithic") > 0, "monolithic").otherwise("pending")
    n = F.when(F.col("matters") > 0, F.col("matters")).when(F.col("items") > 0, F.col("items")).otherwise(F.col("monolithic"))
    return rows.select("n_nationkey", "n_name", tier.alias("tier"), n.alias("n"))


@query(
    "infrastructure_by_city",
    "SELECT n_nationkey, n_name, (SELECT count(*) FROM customer WHERE c_nationkey = n_nationkey) AS members, (SELECT count(*) FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_nationkey = n_nationkey) AS votes, (SELECT count(*) FROM supplier WHERE s_nationkey = n_nationkey) AS committees FROM nation",
)
def infrastructure_by_city(spark, sf_dir):
    nation, customer, supplier, orders = tables(spark, sf_dir, "nation", "customer", "supplier", "orders")
    members = customer.groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count(F.lit(1)).alias("members"))
    votes = orders.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n")).join(customer, F.col("o_custkey") == F.col("c_custkey")).groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.sum("n").alias("votes"))
    bodies = supplier.groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(F.count(F.lit(1)).alias("committees"))
    rows = nation.join(members, "n_nationkey", "left").join(votes, "n_nationkey", "left").join(bodies, "n_nationkey", "left")
    return rows.fillna(0, ["members", "votes", "committees"]).select("n_nationkey", "n_name", "members", "votes", "committees")


@query(
    "sync_stats_priority",
    "WITH s AS (SELECT c_custkey, count(o_orderkey) FILTER (WHERE o_orderdate >= TIMESTAMP '2001-05-01') AS recent, max(o_orderdate) AS last_sync FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1) SELECT c_custkey, recent, last_sync, CASE WHEN last_sync IS NULL THEN 1000.0 ELSE recent * 10 + least(date_diff('second', last_sync, TIMESTAMP '2001-08-02') / 3600 / 24, 10) END AS score, CASE WHEN last_sync IS NULL THEN true WHEN recent >= 2 THEN date_diff('second', last_sync, TIMESTAMP '2001-08-02') >= 43200 WHEN recent = 1 THEN date_diff('second', last_sync, TIMESTAMP '2001-08-02') >= 86400 ELSE date_diff('second', last_sync, TIMESTAMP '2001-08-02') >= 604800 END AS due FROM s",
)
def sync_stats_priority(spark, sf_dir):
    customer, orders = tables(spark, sf_dir, "customer", "orders")
    now = F.lit("2001-08-02").cast("timestamp_ntz")
    stats = orders.groupBy("o_custkey").agg(F.count_if(F.col("o_orderdate") >= F.lit("2001-05-01").cast("timestamp_ntz")).alias("recent"), F.max("o_orderdate").alias("last_sync"))
    rows = customer.join(stats, F.col("c_custkey") == F.col("o_custkey"), "left").fillna(0, ["recent"])
    seconds = F.timestamp_diff("SECOND", F.col("last_sync"), now)
    score = F.when(F.col("last_sync").isNull(), F.lit(1000.0)).otherwise(F.col("recent") * 10 + F.least(seconds / 3600 / 24, F.lit(10.0)))
    wait = F.when(F.col("recent") >= 2, 43200).when(F.col("recent") == 1, 86400).otherwise(604800)
    return rows.select("c_custkey", "recent", "last_sync", score.alias("score"), (F.col("last_sync").isNull() | (seconds >= wait)).alias("due"))


@query(
    "importance_score",
    "SELECT o_orderkey, round(log10(o_totalprice + 1) + max(CASE l_returnflag WHEN 'R' THEN 3 WHEN 'A' THEN 2 ELSE 1 END) + CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END, 6) AS score FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey, o_totalprice, o_orderstatus",
)
def importance_score(spark, sf_dir):
    orders, lineitem = tables(spark, sf_dir, "orders", "lineitem")
    weight = F.when(F.col("l_returnflag") == "R", 3).when(F.col("l_returnflag") == "A", 2).otherwise(1)
    best = lineitem.groupBy("l_orderkey").agg(F.max(weight).alias("w"))
    score = F.round(F.log10(F.col("o_totalprice") + 1) + F.col("w") + F.when(F.col("o_orderstatus") == "F", 1).otherwise(0), 6)
    return orders.join(best, F.col("o_orderkey") == F.col("l_orderkey")).select("o_orderkey", score.alias("score"))


@query(
    "platform_metrics",
    "WITH flags AS (SELECT o_orderkey, o_orderdate, o_orderstatus, EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R') AS summarized FROM orders) SELECT count(*) AS meetings, count(*) FILTER (WHERE summarized) AS summarized, count(*) FILTER (WHERE o_orderdate >= TIMESTAMP '2001-07-02') AS last_30_days, round(count(*) FILTER (WHERE summarized) / count(*) * 100, 1) AS summarized_share FROM flags",
)
def platform_metrics(spark, sf_dir):
    """One narrow projection to flags feeds all totals."""
    orders, lineitem = tables(spark, sf_dir, "orders", "lineitem")
    returned = lineitem.where("l_returnflag = 'R'").select("l_orderkey").distinct()
    flags = orders.join(returned, F.col("o_orderkey") == F.col("l_orderkey"), "left").select("o_orderdate", F.col("l_orderkey").isNotNull().alias("summarized"))
    total, done = F.count(F.lit(1)), F.count_if("summarized")
    return flags.agg(total.alias("meetings"), done.alias("summarized"), F.count_if(F.col("o_orderdate") >= F.lit("2001-07-02").cast("timestamp_ntz")).alias("last_30_days"), F.round(done / total * 100, 1).alias("summarized_share"))


@query(
    "census_classes",
    "SELECT CASE WHEN p_size < 10 THEN 'small' WHEN p_size < 30 THEN 'middle' ELSE 'large' END AS class, count(*) AS n, count(DISTINCT p_brand) AS brands FROM part GROUP BY 1",
)
def census_classes(spark, sf_dir):
    kind = F.when(F.col("p_size") < 10, "small").when(F.col("p_size") < 30, "middle").otherwise("large")
    return table(spark, sf_dir, "part").groupBy(kind.alias("class")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("p_brand").alias("brands"))


@query(
    "flattened_recurring_topics",
    "WITH m AS (SELECT l_partkey, count(*) AS n FROM lineitem GROUP BY 1 HAVING count(*) >= 2) SELECT t.topic, count(*) AS matters, CAST(sum(n) AS BIGINT) AS appearances FROM m JOIN part ON p_partkey = l_partkey, LATERAL (SELECT unnest(string_split(p_type, ' ')) AS topic) t GROUP BY 1",
)
def flattened_recurring_topics(spark, sf_dir):
    lineitem, part = tables(spark, sf_dir, "lineitem", "part")
    often = lineitem.groupBy("l_partkey").agg(F.count(F.lit(1)).alias("n")).where("n >= 2")
    topics = often.join(part, F.col("l_partkey") == F.col("p_partkey")).select("n", F.explode(F.split("p_type", " ", -1)).alias("topic"))
    return topics.groupBy("topic").agg(F.count(F.lit(1)).alias("matters"), F.sum("n").alias("appearances"))
