"""Join shapes (survey 2.3) and set operations (2.7) on the driver tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from plenum.operators.keyed import asof_backward, children_or_self, latest_per_key, members_at, nearest_within, preferred, unique_by_key
from plenum.plans.base import query
from plenum.sources.tables import table, tables


@query(
    "multiway_inner_join",
    "SELECT l_orderkey, l_linenumber, c_name, n_name FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE l_quantity >= 49",
)
def multiway_inner_join(spark, sf_dir):
    lineitem, orders, customer, nation = tables(spark, sf_dir, "lineitem", "orders", "customer", "nation")
    rows = lineitem.where("l_quantity >= 49").join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    rows = rows.join(customer, F.col("o_custkey") == F.col("c_custkey")).join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    return rows.select("l_orderkey", "l_linenumber", "c_name", "n_name")


@query(
    "left_join_chain",
    "SELECT c_custkey, o_orderkey, l_linenumber FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_orderstatus = 'P' LEFT JOIN lineitem ON l_orderkey = o_orderkey AND l_quantity > 40 WHERE c_nationkey = 3",
)
def left_join_chain(spark, sf_dir):
    customer, orders, lineitem = tables(spark, sf_dir, "customer", "orders", "lineitem")
    rows = customer.where("c_nationkey = 3").join(orders.where("o_orderstatus = 'P'"), F.col("o_custkey") == F.col("c_custkey"), "left")
    rows = rows.join(lineitem.where("l_quantity > 40"), F.col("l_orderkey") == F.col("o_orderkey"), "left")
    return rows.select("c_custkey", "o_orderkey", "l_linenumber")


@query(
    "recurring_having",
    "SELECT p_partkey, count(l_orderkey) AS appearances, min(l_shipdate) AS first_seen, max(l_shipdate) AS last_seen FROM part LEFT JOIN lineitem ON l_partkey = p_partkey GROUP BY p_partkey HAVING count(l_orderkey) >= 2 OR count(l_orderkey) = 0",
)
def recurring_having(spark, sf_dir):
    part, lineitem = tables(spark, sf_dir, "part", "lineitem")
    seen = lineitem.groupBy("l_partkey").agg(F.count(F.lit(1)).alias("n"), F.min("l_shipdate").alias("first_seen"), F.max("l_shipdate").alias("last_seen"))
    rows = part.join(seen, F.col("p_partkey") == F.col("l_partkey"), "left").withColumn("appearances", F.coalesce("n", F.lit(0)).cast("long"))
    return rows.where("appearances >= 2 or appearances = 0").select("p_partkey", "appearances", "first_seen", "last_seen")


@query("semi_join_exists", "SELECT p_partkey, p_name FROM part WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_discount > 0.08)")
def semi_join_exists(spark, sf_dir):
    part, lineitem = tables(spark, sf_dir, "part", "lineitem")
    return part.join(lineitem.where("l_discount > 0.08"), F.col("p_partkey") == F.col("l_partkey"), "left_semi").select("p_partkey", "p_name")


@query(
    "exists_or_direct",
    "SELECT o_orderkey FROM orders WHERE o_totalprice > 300000 OR EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R' AND l_quantity > 40)",
)
def exists_or_direct(spark, sf_dir):
    orders, lineitem = tables(spark, sf_dir, "orders", "lineitem")
    marked = lineitem.where("l_returnflag = 'R' and l_quantity > 40").select("l_orderkey").distinct().withColumn("hit", F.lit(True))
    return orders.join(marked, F.col("o_orderkey") == F.col("l_orderkey"), "left").where("o_totalprice > 300000 or hit").select("o_orderkey")


@query("anti_join_orphans", "SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 400000)")
def anti_join_orphans(spark, sf_dir):
    customer, orders = tables(spark, sf_dir, "customer", "orders")
    return customer.join(orders.where("o_totalprice > 400000"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey", "c_name")


@query(
    "not_in_null_safe",
    "SELECT l_orderkey, l_linenumber FROM (SELECT *, CASE WHEN l_linenumber <> 4 THEN l_partkey END AS k FROM lineitem) WHERE k IS NULL OR k NOT IN (SELECT p_partkey FROM part WHERE p_size < 40 AND p_partkey IS NOT NULL)",
)
def not_in_null_safe(spark, sf_dir):
    lineitem, part = tables(spark, sf_dir, "lineitem", "part")
    rows = lineitem.withColumn("k", F.when(F.col("l_linenumber") != 4, F.col("l_partkey")))
    small = part.where("p_size < 40 and p_partkey is not null")
    return rows.join(small, F.col("k") == F.col("p_partkey"), "left_anti").select("l_orderkey", "l_linenumber")


@query(
    "anti_join_inequality",
    "SELECT o_orderkey, o_custkey FROM orders o WHERE o_orderstatus = 'O' AND NOT EXISTS (SELECT 1 FROM orders e WHERE e.o_custkey = o.o_custkey AND e.o_orderstatus = 'O' AND e.o_orderkey < o.o_orderkey)",
)
def anti_join_inequality(spark, sf_dir):
    open_ = table(spark, sf_dir, "orders").where("o_orderstatus = 'O'")
    return open_.groupBy("o_custkey").agg(F.min("o_orderkey").alias("o_orderkey")).select("o_orderkey", "o_custkey")


@query(
    "evidence_preference",
    "SELECT l_orderkey, l_linenumber, l_linestatus FROM lineitem v WHERE l_linestatus = 'F' OR NOT EXISTS (SELECT 1 FROM lineitem m WHERE m.l_orderkey = v.l_orderkey AND m.l_partkey % 10 = v.l_partkey % 10 AND m.l_linestatus = 'F')",
)
def evidence_preference(spark, sf_dir):
    votes = table(spark, sf_dir, "lineitem").withColumn("matter", F.col("l_partkey") % 10)
    return preferred(votes, ["l_orderkey", "matter"], "l_linestatus", "F").select("l_orderkey", "l_linenumber", "l_linestatus")


@query(
    "correlated_scalar_count",
    "SELECT o_orderkey, (SELECT count(*) FROM lineitem WHERE l_orderkey = o_orderkey AND l_tax > 0.04) AS n_items FROM orders WHERE o_orderstatus = 'P'",
)
def correlated_scalar_count(spark, sf_dir):
    orders, lineitem = tables(spark, sf_dir, "orders", "lineitem")
    counts = lineitem.where("l_tax > 0.04").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"))
    rows = orders.where("o_orderstatus = 'P'").join(counts, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    return rows.select("o_orderkey", F.coalesce("n", F.lit(0)).cast("long").alias("n_items"))


@query(
    "lateral_latest_child",
    "SELECT c_custkey, a.o_orderkey, a.o_orderdate, b.latest FROM customer, LATERAL (SELECT o_orderkey, o_orderdate FROM orders WHERE o_custkey = c_custkey ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 1) a, LATERAL (SELECT max(o_orderdate) AS latest FROM orders WHERE o_custkey = c_custkey AND o_orderstatus <> 'P') b WHERE b.latest >= TIMESTAMP '1999-01-01'",
)
def lateral_latest_child(spark, sf_dir):
    customer, orders = tables(spark, sf_dir, "customer", "orders")
    newest = latest_per_key(orders, ["o_custkey"], [F.desc("o_orderdate"), F.desc("o_orderkey")]).select("o_custkey", "o_orderkey", "o_orderdate")
    latest = orders.where("o_orderstatus <> 'P'").groupBy("o_custkey").agg(F.max("o_orderdate").alias("latest")).where(F.col("latest") >= F.lit("1999-01-01").cast("timestamp_ntz"))
    rows = newest.join(latest, "o_custkey").join(customer.select("c_custkey"), F.col("o_custkey") == F.col("c_custkey"))
    return rows.select("c_custkey", "o_orderkey", "o_orderdate", "latest")


@query(
    "lateral_topic_union",
    "SELECT topic, count(*) AS votes, count(*) FILTER (WHERE l_returnflag = 'R') AS yes, count(*) FILTER (WHERE l_returnflag = 'A') AS no FROM lineitem JOIN (SELECT p_partkey AS k, split_part(p_type, ' ', 1) AS topic FROM part UNION SELECT p_partkey, p_brand FROM part) t ON t.k = l_partkey GROUP BY topic",
)
def lateral_topic_union(spark, sf_dir):
    lineitem, part = tables(spark, sf_dir, "lineitem", "part")
    topics = part.select(F.col("p_partkey").alias("k"), F.split_part("p_type", F.lit(" "), F.lit(1)).alias("topic")).union(part.select("p_partkey", "p_brand")).distinct()
    rows = lineitem.join(topics, F.col("l_partkey") == F.col("k"))
    return rows.groupBy("topic").agg(F.count(F.lit(1)).alias("votes"), F.count_if(F.col("l_returnflag") == "R").alias("yes"), F.count_if(F.col("l_returnflag") == "A").alias("no"))


@query(
    "unnest_children",
    "SELECT event_id, t.pos - 1 AS pos, t.part FROM (SELECT event_id, unnest(list_zip(generate_series(1, len(a)), a)) AS z FROM (SELECT event_id, string_split(event_type || ',' || user_id, ',') AS a FROM events WHERE event_type = 'signup')) , LATERAL (SELECT z[1] AS pos, z[2] AS part) t",
)
def unnest_children(spark, sf_dir):
    events = table(spark, sf_dir, "events").where("event_type = 'signup'")
    parts = F.split(F.concat("event_type", F.lit(","), F.col("user_id").cast("string")), ",", -1)
    return events.select("event_id", F.posexplode(parts).alias("pos", "part")).select("event_id", F.col("pos").cast("long").alias("pos"), "part")


@query(
    "crossed_totals",
    "SELECT a.n_orders, b.n_items, c.n_parts, b.n_items / a.n_orders AS per_order FROM (SELECT count(*) AS n_orders FROM orders) a, (SELECT count(*) AS n_items FROM lineitem) b, (SELECT count(*) AS n_parts FROM part) c",
)
def crossed_totals(spark, sf_dir):
    one = lambda t, n: table(spark, sf_dir, t).agg(F.count(F.lit(1)).alias(n))  # noqa: E731  one row each
    return one("orders", "n_orders").crossJoin(one("lineitem", "n_items")).crossJoin(one("part", "n_parts")).withColumn("per_order", F.col("n_items") / F.col("n_orders"))


@query(
    "bounds_row_filter",
    "SELECT event_id, ts FROM events, (SELECT date_trunc('day', max(ts)) - INTERVAL 3 DAY AS lo, date_trunc('day', max(ts)) AS hi FROM events) b WHERE ts >= lo AND ts < hi AND event_type = 'purchase'",
)
def bounds_row_filter(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    bounds = events.agg(F.date_trunc("day", F.max("ts")).cast("timestamp_ntz").alias("hi"))
    rows = events.where("event_type = 'purchase'").crossJoin(F.broadcast(bounds))  # one row
    return rows.where((F.col("ts") >= F.expr("hi - interval 3 days")) & (F.col("ts") < F.col("hi"))).select("event_id", "ts")


@query(
    "county_members_or",
    "SELECT DISTINCT r.r_regionkey, n.n_nationkey FROM region r JOIN nation n ON n.n_nationkey = r.r_regionkey OR n.n_regionkey = r.r_regionkey",
)
def county_members_or(spark, sf_dir):
    region, nation = tables(spark, sf_dir, "region", "nation")
    found = children_or_self(region.select("r_regionkey"), "r_regionkey", nation, "n_nationkey", "n_regionkey")
    return found.select("r_regionkey", F.col("member").alias("n_nationkey"))


@query(
    "interval_membership",
    "WITH m AS (SELECT user_id, event_id, ts AS joined_at, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS left_at FROM events WHERE event_type = 'signup'), p AS (SELECT event_id AS at_id, user_id, ts FROM events WHERE event_type = 'purchase') SELECT p.at_id, m.event_id FROM p JOIN m ON m.user_id = p.user_id AND m.joined_at <= p.ts AND (m.left_at IS NULL OR p.ts < m.left_at)",
)
def interval_membership(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    members = events.where("event_type = 'signup'").select("user_id", "event_id", F.col("ts").alias("joined_at"), F.lead("ts").over(order).alias("left_at"))
    points = events.where("event_type = 'purchase'").select(F.col("event_id").alias("at_id"), "user_id", "ts")
    return members_at(members, points, "user_id", "joined_at", "left_at", "ts").select("at_id", "event_id")


@query(
    "asof_prior_appearance",
    "SELECT o.o_orderkey, (SELECT max_by(p.o_orderkey, (p.o_orderdate, p.o_orderkey)) FROM orders p WHERE p.o_custkey = o.o_custkey AND p.o_orderstatus <> 'O' AND p.o_orderdate < o.o_orderdate) AS prior_key FROM orders o WHERE o.o_orderstatus = 'O'",
)
def asof_prior_appearance(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    targets = orders.where("o_orderstatus = 'O'").select("o_orderkey", "o_custkey", "o_orderdate")
    summarized = orders.where("o_orderstatus <> 'O'").select("o_custkey", "o_orderdate", F.col("o_orderkey").alias("prior_key"), F.lpad(F.col("o_orderkey").cast("string"), 20, "0").alias("tie"))
    return asof_backward(targets, summarized, ["o_custkey"], "o_orderdate", "o_orderdate", ["prior_key"], "tie", strict=True).select("o_orderkey", "prior_key")


@query(
    "nearest_within_window",
    "WITH a AS (SELECT * FROM orders WHERE o_orderstatus = 'P'), r AS (SELECT a.o_orderkey AS k, b.o_orderkey AS sibling, abs(date_diff('day', CAST(b.o_orderdate AS DATE), CAST(a.o_orderdate AS DATE))) AS distance FROM a JOIN orders b ON b.o_custkey = a.o_custkey AND b.o_orderstatus = 'F' WHERE abs(date_diff('day', CAST(b.o_orderdate AS DATE), CAST(a.o_orderdate AS DATE))) <= 120) SELECT k, sibling, CAST(distance AS INTEGER) AS distance FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY distance, sibling) AS n FROM r) WHERE n = 1",
)
def nearest_within_window(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    left = orders.where("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("k"), F.col("o_custkey").alias("c"), F.col("o_orderdate").alias("d"))
    right = orders.where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("sibling"), "o_custkey", "o_orderdate")
    days = F.abs(F.date_diff(F.col("o_orderdate").cast("date"), F.col("d").cast("date")))
    return nearest_within(left, right, [F.col("c") == F.col("o_custkey")], "k", days, 120, [F.col("sibling").asc()]).select("k", "sibling", "distance")


@query(
    "natural_key_unique",
    "SELECT o_custkey, CAST(d AS VARCHAR) AS d, o_orderkey FROM (SELECT o_custkey, CAST(o_orderdate AS DATE) AS d, min(o_orderkey) AS o_orderkey, count(DISTINCT o_orderkey) AS n FROM orders GROUP BY 1, 2) WHERE n = 1",
)
def natural_key_unique(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").withColumn("d", F.col("o_orderdate").cast("date"))
    return unique_by_key(orders, ["o_custkey", "d"], "o_orderkey").withColumn("d", F.col("d").cast("string"))


@query(
    "minutes_null_item_rule",
    "WITH v AS (SELECT l_orderkey, l_linenumber, l_partkey % 7 AS matter, CASE WHEN l_linenumber <> 1 THEN l_linenumber END AS item, l_linestatus AS src FROM lineitem) SELECT l_orderkey, l_linenumber FROM v WHERE src = 'F' OR NOT EXISTS (SELECT 1 FROM v m WHERE m.src = 'F' AND m.l_orderkey = v.l_orderkey AND m.matter = v.matter AND (v.item IS NULL OR m.item = v.item))",
)
def minutes_null_item_rule(spark, sf_dir):
    item = F.when(F.col("l_linenumber") != 1, F.col("l_linenumber"))
    votes = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_partkey") % 7).alias("matter"), item.alias("item"), F.col("l_linestatus").alias("src"))
    best = F.col("src") == "F"
    by_matter = F.coalesce(F.max(best).over(Window.partitionBy("l_orderkey", "matter")), F.lit(False))
    by_item = F.coalesce(F.max(best & F.col("item").isNotNull()).over(Window.partitionBy("l_orderkey", "matter", "item")), F.lit(False))
    hidden = F.when(F.col("item").isNull(), by_matter).otherwise(by_item)
    return votes.withColumn("hidden", hidden).where(best | ~F.col("hidden")).select("l_orderkey", "l_linenumber")


@query("union_live_keys", "SELECT c_nationkey AS k FROM customer WHERE c_acctbal > 9000 UNION SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000")
def union_live_keys(spark, sf_dir):
    customer, supplier = tables(spark, sf_dir, "customer", "supplier")
    return customer.where("c_acctbal > 9000").select(F.col("c_nationkey").alias("k")).union(supplier.where("s_acctbal > 5000").select("s_nationkey")).distinct()


@query("set_difference", "SELECT p_partkey FROM part EXCEPT SELECT l_partkey FROM lineitem WHERE l_quantity < 3")
def set_difference(spark, sf_dir):
    part, lineitem = tables(spark, sf_dir, "part", "lineitem")
    return part.select("p_partkey").distinct().join(lineitem.where("l_quantity < 3"), F.col("p_partkey") == F.col("l_partkey"), "left_anti")
