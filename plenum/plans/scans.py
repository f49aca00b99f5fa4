"""Scans, predicates, sorts and paging (survey 2.1, 2.2, 2.6)."""

from __future__ import annotations

from pyspark.sql import functions as F

from plenum.operators.keyed import in_caller_order
from plenum.plans.base import query
from plenum.sources.tables import table, tables


@query("entity_timeline", "SELECT o_orderkey, o_custkey, o_orderdate, o_orderstatus FROM orders WHERE o_custkey = 370 ORDER BY o_orderdate DESC NULLS LAST, o_orderkey LIMIT 20 OFFSET 2")
def entity_timeline(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").where("o_custkey = 370")
    return orders.select("o_orderkey", "o_custkey", "o_orderdate", "o_orderstatus").orderBy(F.col("o_orderdate").desc_nulls_last(), "o_orderkey").offset(2).limit(20)


@query("recent_scan", "SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderdate IS NOT NULL ORDER BY o_orderdate DESC, o_orderkey LIMIT 50")
def recent_scan(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").where("o_orderdate is not null")
    return orders.select("o_orderkey", "o_orderdate").orderBy(F.desc("o_orderdate"), "o_orderkey").limit(50)


@query(
    "date_range_scan",
    "SELECT o_orderkey, o_orderdate, o_orderstatus FROM orders WHERE o_orderdate BETWEEN TIMESTAMP '1997-03-01' AND TIMESTAMP '1997-04-30' AND (o_orderstatus IS NULL OR o_orderstatus NOT IN ('P')) ORDER BY o_orderdate, o_orderkey",
)
def date_range_scan(spark, sf_dir):
    inside = F.col("o_orderdate").between(F.lit("1997-03-01").cast("timestamp_ntz"), F.lit("1997-04-30").cast("timestamp_ntz"))
    open_ = F.col("o_orderstatus").isNull() | ~F.col("o_orderstatus").isin("P")
    return table(spark, sf_dir, "orders").where(inside & open_).select("o_orderkey", "o_orderdate", "o_orderstatus").orderBy("o_orderdate", "o_orderkey")


@query(
    "batch_key_scan",
    "SELECT p_partkey, p_name, p_brand FROM parts_wanted w JOIN part p ON p.p_partkey = w.k".replace("parts_wanted w", "(SELECT unnest([11, 7, 1999, 7777777, 3]) AS k) w"),
)
def batch_key_scan(spark, sf_dir):
    part = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand")
    return in_caller_order(part, "p_partkey", [11, 7, 1999, 7777777, 3]).drop("position")


def cities(df, **filters):
    """Only the filters that are given apply; a null filter means any value."""
    for column, value in filters.items():
        if value is not None:
            df = df.where(F.col(column) == value)
    return df


@query("dynamic_predicates", "SELECT c_custkey, c_name, c_mktsegment FROM customer WHERE c_mktsegment = 'BUILDING' AND c_nationkey = 7")
def dynamic_predicates(spark, sf_dir):
    found = cities(table(spark, sf_dir, "customer"), c_mktsegment="BUILDING", c_nationkey=7, c_name=None)
    return found.select("c_custkey", "c_name", "c_mktsegment")


@query(
    "seeded_sample_row",
    "SELECT o_orderkey, o_orderdate FROM orders o WHERE EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey AND l_quantity > 45) ORDER BY md5('seed-1:' || o_orderkey), o_orderkey LIMIT 1",
)
def seeded_sample_row(spark, sf_dir):
    orders, lineitem = tables(spark, sf_dir, "orders", "lineitem")
    rich = orders.join(lineitem.where("l_quantity > 45"), orders.o_orderkey == lineitem.l_orderkey, "left_semi")
    return rich.orderBy(F.md5(F.concat(F.lit("seed-1:"), F.col("o_orderkey").cast("string"))), "o_orderkey").limit(1).select("o_orderkey", "o_orderdate")


@query(
    "null_safe_change_filter",
    "SELECT o_orderkey, o_orderstatus FROM orders WHERE (CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_orderstatus END) IS DISTINCT FROM (CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_orderstatus END)",
)
def null_safe_change_filter(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    old = F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderstatus"))
    new = F.when(F.col("o_orderkey") % 5 != 0, F.col("o_orderstatus"))
    return orders.where(~old.eqNullSafe(new)).select("o_orderkey", "o_orderstatus")


@query(
    "text_predicates",
    "SELECT p_partkey, contains(p_name, 'a') AS has_a, p_name ILIKE '%A%' AS like_a, CAST(regexp_extract(p_brand, '^Brand#([0-9]{1,6})$', 1) AS INTEGER) AS series FROM part WHERE regexp_matches(p_brand, '^Brand#[0-9]{1,6}$')",
)
def text_predicates(spark, sf_dir):
    part = table(spark, sf_dir, "part").where(F.col("p_brand").rlike("^Brand#[0-9]{1,6}$"))
    series = F.regexp_extract("p_brand", "^Brand#([0-9]{1,6})$", 1).cast("int")
    return part.select("p_partkey", F.col("p_name").contains("a").alias("has_a"), F.col("p_name").ilike("%A%").alias("like_a"), series.alias("series"))


@query("json_key_exists", "SELECT event_id, json_extract_string(props, '$.k') IS NOT NULL AS has_k, json_extract_string(props, '$.chunk') IS NOT NULL AS has_chunk FROM events WHERE event_type = 'error'")
def json_key_exists(spark, sf_dir):
    events = table(spark, sf_dir, "events").where("event_type = 'error'")
    return events.select("event_id", F.get_json_object("props", "$.k").isNotNull().alias("has_k"), F.get_json_object("props", "$.chunk").isNotNull().alias("has_chunk"))


@query("nulls_first_sort", "SELECT o_orderkey, d FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 11 <> 0 THEN o_orderdate END AS d FROM orders) ORDER BY d DESC NULLS FIRST, o_orderkey LIMIT 100")
def nulls_first_sort(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 11 != 0, F.col("o_orderdate")).alias("d"))
    return orders.orderBy(F.col("d").desc_nulls_first(), "o_orderkey").limit(100)


def clamp_limit(value: int | None, most: int = 100, default: int = 50) -> int:
    """A caller's limit brought into 1..most; none means the default."""
    return max(1, min(most, default if value is None else int(value)))


@query("paged_with_total", "SELECT p_partkey, p_name, CAST(count(*) OVER () AS BIGINT) AS total FROM part WHERE p_size >= 25 ORDER BY p_partkey LIMIT 100 OFFSET 100")
def paged_with_total(spark, sf_dir):
    found = table(spark, sf_dir, "part").where("p_size >= 25")
    page = found.select("p_partkey", "p_name").orderBy("p_partkey").offset(100).limit(clamp_limit(5000))
    return page.crossJoin(F.broadcast(found.agg(F.count(F.lit(1)).alias("total"))))


@query("priority_queue_order", "SELECT o_orderkey, CAST(left(o_orderpriority, 1) AS INTEGER) AS priority, o_orderdate FROM orders WHERE o_orderstatus = 'O' ORDER BY priority DESC, o_orderdate, o_orderkey LIMIT 25")
def priority_queue_order(spark, sf_dir):
    ready = table(spark, sf_dir, "orders").where("o_orderstatus = 'O'")
    return ready.select("o_orderkey", F.substring("o_orderpriority", 1, 1).cast("int").alias("priority"), "o_orderdate").orderBy(F.desc("priority"), "o_orderdate", "o_orderkey").limit(25)


@query(
    "proximity_priority",
    "SELECT o_orderkey, CAST(greatest(0, 150 - abs(date_diff('day', DATE '1998-08-02', CAST(o_orderdate AS DATE)))) AS INTEGER) AS meeting_priority, CAST(greatest(-100, 50 - date_diff('day', CAST(o_orderdate AS DATE), DATE '1998-08-02')) AS INTEGER) AS matter_priority FROM orders",
)
def proximity_priority(spark, sf_dir):
    days = F.date_diff(F.lit("1998-08-02").cast("date"), F.col("o_orderdate").cast("date"))
    meeting, matter = F.greatest(F.lit(0), 150 - F.abs(days)), F.greatest(F.lit(-100), 50 - days)
    return table(spark, sf_dir, "orders").select("o_orderkey", meeting.alias("meeting_priority"), matter.alias("matter_priority"))


@query("distinct_topics", "SELECT DISTINCT p_brand, p_size FROM part WHERE p_type LIKE '%STEEL%' OR p_size < 5")
def distinct_topics(spark, sf_dir):
    return table(spark, sf_dir, "part").where(F.col("p_type").contains("STEEL") | (F.col("p_size") < 5)).select("p_brand", "p_size").distinct()
