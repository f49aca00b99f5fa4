"""Data-quality audits (survey 2.21)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plenum.plans.base import query
from plenum.sources.tables import table, tables


def dangling(child: DataFrame, foreign: str, parent: DataFrame, key: str, name: str) -> DataFrame:
    """One row: how many children name a parent that is missing."""
    return child.join(parent, F.col(foreign) == F.col(key), "left_anti").agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("audit"), "n")


@query(
    "integrity_audit",
    "SELECT 'customers without orders' AS audit, count(*) AS n FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders) UNION ALL SELECT 'orders without items', count(*) FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem) UNION ALL SELECT 'items without orders', count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders) UNION ALL SELECT 'items without parts', count(*) FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part) UNION ALL SELECT 'items without suppliers', count(*) FROM lineitem WHERE l_suppkey NOT IN (SELECT s_suppkey FROM supplier) UNION ALL SELECT 'nations without regions', count(*) FROM nation WHERE n_regionkey NOT IN (SELECT r_regionkey FROM region) UNION ALL SELECT 'labels without documents', count(*) FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)",
)
def integrity_audit(spark, sf_dir):
    customer, orders, lineitem, part, supplier, nation, region, labels, docs = tables(spark, sf_dir, "customer", "orders", "lineitem", "part", "supplier", "nation", "region", "labels", "documents")
    found = [
        dangling(customer, "c_custkey", orders, "o_custkey", "customers without orders"),
        dangling(orders, "o_orderkey", lineitem, "l_orderkey", "orders without items"),
        dangling(lineitem, "l_orderkey", orders, "o_orderkey", "items without orders"),
        dangling(lineitem, "l_partkey", part, "p_partkey", "items without parts"),
        dangling(lineitem, "l_suppkey", supplier, "s_suppkey", "items without suppliers"),
        dangling(nation, "n_regionkey", region, "r_regionkey", "nations without regions"),
        dangling(labels.select(F.col("doc_id").alias("k")), "k", docs.select("doc_id"), "doc_id", "labels without documents"),
    ]
    return reduce(DataFrame.unionByName, found)


@query("duplicate_natural_keys", "SELECT p_name, p_brand, count(*) AS n, list_sort(list(p_partkey)) AS ids FROM part GROUP BY 1, 2 HAVING count(*) > 1")
def duplicate_natural_keys(spark, sf_dir):
    return table(spark, sf_dir, "part").groupBy("p_name", "p_brand").agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list("p_partkey")).alias("ids")).where("n > 1")


@query(
    "wrong_government",
    "WITH s AS (SELECT c_nationkey AS k, count(*) FILTER (WHERE c_acctbal < 0) / count(*) AS a, count(DISTINCT c_mktsegment) AS b FROM customer GROUP BY 1), t AS (SELECT s_nationkey AS k, count(*) AS c FROM supplier GROUP BY 1) SELECT n_nationkey, (coalesce(a, 0) > 0.1)::INT + (coalesce(b, 0) < 5)::INT + (coalesce(c, 0) < 3)::INT AS signals FROM nation LEFT JOIN s ON s.k = n_nationkey LEFT JOIN t ON t.k = n_nationkey",
)
def wrong_government(spark, sf_dir):
    nation, customer, supplier = tables(spark, sf_dir, "nation", "customer", "supplier")
    a = customer.groupBy(F.col("c_nationkey").alias("n_nationkey")).agg((F.count_if(F.col("c_acctbal") < 0) / F.count(F.lit(1))).alias("a"), F.count_distinct("c_mktsegment").alias("b"))
    c = supplier.groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(F.count(F.lit(1)).alias("c"))
    rows = nation.join(a, "n_nationkey", "left").join(c, "n_nationkey", "left")
    signal = lambda test: F.coalesce(test, F.lit(False)).cast("int")
    total = signal(F.coalesce("a", F.lit(0.0)) > 0.1) + signal(F.coalesce("b", F.lit(0)) < 5) + signal(F.coalesce("c", F.lit(0)) < 3)
    return rows.select("n_nationkey", total.alias("signals"))


@query("host_mismatch", "SELECT regexp_extract(url, '^https?://([^/?#]+)', 1) AS host, count(*) AS n FROM pages WHERE NOT regexp_matches(url, '^https?://[^/?#]*\\.example\\.com([/?#]|$)') GROUP BY 1")
def host_mismatch(spark, sf_dir):
    host = F.parse_url(F.col("url"), F.lit("HOST"))
    pages = table(spark, sf_dir, "pages").withColumn("host", host).where(~F.col("host").endswith(".example.com"))
    return pages.groupBy("host").agg(F.count(F.lit(1)).alias("n"))


@query("flagged_parents", "SELECT l_orderkey, count(*) AS items, count(*) FILTER (WHERE l_quantity < 3) AS short, count(*) - count(DISTINCT l_partkey) AS repeats FROM lineitem GROUP BY 1 HAVING count(*) FILTER (WHERE l_quantity < 3) > 1 OR count(*) - count(DISTINCT l_partkey) > 0")
def flagged_parents(spark, sf_dir):
    stats = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("items"), F.count_if(F.col("l_quantity") < 3).alias("short"), (F.count(F.lit(1)) - F.count_distinct("l_partkey")).alias("repeats"))
    return stats.where("short > 1 or repeats > 0")


@query("health_check", "SELECT c_mktsegment, count(*) AS cities, count(*) FILTER (WHERE n = 0) AS empty, CAST(coalesce(sum(n), 0) AS BIGINT) AS meetings FROM (SELECT c_mktsegment, c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1, 2) GROUP BY 1")
def health_check(spark, sf_dir):
    customer, orders = tables(spark, sf_dir, "customer", "orders")
    counts = orders.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"))
    rows = customer.join(counts, F.col("c_custkey") == F.col("o_custkey"), "left").fillna(0, ["n"])
    return rows.groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("cities"), F.count_if(F.col("n") == 0).alias("empty"), F.sum("n").alias("meetings"))


@query("token_estimate")
def token_estimate(spark, sf_dir):
    """Tokens of a corpus extrapolated from a seeded stratified sample, which is what this operator is for."""
    docs = table(spark, sf_dir, "documents").select("lang", F.length("text").alias("n"), (F.length("text") / 4).alias("tokens"))
    part = docs.sampleBy("lang", {"en": 0.1, "fr": 0.3, "de": 0.3, "es": 0.3}, seed=7).groupBy("lang").agg((F.sum("tokens") / F.sum("n")).alias("rate"))
    return docs.groupBy("lang").agg(F.sum("n").alias("chars")).join(part, "lang", "left").select("lang", (F.col("chars") * F.col("rate")).alias("tokens"))
