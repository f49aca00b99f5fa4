"""Opinion clustering (survey 2.18) on derived votes."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from plenum.operators import opinions
from plenum.plans.base import query
from plenum.sources.tables import table, tables


@query(
    "vote_matrix_consensus",
    "WITH v AS (SELECT o_custkey AS user_id, p_size AS comment_id, CAST(sign(CAST(sum(CASE l_returnflag WHEN 'R' THEN 1 WHEN 'A' THEN -1 ELSE 0 END) AS BIGINT)) AS BIGINT) AS vote FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN part ON p_partkey = l_partkey GROUP BY 1, 2), m AS (SELECT comment_id, CAST(sum(vote) AS BIGINT) / count(*) AS mean FROM v GROUP BY 1), g AS (SELECT u.user_id, m.comment_id, coalesce(v.vote, m.mean) AS value FROM (SELECT DISTINCT user_id FROM v) u CROSS JOIN m LEFT JOIN v ON v.user_id = u.user_id AND v.comment_id = m.comment_id), c AS (SELECT user_id % 3 AS cluster, comment_id, count(*) FILTER (WHERE value = 1) AS agree, count(*) FILTER (WHERE value = -1) AS disagree, count(*) AS seen FROM g GROUP BY 1, 2) SELECT comment_id, round(avg((agree + 1) / (seen + 2)), 6) AS consensus, CAST(sum(agree) AS BIGINT) AS agree, CAST(sum(disagree) AS BIGINT) AS disagree FROM c GROUP BY 1",
)
def vote_matrix_consensus(spark, sf_dir):
    lineitem, orders, part = tables(spark, sf_dir, "lineitem", "orders", "part")
    rows = lineitem.join(orders, F.col("o_orderkey") == F.col("l_orderkey")).join(part, F.col("p_partkey") == F.col("l_partkey"))
    side = F.when(F.col("l_returnflag") == "R", 1).when(F.col("l_returnflag") == "A", -1).otherwise(0)
    votes = rows.groupBy(F.col("o_custkey").alias("user_id"), F.col("p_size").alias("comment_id")).agg(F.signum(F.sum(side)).cast("long").alias("vote"))
    groups, score = opinions.consensus(votes, votes.select("user_id", (F.col("user_id") % 3).alias("cluster")).distinct())
    totals = groups.groupBy("comment_id").agg(F.sum("agree").alias("agree"), F.sum("disagree").alias("disagree"))
    return score.join(totals, "comment_id").select("comment_id", F.round("consensus", 6).alias("consensus"), "agree", "disagree")


@query("opinion_clusters")
def opinion_clusters(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").where("vec_id is not null").select("vec_id", array_to_vector(F.col("embedding").cast("array<double>")).alias("features"))
    labelled = opinions.clusters(opinions.project(rows), k=5)
    return opinions.centers(labelled)
