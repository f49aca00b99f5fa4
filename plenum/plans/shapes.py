"""Repaired shapes and the spatial join (survey 3.26, 14.1, 14.2). The driver tables hold no shapes: rings are laid through rows first."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plenum.operators import shapes
from plenum.plans.base import query
from plenum.sources.tables import table

FINE = 1e-9  # doubled areas are compared as whole numbers (whole corners make halves), so corners are kept finer than in practice
SIDE = 40  # of a zone's square

ODD_AREA = """, ends AS (SELECT * FROM edges),
  crossed AS (SELECT a.id, a.px + (a.qx - a.px) * ((b.px - a.px) * (b.qy - b.py) - (b.py - a.py) * (b.qx - b.px))
              / ((a.qx - a.px) * (b.qy - b.py) - (a.qy - a.py) * (b.qx - b.px)) AS x, a.px, a.qx, b.px AS bpx, b.qx AS bqx
      FROM ends a JOIN ends b ON a.id = b.id WHERE (a.qx - a.px) * (b.qy - b.py) - (a.qy - a.py) * (b.qx - b.px) <> 0),
  xs AS (SELECT id, x FROM crossed WHERE x BETWEEN least(px, qx) AND greatest(px, qx) AND x BETWEEN least(bpx, bqx) AND greatest(bpx, bqx)
      UNION SELECT id, px FROM ends UNION SELECT id, qx FROM ends),
  slabs AS (SELECT id, x AS low, lead(x) OVER (PARTITION BY id ORDER BY x) AS high FROM xs),
  walls AS (SELECT s.id, low, high, layer, py + ((low + high) / 2 - px) * (qy - py) / (qx - px) AS y
      FROM slabs s JOIN ends e ON s.id = e.id AND least(px, qx) <= (low + high) / 2 AND greatest(px, qx) > (low + high) / 2),
  steps AS (SELECT id, low, high, lead(y) OVER w - y AS tall, sum(layer % 2) OVER u AS one, sum(layer // 2) OVER u AS two FROM walls
      WINDOW w AS (PARTITION BY id, low ORDER BY y, layer), u AS (PARTITION BY id, low ORDER BY y, layer ROWS UNBOUNDED PRECEDING))"""


def routes(spark, sf_dir) -> DataFrame:
    """A shape for each customer: the ring through its orders, places taken from their keys; most cross themselves."""
    corner = F.array((F.col("o_orderkey") * 7919 % 1009).cast("double"), (F.col("o_orderkey") * 6271 % 1013).cast("double"))
    kept = table(spark, sf_dir, "orders").where("o_custkey IS NOT NULL AND o_orderkey IS NOT NULL").select("o_custkey", F.struct("o_orderkey", corner.alias("corner")).alias("stop"))
    ordered = F.transform(F.array_sort(F.collect_list("stop")), lambda s: s["corner"])
    return kept.groupBy(F.col("o_custkey").alias("id")).agg(F.array(ordered).alias("polygon"))


@query(
    "shape_repair",
    "WITH stops AS (SELECT o_custkey AS id, o_orderkey, (o_orderkey * 7919 % 1009)::DOUBLE AS px, (o_orderkey * 6271 % 1013)::DOUBLE AS py FROM orders WHERE o_custkey IS NOT NULL AND o_orderkey IS NOT NULL), "
    "edges AS (SELECT id, 1 AS layer, px, py, coalesce(lead(px) OVER w, first_value(px) OVER w) AS qx, coalesce(lead(py) OVER w, first_value(py) OVER w) AS qy FROM stops "
    "WINDOW w AS (PARTITION BY id ORDER BY o_orderkey, px, py ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))"
    + ODD_AREA
    + ", areas AS (SELECT id, sum((high - low) * tall) AS area FROM steps WHERE one % 2 = 1 GROUP BY id) "
    "SELECT i.id AS custkey, round(2 * coalesce(area, 0))::BIGINT AS doubled FROM (SELECT DISTINCT id FROM stops) i LEFT JOIN areas a ON a.id = i.id",
)
def shape_repair(spark, sf_dir):
    """Twice the area of each customer's route once it is made valid."""
    return shapes.repaired(routes(spark, sf_dir), grain=FINE).select(F.col("id").alias("custkey"), F.round(2 * shapes.area(F.col("polygons")), 0).cast("long").alias("doubled"))


def zones(spark, sf_dir) -> DataFrame:
    """A bow tie for each supplier: a square's corners in an order that crosses itself."""
    at = lambda dx, dy: F.array((F.col("s_suppkey") * 97 % 971 + dx).cast("double"), (F.col("s_suppkey") * 61 % 977 + dy).cast("double"))
    ring = F.array(at(0, 0), at(SIDE, SIDE), at(SIDE, 0), at(0, SIDE))
    return table(spark, sf_dir, "supplier").where("s_suppkey IS NOT NULL").select(F.col("s_suppkey").alias("id"), F.array(ring).alias("polygon"))


def lots(spark, sf_dir) -> DataFrame:
    """A triangle for each part, up to 60 wide."""
    at = lambda dx, dy: F.array((F.col("p_partkey") * 89 % 983 + dx).cast("double"), (F.col("p_partkey") * 53 % 991 + dy).cast("double"))
    wide = F.col("p_partkey") % 50 + 11
    return table(spark, sf_dir, "part").where("p_partkey IS NOT NULL").select(F.col("p_partkey").alias("id"), F.array(F.array(at(0, 0), at(wide, 7), at(5, wide))).alias("polygon"))


@query(
    "zone_lots",
    f"WITH s AS (SELECT s_suppkey AS zone, (s_suppkey * 97 % 971)::DOUBLE AS x, (s_suppkey * 61 % 977)::DOUBLE AS y FROM supplier WHERE s_suppkey IS NOT NULL), "
    "p AS (SELECT p_partkey AS lot, (p_partkey * 89 % 983)::DOUBLE AS x, (p_partkey * 53 % 991)::DOUBLE AS y, (p_partkey % 50 + 11)::DOUBLE AS wide FROM part WHERE p_partkey IS NOT NULL), "
    f"near AS (SELECT zone, lot, s.x AS sx, s.y AS sy, p.x AS lx, p.y AS ly, wide, zone * 10000000 + lot AS id FROM s JOIN p ON p.x <= s.x + {SIDE} AND s.x <= p.x + wide AND p.y <= s.y + {SIDE} AND s.y <= p.y + wide), "
    f"corners AS (SELECT id, unnest([1, 1, 1, 1, 2, 2, 2]) AS layer, unnest([sx, sx + {SIDE}, sx + {SIDE}, sx, lx, lx + wide, lx + 5]) AS px, unnest([sy, sy + {SIDE}, sy, sy + {SIDE}, ly, ly + 7, ly + wide]) AS py, "
    f"unnest([sx + {SIDE}, sx + {SIDE}, sx, sx, lx + wide, lx + 5, lx]) AS qx, unnest([sy + {SIDE}, sy, sy + {SIDE}, sy, ly + 7, ly + wide, ly]) AS qy FROM near), "
    "edges AS (SELECT * FROM corners)"
    + ODD_AREA
    + ", shared AS (SELECT id, sum((high - low) * tall) AS shared FROM steps WHERE one % 2 = 1 AND two % 2 = 1 GROUP BY id) "
    f"SELECT zone, lot, round(2 * shared)::BIGINT AS doubled FROM near JOIN shared ON shared.id = near.id WHERE shared >= 0.25003 * least({SIDE * SIDE // 2}, abs(wide * wide - 35) / 2)",
)
def zone_lots(spark, sf_dir):
    """Lots that share a quarter of the smaller area, or more, with a zone, and twice the area shared."""
    found = shapes.assign_by_area(zones(spark, sf_dir), lots(spark, sf_dir), 0.25003, 2.0 * SIDE, FINE)  # no pair lies at this share
    return found.select(F.col("left_id").alias("zone"), F.col("right_id").alias("lot"), F.round(2 * F.col("shared"), 0).cast("long").alias("doubled"))
