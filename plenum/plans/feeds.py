"""Platform feeds (survey 1.14, 2.23, 17.1-17.3): orders are published as saved responses of three platforms and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from plenum.plans.base import query
from plenum.sources import feeds
from plenum.sources.commits import shared_folder
from plenum.sources.tables import table

PER_RESPONSE = 200  # records of one response


def saved(spark, sf_dir) -> str:
    """A folder of responses: each order is a meeting of one of three platforms, some of them faulty."""
    orders = table(spark, sf_dir, "orders")
    key, name, at = F.col("o_orderkey"), F.concat(F.lit("Body "), F.col("o_orderpriority")), F.col("o_orderdate")
    page = F.floor(key / PER_RESPONSE)
    listed = lambda x: F.array_sort(F.collect_list(F.struct(key.alias("k"), x.alias("x"))))
    event = F.struct(key.alias("EventId"), F.when(key % 11 == 0, " ").otherwise(name).alias("EventBodyName"), F.date_format(at, "yyyy-MM-dd'T'00:00:00").alias("EventDate"), F.lit("6:30 PM").alias("EventTime"))
    clerk = F.struct(key.alias("id"), name.alias("eventName"), F.when(key % 13 == 0, "soon").otherwise(F.date_format(at, "yyyy-MM-dd'T'18:30:00'Z'")).alias("startDateTime"))
    when = F.when(key % 17 == 0, "TBA").otherwise(F.concat(F.date_format(at, "MMMM d, yyyy"), F.lit(" - 06:30 PM")))
    row = F.concat(F.lit('<tr class="listingRow"><td class="listItem">'), name, F.lit('</td><td class="listItem">'), when, F.lit('</td><td><a href="//g.example/AgendaViewer.php?view_id=2&amp;clip_id='), key.cast("string"), F.lit('">Agenda</a></td></tr>'))
    parts = []
    for vendor, kind, which, record in (("legistar", "events", 0, event), ("civicclerk", "events", 1, clerk), ("granicus", "listing", 2, row)):
        pages = orders.where(key % 3 == which).groupBy(page.alias("page")).agg(listed(record).alias("rows"))
        inner = F.transform("rows", lambda r: r["x"])
        body = F.to_json(inner) if vendor == "legistar" else F.to_json(F.struct(inner.alias("value"))) if vendor == "civicclerk" else F.concat(F.lit("<table>"), F.array_join(inner, ""), F.lit("</table>"))
        parts.append(pages.select(F.lit(vendor).alias("vendor"), F.lit("oak").alias("city"), F.lit(kind).alias("kind"), F.lit("https://g.example/list").alias("url"), F.lit("2025-01-01").alias("fetched_at"), body.alias("body")))
    path = shared_folder(spark, "feeds")
    for part in parts:
        feeds.publish(spark, path, part)
    return path


@query(
    "vendor_feeds",
    """SELECT CASE o_orderkey % 3 WHEN 0 THEN 'legistar' WHEN 1 THEN 'civicclerk' ELSE 'granicus' END AS vendor, CAST(o_orderkey AS VARCHAR) AS vendor_id,
      CASE WHEN o_orderkey % 3 = 0 AND o_orderkey % 11 = 0 THEN NULL ELSE 'Body ' || o_orderpriority END AS title,
      CASE WHEN (o_orderkey % 3 = 1 AND o_orderkey % 13 = 0) OR (o_orderkey % 3 = 2 AND o_orderkey % 17 = 0) THEN NULL ELSE strftime(o_orderdate, '%Y-%m-%d') || ' 18:30' END AS start,
      CASE WHEN o_orderkey % 3 = 0 AND o_orderkey % 11 = 0 THEN 'title' WHEN (o_orderkey % 3 = 1 AND o_orderkey % 13 = 0) OR (o_orderkey % 3 = 2 AND o_orderkey % 17 = 0) THEN 'start' END AS failed
    FROM orders""",
)
def vendor_feeds(spark, sf_dir):
    """Every order comes back from its platform's parser, the faulty ones from quarantine with the reason."""
    good, bad = feeds.meetings(feeds.responses(spark, saved(spark, sf_dir)))
    every = feeds.current(good).withColumn("failed", F.lit(None).cast("string")).unionByName(bad.withColumn("failed", F.array_join("failed", ",")))
    return every.select("vendor", "vendor_id", "title", F.date_format("start", "yyyy-MM-dd HH:mm").alias("start"), "failed")
