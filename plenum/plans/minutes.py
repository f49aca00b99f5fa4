"""Votes read back from minutes (survey 2.16). The driver tables hold no minutes: they are written from orders and their lines first."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from plenum.operators import anchoring, rollcall
from plenum.plans.base import query
from plenum.sources.tables import tables

SIDE = "CASE l_returnflag WHEN 'N' THEN 'yes' WHEN 'A' THEN 'no' ELSE 'abstain' END"


def written_minutes(spark, sf_dir):
    """``texts`` (a meeting for each customer, a motion for each order, a vote for each line), ``starts`` of items, and ``roster``.

    A third of the motions have their lists after the result with the count behind the names, a third before it with
    the count in front and a tally (one in seven of these wrong), the rest a tally alone. Lists wrap after every second name.
    """
    orders, lines = tables(spark, sf_dir, "orders", "lineitem")
    name = F.initcap(F.translate(F.lpad(F.col("l_suppkey").cast("string"), 7, "0"), "0123456789", "abcdefghij"))
    votes = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select("o_custkey", "o_orderkey", "o_orderstatus", "l_linenumber", "l_suppkey", name.alias("name"), F.expr(SIDE).alias("side"))
    listed = lambda s: F.transform(F.array_sort(F.collect_list(F.when(F.col("side") == s, F.struct("l_linenumber", "name")))), lambda x: x["name"])
    per_order = votes.groupBy("o_custkey", "o_orderkey").agg(F.first("o_orderstatus").alias("status"), *[listed(s).alias(s) for s in ("yes", "no", "abstain")])
    shape = F.col("o_orderkey") % 3
    verb = F.when(F.col("status") == "F", "carried").when(F.col("status") == "O", "failed").otherwise("passed")
    wrong = ((shape == 1) & (F.col("o_orderkey") % 7 == 0)).cast("int")
    n = {s: F.size(s).cast("string") for s in ("yes", "no", "abstain")}
    stated = (F.size("yes") + wrong).cast("string")

    def blob(side):
        wrapped = F.transform(side, lambda x, i: F.concat(x, F.when(i == F.size(side) - 1, "").when(i % 2 == 1, ",\n          ").otherwise(", ")))
        return F.when(F.size(side) == 0, "None").otherwise(F.array_join(wrapped, ""))

    heads = {"yes": "Ayes", "no": "Noes", "abstain": "Abstain"}
    behind = F.concat(*[F.concat(F.lit(f"\n     {heads[s]}: "), blob(s), F.lit(" ("), n[s], F.lit(")")) for s in heads])
    front = F.concat(*[F.concat(F.lit(f"     {heads[s]}:  "), n[s], F.lit(" - "), blob(s), F.lit("\n\n")) for s in heads])
    told = (
        F.when(shape == 0, F.concat(F.lit("The clerk read it. The motion "), verb, F.lit(" by the following\n  vote:\n"), behind))
        .when(shape == 1, F.concat(F.lit("The clerk read the whole of the order and all of its lines aloud.\n\n"), front, F.lit("Motion "), verb, F.lit(" "), stated, F.lit("/"), n["no"]))
        .otherwise(F.concat(F.lit("Motion "), verb, F.lit(" ("), n["yes"], F.lit("-"), n["no"], F.lit(").")))
    )
    item = F.concat(F.lit("Order "), F.col("o_orderkey").cast("string"), F.lit(" of the day\n"), told)
    texts = per_order.groupBy(F.col("o_custkey").alias("meeting_id")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", item.alias("text")))), lambda x: x["text"]), "\n\n").alias("text"))
    starts = rollcall.numbered_lines(texts).withColumn("item_id", F.regexp_extract("line", r"^Order (\d+) of the day$", 1)).where("item_id <> ''").select("meeting_id", "line_no", "item_id")
    roster = votes.select(F.col("o_custkey").alias("meeting_id"), F.concat(F.lit("S"), F.col("l_suppkey").cast("string")).alias("member"), F.concat(F.lit("Ada "), F.col("name")).alias("name")).distinct()
    return texts, starts, roster


@query(
    "vote_evidence",
    f"""WITH l AS (SELECT o_custkey AS meeting_id, o_orderkey, o_orderstatus, l_suppkey, {SIDE} AS side, o_orderkey % 3 = 1 AND o_orderkey % 7 = 0 AS wrong FROM orders JOIN lineitem ON l_orderkey = o_orderkey),
    o AS (SELECT meeting_id, o_orderkey, any_value(o_orderstatus) AS status, any_value(wrong) AS wrong, count(*) FILTER (side = 'yes') + CASE WHEN any_value(wrong) THEN 1 ELSE 0 END AS y, count(*) FILTER (side = 'no') AS n FROM l GROUP BY 1, 2)
    SELECT meeting_id, CAST(o_orderkey AS VARCHAR) AS item_id, 'outcome' AS claim, CASE WHEN status = 'O' THEN 'failed' ELSE 'passed' END AS value, NULL AS member, NULL AS withheld FROM o
    UNION ALL SELECT meeting_id, CAST(o_orderkey AS VARCHAR), 'tally', y || '-' || n, NULL, CASE WHEN y = 0 AND n = 0 THEN 'all_zero' WHEN wrong THEN 'tally_contradicts_lists' END FROM o
    UNION ALL SELECT meeting_id, CAST(o_orderkey AS VARCHAR), 'vote', side, 'S' || l_suppkey, CASE WHEN wrong THEN 'tally_contradicts_lists' WHEN count(*) OVER (PARTITION BY o_orderkey, l_suppkey) > 1 THEN 'listed_twice' END FROM l WHERE o_orderkey % 3 < 2""",
)
def vote_evidence(spark, sf_dir):
    """Minutes are written from the tables and read back: every outcome, tally and vote returns, and what is wrong or double is held back."""
    return rollcall.claims(*written_minutes(spark, sf_dir)).select("meeting_id", "item_id", "claim", "value", "member", "withheld")


def minutes_with_decoys(spark, sf_dir):
    """``meetings`` and ``items``: a meeting for each customer, an item for each order in the order of its key.

    The text first lists all items backwards; the body of an item names the title of the next one before that begins. A
    quarter of the items each has a file number, a code in the title, an agenda number, and a title that wraps.
    """
    (orders,) = tables(spark, sf_dir, "orders")
    letters = lambda c: F.translate(F.lpad(F.col(c).cast("string"), 7, "0"), "0123456789", "abcdefghij")
    key, shape = F.lpad(F.col("o_orderkey").cast("string"), 7, "0"), F.col("o_orderkey") % 4
    order = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    head = F.concat(F.when(shape == 1, F.concat(F.lit("ORD"), key, F.lit(" "))).otherwise(""), F.lit("Purchase of "), letters("o_orderkey"), F.lit(" goods"))
    tail = F.concat(F.lit("from x"), letters("o_custkey"), F.lit(" under "), F.regexp_replace("o_orderpriority", "[^A-Za-z]", ""), F.lit(" terms"))
    rows = orders.select(
        F.col("o_custkey").alias("meeting_id"), F.col("o_orderkey").alias("item_id"), F.row_number().over(order).alias("sequence"),
        F.when(shape == 0, F.concat(F.lit("RES 95-"), key)).alias("matter_file"), F.when(shape == 2, F.row_number().over(order).cast("string")).alias("agenda_number"),
        F.concat_ws(" ", head, tail).alias("title"), F.when(shape == 3, F.concat_ws("\n", head, tail)).otherwise(F.concat_ws(" ", head, tail)).alias("printed"),
    )
    following = F.lead("title").over(Window.partitionBy("meeting_id").orderBy("sequence"))
    rows = rows.withColumn("body", F.concat(F.lit("The clerk read it"), F.coalesce(F.concat(F.lit("; it was heard together with "), following), F.lit(""))))
    listed = F.concat(F.lit("Deferred last week: "), F.col("title"), F.coalesce(F.concat(F.lit(" ("), F.col("matter_file"), F.lit(")")), F.lit("")))
    begun = F.concat(F.coalesce(F.concat(F.col("matter_file"), F.lit(": ")), F.concat(F.col("agenda_number"), F.lit(". ")), F.lit("")), F.col("printed"), F.lit("\n"), F.col("body"))
    parts = rows.groupBy("meeting_id").agg(F.array_sort(F.collect_list(F.struct("sequence", listed.alias("listed"), begun.alias("begun")))).alias("p"))
    text = F.concat_ws("\n", F.lit("Minutes of the meeting"), F.array_join(F.reverse(F.transform("p", lambda x: x["listed"])), "\n"), F.array_join(F.transform("p", lambda x: x["begun"]), "\n"))
    return parts.select("meeting_id", text.alias("text")), rows.select("meeting_id", "item_id", "sequence", "matter_file", "agenda_number", "title")


@query(
    "item_anchors",
    """SELECT o_custkey AS meeting_id, o_orderkey AS item_id, CASE o_orderkey % 4 WHEN 0 THEN 'file' WHEN 1 THEN 'code' ELSE 'title' END AS kind,
        CAST(1 + count(*) OVER (PARTITION BY o_custkey) + coalesce(sum(CASE WHEN o_orderkey % 4 = 3 THEN 3 ELSE 2 END) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS INTEGER) AS line_no
    FROM orders""",
)
def item_anchors(spark, sf_dir):
    """Every item is anchored at its own heading, neither where the list names it nor where the item before does."""
    return anchoring.anchors(*minutes_with_decoys(spark, sf_dir)).select("meeting_id", "item_id", "kind", "line_no")
