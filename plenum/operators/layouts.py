"""Documents given as rows of pages, links and outline entries: what a document is made of, and items with the links below their headings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plenum.operators.documents import owner_above

# How far the front of a document is measured, and what makes a line a numbered heading.
LINK_PAGES, TEXT_PAGES, TEXT_LEAST, ITEM_PAGES = 15, 5, 50, 20
ZERO_WIDTH = "[\u200b\u200c\u200d\u2060\ufeff]"
NUMBERS = [r"\d{1,3}\.(?:\d{1,2}|[a-zA-Z])[.)]?", r"\d{1,3}[.)]", r"[A-Z][.)]", r"[IVXLC]{1,6}[.)]"]
NUMBERED = rf"^\s*(?:{'|'.join(NUMBERS)})\s+\S"


def visible(line: Column) -> Column:
    return F.regexp_replace(line, ZERO_WIDTH, "")


def profiles(pages: DataFrame, links: DataFrame, outline: DataFrame) -> DataFrame:
    """One row a document of ``pages`` (``doc_id``, ``page`` from 1, ``text``), with what ``links`` (``doc_id``, ``page``,
    ``kind``: uri or internal) and ``outline`` (``doc_id``, ``level``, ``page``, below 1 if it leads nowhere) say of it.

    Text is measured on the first pages, links and numbered lines on somewhat
    more, the outline as a whole. A null text is empty; documents without links or
    outline count none. Each table is reduced by its own key before the join.
    """
    front, sampled = F.col("page") <= LINK_PAGES, F.col("page") <= TEXT_PAGES
    text = F.coalesce("text", F.lit(""))
    headings = F.size(F.filter(F.split(text, r"\r\n|\n|\r", -1), lambda line: visible(line).rlike(NUMBERED)))
    of_pages = pages.groupBy("doc_id").agg(
        F.max("page").alias("page_count"),
        F.coalesce(F.sum(F.when(sampled, F.length(F.regexp_replace(text, r"^\s+|\s+$", "")))), F.lit(0)).alias("text_chars"),
        F.coalesce(F.sum(F.when(front, headings)), F.lit(0)).alias("item_number_lines"),
    )
    known = F.col("kind").isin("uri", "internal")
    of_links = links.where(front & known).groupBy("doc_id").agg(F.count_if(F.col("kind") == "uri").alias("external_links"), F.count_if(F.col("kind") == "internal").alias("internal_links"), F.array_sort(F.collect_set("page")).alias("link_pages"))
    leads = F.when(F.col("page") > 0, F.col("page"))
    by_level = outline.groupBy("doc_id", "level").agg(F.count(F.lit(1)).alias("n"), F.count(leads).alias("real"))
    of_levels = by_level.groupBy("doc_id").agg(F.sum("n").alias("toc_entries"), F.sum("real").alias("toc_real_entries"), F.max("level").alias("toc_max_depth"), F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col("level").cast("string"), "n")))).alias("toc_depth_counts"))
    of_targets = outline.groupBy("doc_id").agg(F.count_distinct(leads).alias("toc_distinct_pages"))
    every = of_pages.join(of_links, "doc_id", "left").join(of_levels, "doc_id", "left").join(of_targets, "doc_id", "left")
    every = every.withColumn("scanned_pages", F.least("page_count", F.lit(LINK_PAGES))).withColumn("has_text_layer", F.col("text_chars") >= TEXT_LEAST)
    every = every.withColumn("link_pages", F.coalesce("link_pages", F.array().cast(of_links.schema["link_pages"].dataType)))
    return every.na.fill(0, ["external_links", "internal_links", "toc_entries", "toc_real_entries", "toc_max_depth", "toc_distinct_pages"])


def linked_items(lines: DataFrame, links: DataFrame) -> DataFrame:
    """Items of documents (``doc_id``, ``place`` from 1, ``number``, ``title``) with the links below their headings, in order.

    ``lines`` (``doc_id``, ``page``, ``y`` growing down the page, ``text``) give
    headings on the front pages only, since further back numbers are those of
    sections and exhibits; ``links`` (``doc_id``, ``page``, ``y``, ``url``) come from
    all pages. A link beside a heading is its own; links above the first heading
    have no item and come as a row of place 0 without number.
    """
    shown = visible(F.col("text"))
    heads = lines.where((F.col("page") <= ITEM_PAGES) & shown.rlike(NUMBERED)).select("doc_id", "page", "y", F.lit(0).alias("side"), F.regexp_extract(shown, r"^\s*(\S+)", 1).alias("number"), F.trim(F.regexp_replace(shown, r"^\s*\S+\s+", "")).alias("title"))
    urls = links.where("url is not null").select("doc_id", "page", F.col("y"), F.lit(1).alias("side"), "url")
    rows = heads.unionByName(urls, allowMissingColumns=True).withColumn("at", F.struct("y", "side", F.coalesce("number", "url")))
    rows = rows.withColumn("is_heading", F.col("side") == 0).withColumn("heading", F.struct("page", "at", "number", "title"))
    owned = owner_above(rows, "page", "at", "is_heading", "heading")
    below = F.transform(F.array_sort(F.collect_list(F.when(F.col("side") == 1, F.struct("page", "at", "url")))), lambda x: x["url"])
    items = owned.groupBy("doc_id", "owner").agg(below.alias("urls"))
    w = Window.partitionBy("doc_id").orderBy(F.col("owner").asc_nulls_first())
    placed = items.withColumn("place", F.when(F.col("owner").isNull(), 0).otherwise(F.count("owner").over(w.rowsBetween(Window.unboundedPreceding, 0))))
    return placed.select("doc_id", "place", F.col("owner.number").alias("number"), F.col("owner.title").alias("title"), "urls")
