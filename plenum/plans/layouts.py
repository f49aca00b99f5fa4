"""Profiles of documents given as pages, links and outlines (survey 15.16)."""

from __future__ import annotations

from pyspark.sql import functions as F

from plenum.operators import layouts
from plenum.plans.base import query
from plenum.sources.tables import tables


@query(
    "document_profiles",
    r"""WITH p AS (SELECT doc_id // 20 AS packet, doc_id, doc_id % 20 + 1 AS page, (doc_id % 9 + 1) || '. ' || coalesce(text, '') AS text FROM documents)
    SELECT packet AS doc_id, max(page) AS page_count, least(max(page), 15) AS scanned_pages,
        CAST(coalesce(sum(length(regexp_replace(text, '^\s+|\s+$', '', 'g'))) FILTER (page <= 5), 0) AS BIGINT) AS text_chars,
        coalesce(sum(length(regexp_replace(text, '^\s+|\s+$', '', 'g'))) FILTER (page <= 5), 0) >= 50 AS has_text_layer,
        CAST(coalesce(sum(len(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '^\s*(?:\d{1,3}\.(?:\d{1,2}|[a-zA-Z])[.)]?|\d{1,3}[.)]|[A-Z][.)]|[IVXLC]{1,6}[.)])\s+\S')))) FILTER (page <= 15), 0) AS BIGINT) AS item_number_lines,
        count(*) FILTER (page <= 15 AND doc_id % 3 = 0) AS external_links, count(*) FILTER (page <= 15 AND doc_id % 5 = 0) AS internal_links,
        coalesce(string_agg(CAST(page AS VARCHAR), ',' ORDER BY page) FILTER (page <= 15 AND (doc_id % 3 = 0 OR doc_id % 5 = 0)), '') AS link_pages,
        count(*) FILTER (doc_id % 4 = 0) AS toc_entries, count(*) FILTER (doc_id % 4 = 0 AND doc_id % 8 > 0) AS toc_real_entries,
        count(DISTINCT page) FILTER (doc_id % 4 = 0 AND doc_id % 8 > 0) AS toc_distinct_pages, coalesce(max(doc_id % 3 + 1) FILTER (doc_id % 4 = 0), 0) AS toc_max_depth
    FROM p GROUP BY packet""",
)
def document_profiles(spark, sf_dir):
    """Twenty documents make a packet, a page each; links and outline entries follow from their ids."""
    (documents,) = tables(spark, sf_dir, "documents")
    rows = documents.select(F.expr("doc_id div 20").alias("doc_id"), (F.col("doc_id") % 20 + 1).alias("page"), F.col("doc_id").alias("id"), F.concat((F.col("doc_id") % 9 + 1).cast("string"), F.lit(". "), F.coalesce("text", F.lit(""))).alias("text"))
    kinds = F.filter(F.array(F.when(F.col("id") % 3 == 0, "uri"), F.when(F.col("id") % 5 == 0, "internal")), lambda k: k.isNotNull())
    links = rows.select("doc_id", "page", F.explode(kinds).alias("kind"))
    outline = rows.where("id % 4 = 0").select("doc_id", (F.col("id") % 3 + 1).alias("level"), F.when(F.col("id") % 8 == 0, -1).otherwise(F.col("page")).alias("page"))
    return layouts.profiles(rows, links, outline).drop("toc_depth_counts").withColumn("link_pages", F.array_join("link_pages", ","))
