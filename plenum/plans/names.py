"""Lookup of names that are written almost like known ones (survey 9.25), and bridges between names of one member (9.11)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plenum.operators import identities
from plenum.operators.fuzzy import close_names, name_index
from plenum.plans.base import query
from plenum.sources.tables import tables


def words(df: DataFrame) -> DataFrame:
    """A row for each word, a word being a run of letters."""
    return df.select(F.explode(F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit(r"(\p{L}+)"))).alias("word"))


@query("close_words")
def close_words(spark, sf_dir):
    """For each word of the benchmark texts, the five occurrences of words in all documents that are written most like it."""
    documents, benchmark = tables(spark, sf_dir, "documents", "benchmark")
    return close_names(words(benchmark), name_index(words(documents), "word"), "word")


LETTERS = "translate(CAST({} AS STRING), '0123456789', 'abcdefghij')"


def written_roster(spark, sf_dir):
    """A roster for each nation from its customers: whole names, names without or with an initial for the middle one, last names; a third have votes."""
    (customer,) = tables(spark, sf_dir, "customer")
    word = lambda head, n: F.initcap(F.expr(f"concat('{head}', {LETTERS.format(f'c_custkey % {n}')})"))
    first, middle, last = word("x", 7), word("m", 4), word("z", 31)
    shape = F.col("c_custkey") % 5
    name = F.when(shape < 2, F.concat_ws(" ", first, middle, last)).when(shape == 2, F.concat(F.lit("Mayor "), first, F.lit(" "), last)).when(shape == 3, last).otherwise(F.concat_ws(" ", first, F.lit("M."), last))
    return customer.select(F.col("c_nationkey").alias("city"), F.col("c_custkey").alias("member_id"), name.alias("name"), (F.col("c_custkey") % 3 == 0).alias("has_votes"))


@query(
    "member_bridges",
    """WITH w AS (SELECT c_nationkey AS city, c_custkey AS member_id, c_custkey % 3 = 0 AS voted, c_custkey % 5 AS shape, 'x' || translate(CAST(c_custkey % 7 AS VARCHAR), '0123456789', 'abcdefghij') AS f, 'm' || translate(CAST(c_custkey % 4 AS VARCHAR), '0123456789', 'abcdefghij') AS m, 'z' || translate(CAST(c_custkey % 31 AS VARCHAR), '0123456789', 'abcdefghij') AS l FROM customer),
    r AS (SELECT city, member_id, voted, f, m, l, shape, CASE WHEN shape < 2 THEN f || ' ' || m || ' ' || l WHEN shape = 2 THEN f || ' ' || l WHEN shape = 3 THEN l ELSE f || ' m ' || l END AS key FROM w),
    g AS (SELECT city, key, count(*) AS n, count(*) FILTER (voted) AS n_anchors, min(member_id) FILTER (voted) AS voter, min(member_id) AS single, min(f) AS f, min(m) AS m, min(l) AS l, min(shape) AS shape FROM r GROUP BY city, key),
    a AS (SELECT city, l, min(member_id) AS other, min(key) AS whole, min(f) AS af, min(m) AS am, min(shape) AS ashape FROM r WHERE voted GROUP BY city, l HAVING count(*) = 1),
    b AS (SELECT g.city, g.key, CASE WHEN n_anchors = 1 THEN voter WHEN n = 1 THEN single END AS own, other,
        CASE WHEN n_anchors > 0 OR n > 1 OR other IS NULL THEN NULL WHEN shape = 3 AND ashape <> 3 THEN 'unique_anchor_suffix'
             WHEN shape <> 3 AND ashape <> 3 AND f = af AND (shape = 2 OR ashape = 2 OR shape = 4 OR ashape = 4 OR m = am) THEN 'unique_anchor_middle_name' END AS basis
        FROM g LEFT JOIN a ON g.city = a.city AND g.l = a.l)
    SELECT r.city, r.member_id, r.key, CASE WHEN basis IS NOT NULL THEN other ELSE own END AS canonical_id,
        CASE WHEN basis IS NOT NULL THEN basis WHEN own IS NULL THEN 'ambiguous' WHEN r.member_id = own THEN 'own' ELSE 'equal_name' END AS basis
    FROM r JOIN b ON r.city = b.city AND r.key = b.key""",
)
def member_bridges(spark, sf_dir):
    """Which rows of each roster name one member, and why; ambiguous names stay apart."""
    return identities.bridges(written_roster(spark, sf_dir), "city")
