"""Entity resolution of officials: gazetteers with unique keys, bridging, and roster clusters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plenum.functions.text import clean_name, fold
from plenum.operators.keyed import unique_by_key


def name_keys(name: Column) -> Column:
    """Keys under which a folded name may be written: whole, last word, last two, initial with last."""
    words = F.split(F.regexp_replace(name, r"\.", ""), " +", -1)
    last = F.element_at(words, -1)
    two = F.array_join(F.slice(words, F.greatest(F.size(words) - 1, F.lit(1)), 2), " ")
    return F.array_distinct(F.array(F.array_join(words, " "), last, two, F.concat(F.substring(F.element_at(words, 1), 1, 1), F.lit(" "), last)))


def gazetteer(roster: DataFrame, scope: str) -> DataFrame:
    """Keys (``scope``, ``key``) that name exactly one member; a key that two share resolves to none."""
    keyed = roster.select(scope, "member_id", F.explode(name_keys(fold(clean_name("name")))).alias("key"))
    return unique_by_key(keyed, [scope, "key"], "member_id")


def resolve(mentions: DataFrame, roster: DataFrame, scope: str) -> DataFrame:
    """Mentions (``mention_id``, ``name``) with ``member_id``: by the first of their keys that is unique in their scope."""
    keyed = mentions.select(scope, "mention_id", F.posexplode(name_keys(fold(clean_name("name")))).alias("place", "key"))
    hits = keyed.join(gazetteer(roster, scope), [scope, "key"]).groupBy("mention_id").agg(F.min_by("member_id", "place").alias("member_id"))
    return mentions.join(hits, "mention_id", "left")


# Words by which a roster row is told to be a body, a role or an artifact.
BODIES = r"(?i)\b(committee|commission|council|board|department|division|office|authority|agency|district|caucus|task force|subcommittee)\b"
ROLES = r"(?i)^(?:the\s+)?(mayor|vice mayor|city (?:manager|clerk|attorney)|chair(?:man|woman|person)?|president|clerk|staff|administrator|director)s?$"
ARTIFACTS = r"(?i)^(?:n/?a|none|vacant|tbd|unknown|test|\W*|\d+)$"


def actor_kind(name: Column) -> Column:
    """person, body, role or artifact."""
    plain = F.trim(F.coalesce(name, F.lit("")))
    return F.when(plain.rlike(ARTIFACTS), "artifact").when(plain.rlike(ROLES), "role").when(plain.rlike(BODIES), "body").otherwise("person")


def meeting_body(title: Column) -> Column:
    """The body that meets: a title without occasion, date and noise; null if nothing remains."""
    t = title
    for pattern in (r"(?i)\b(?:cancell?ed|rescheduled|amended|revised|final|draft)\b", r"(?i)\b(?:regular|special|emergency|adjourned|joint|annual|virtual|work\s*session|study\s*session|workshop|public\s+hearing|meeting|agenda|minutes|packet)s?\b", r"\b\d{1,4}[-/.]\d{1,2}[-/.]\d{1,4}\b", r"(?i)\b(?:jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*\.?\s+\d{1,2}(?:,?\s+\d{4})?\b", r"[^\p{L}&' ]+"):
        t = F.regexp_replace(t, pattern, " ")
    t = F.trim(F.regexp_replace(t, r"\s+", " "))
    return F.when(F.length(t) > 2, t)


def person_clusters(rows: DataFrame, scope: str) -> DataFrame:
    """Person key of each raw roster row (``row_id``, ``name``): rows of a scope whose folded names are equal, or whose
    initial-and-last key belongs to one full name only."""
    from pyspark.sql import Window

    folded = rows.withColumn("folded", fold(clean_name("name")))
    words = F.split("folded", " +", -1)
    short = F.concat(F.substring("folded", 1, 1), F.lit(" "), F.element_at(words, -1))
    keyed = folded.where("folded is not null").withColumn("short", short).withColumn("is_short", F.length(F.element_at(words, 1)) <= 2)
    names = F.size(F.collect_set(F.when(~F.col("is_short"), F.col("folded"))).over(Window.partitionBy(scope, "short")))
    full = F.max(F.when(~F.col("is_short"), F.col("folded"))).over(Window.partitionBy(scope, "short"))
    key = F.when(F.col("is_short") & (names == 1), full).otherwise(F.col("folded"))
    return keyed.withColumn("person_key", key).drop("short", "is_short")


def sponsor_stats(items: DataFrame, sponsors: str = "sponsors") -> DataFrame:
    """How often each normalised sponsor appears, and on how many meetings."""
    rows = items.select("meeting_id", F.explode(sponsors).alias("name")).withColumn("name", F.lower(F.trim(F.regexp_replace("name", r"\s+", " ")))).where("name <> ''")
    return rows.groupBy("name").agg(F.count(F.lit(1)).alias("items"), F.count_distinct("meeting_id").alias("meetings"))
