"""Full-text search and keyword alerts over a token table."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plenum.operators.keyed import latest_per_key

# English words that carry no meaning in a query.
STOP_WORDS = "a an and are as at be but by for from had has have he her his i if in into is it its me my no not of on or our she so such that the their them then there these they this to was we were what when which who will with you your".split()
SUFFIXES = [("sses", "ss"), ("ies", "y"), ("ments", "ment"), ("ings", ""), ("edly", ""), ("ing", ""), ("ed", ""), ("ly", ""), ("s", "")]


def terms(text: Column) -> Column:
    """Lower-case words of letters and digits without stop words, in order."""
    words = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"([\p{L}\p{N}]+)"))
    return F.filter(words, lambda w: ~w.isin(STOP_WORDS))


def stem(word: Column) -> Column:
    """Light stemming: the first suffix that leaves three characters goes."""
    out = word
    for suffix, put in reversed(SUFFIXES):
        long_enough = F.length(word) >= len(suffix) + 3
        ends = word.endswith(suffix) & ~word.endswith("ss") if suffix == "s" else word.endswith(suffix)
        out = F.when(ends & long_enough, F.concat(F.substr(word, F.lit(1), F.length(word) - len(suffix)), F.lit(put))).otherwise(out)
    return out


def query_terms(text: str) -> list[str]:
    return sorted({w for w in re.findall(r"\w+", text.lower()) if w not in STOP_WORDS})


def index(docs: DataFrame, id_column: str, *texts: str) -> DataFrame:
    """Token table: id, stemmed ``term``, positions. Written once, it serves all searches by term."""
    words = F.posexplode(terms(F.concat_ws(" ", *texts))).alias("pos", "word")
    rows = docs.select(id_column, words).withColumn("term", stem(F.col("word")))
    return rows.groupBy(id_column, "term").agg(F.array_sort(F.collect_list("pos")).alias("positions"))


def match_all(tokens: DataFrame, id_column: str, wanted: list[str]) -> DataFrame:
    """Ids with every wanted term, and their score: summed damped term frequencies."""
    asked = tokens.where(F.col("term").isin(wanted))
    score = F.sum(1 + F.log(F.size("positions").cast("double")))
    return asked.groupBy(id_column).agg(F.count(F.lit(1)).alias("n"), score.alias("score")).where(F.col("n") == len(wanted)).drop("n")


def contains_all(text: Column, wanted: list[str]) -> Column:
    """The same match set by scanning: every unstemmed term is a word of the text."""
    words = terms(text)
    return F.forall(F.array(*[F.lit(w) for w in wanted]), lambda w: F.array_contains(words, w))


def headline(wanted: list[str], around: int = 18):
    """Fragment around the first hit with the hits marked; applied after the limit, to a few rows."""
    pattern = re.compile(r"\b(" + "|".join(map(re.escape, wanted)) + r")\w*", re.I)

    def mark(text: str | None) -> str | None:
        words = (text or "").split()
        at = next((i for i, w in enumerate(words) if pattern.search(w)), 0)
        return pattern.sub(lambda m: f"<mark>{m[0]}</mark>", " ".join(words[max(0, at - around) : at + around]))

    @F.pandas_udf("string")
    def run(text: pd.Series) -> pd.Series:
        return text.map(mark)

    return run


def keyword_alerts(alerts: DataFrame, items: DataFrame, item_id: str, text: str, seen: DataFrame | None = None) -> DataFrame:
    """First matching keyword of each alert and item (``alert_id``, ``keywords`` array in order of preference).

    Keywords are single words here: items are reduced to their distinct words and
    joined by word, so no pair without a match is looked at. Pairs in ``seen`` are left out.
    """
    wanted = alerts.select("alert_id", F.posexplode("keywords").alias("place", "keyword"))
    words = items.select(item_id, F.explode(F.array_distinct(F.split(F.lower(text), r"[^\p{L}\p{N}]+", -1))).alias("keyword")).where("keyword <> ''")
    hits = words.join(wanted, "keyword")
    if seen is not None:
        hits = hits.join(seen.select("alert_id", item_id), ["alert_id", item_id], "left_anti")
    return latest_per_key(hits, ["alert_id", item_id], [F.col("place")]).select("alert_id", item_id, "keyword")


def phrase_alerts(alerts: DataFrame, items: DataFrame, item_id: str, text: str) -> DataFrame:
    """Case-sensitive containment of whole phrases, which may start and end inside words.

    Each phrase looks for its longest inner word, one with marks or blanks around it
    in the phrase, by an equality join on words, and is tested where that stands.
    Phrases without an inner word can match inside any word; they meet all items,
    so alert lists should have few of them.
    """
    wanted = alerts.select("alert_id", F.posexplode("keywords").alias("place", "keyword")).where("keyword <> ''")
    inner = F.regexp_extract_all("keyword", F.lit(r"(?<=[^\p{L}\p{N}])([\p{L}\p{N}]+)(?=[^\p{L}\p{N}])"))
    longest = F.array_max(F.transform(inner, lambda w: F.struct(F.length(w).alias("n"), w.alias("w"))))["w"]
    wanted = wanted.withColumn("word", longest)
    words = items.select(item_id, text, F.explode(F.array_distinct(F.regexp_extract_all(text, F.lit(r"([\p{L}\p{N}]+)")))).alias("word"))
    here = F.col(text).contains(F.col("keyword"))
    by_word = words.join(wanted.where("word is not null"), "word").where(here)
    anywhere = items.join(wanted.where("word is null"), here)
    hits = by_word.select("alert_id", item_id, "place", "keyword").unionByName(anywhere.select("alert_id", item_id, "place", "keyword"))
    return latest_per_key(hits, ["alert_id", item_id], [F.col("place")]).select("alert_id", item_id, "keyword")


def all_keywords(hits: DataFrame, item_id: str) -> DataFrame:
    """One row an item with all its matched keywords in order."""
    return hits.groupBy(item_id).agg(F.array_sort(F.collect_set("keyword")).alias("keywords"))
