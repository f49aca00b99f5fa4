"""Arrays, maps and JSON: attachments, topics, versions, and lenient parsing."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from plenum.functions.identity import attachment_identity
from plenum.functions.text import file_version


def count_of(text: Column) -> Column:
    """Elements of a JSON array in a text; what is no array counts zero."""
    return F.coalesce(F.json_array_length(text), F.lit(0))


def objects(text: Column, schema: str) -> Column:
    """Elements of a JSON array of objects, for ``inline`` or ``explode``; nothing if it can't be read."""
    return F.coalesce(F.from_json(text, f"array<{schema}>"), F.array().cast(f"array<{schema}>"))


def patched(old: Column, new: Column) -> Column:
    """Map with the entries of both, the new ones winning; null counts as empty."""
    empty = F.create_map().cast("map<string,string>")
    o, n = F.coalesce(old, empty), F.coalesce(new, empty)
    return F.map_concat(F.map_filter(o, lambda k, _: ~F.map_contains_key(n, k)), n)


def without_keys(entries: Column, keys: list[str]) -> Column:
    return F.map_filter(entries, lambda k, _: ~k.isin(keys))


def only_keys(entries: Column, keys: list[str]) -> Column:
    return F.map_filter(entries, lambda k, _: k.isin(keys))


def allowed_topics(topics: Column, taxonomy: list[str], fallback: str = "other") -> Column:
    """Topics of the taxonomy; the fallback if none of those given is in it; nothing stays nothing."""
    kept = F.array_intersect(F.transform(topics, lambda t: F.lower(F.trim(t))), F.array(*[F.lit(t) for t in taxonomy]))
    return F.when((F.size(topics) > 0) & (F.size(kept) == 0), F.array(F.lit(fallback))).otherwise(kept)


def canonical_topic(topic: Column, synonyms: dict[str, str]) -> Column:
    """Canonical name of a topic: by the exact synonym, else the first that it holds as a whole word; null if none."""
    low = F.lower(F.trim(topic))
    exact = F.try_element_at(F.create_map(*[F.lit(x) for pair in synonyms.items() for x in pair]), low)
    inside = F.coalesce(*[F.when(low.rlike(rf"(?:^|[^\p{{L}}\p{{N}}_]){re.escape(s)}(?:$|[^\p{{L}}\p{{N}}_])"), F.lit(c)) for s, c in synonyms.items()])
    return F.coalesce(exact, inside)


def canonical_topics(topics: Column, synonyms: dict[str, str]) -> Column:
    """Distinct canonical names in order of the alphabet; topics that match nothing go."""
    return F.array_sort(F.array_distinct(F.filter(F.transform(topics, lambda t: canonical_topic(t, synonyms)), lambda t: t.isNotNull())))


def single_topic(topic: Column, synonyms: dict[str, str]) -> Column:
    return F.coalesce(canonical_topic(topic, synonyms), F.lower(F.trim(topic)))


def topics_by_frequency(items: DataFrame, parent: str, topics: str) -> DataFrame:
    """Topics of each parent, most frequent first, ties by name."""
    counts = items.select(parent, F.explode(topics).alias("topic")).groupBy(parent, "topic").agg(F.count(F.lit(1)).alias("n"))
    ordered = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), "topic")))
    return counts.groupBy(parent).agg(F.transform(ordered, lambda x: x["topic"]).alias("topics"))


def distinct_attachments(appearances: DataFrame, key: str, order: list[str], attachments: str = "attachments") -> DataFrame:
    """Attachments of each key's appearances, one of each (identity, pages), in order of first appearance."""
    rows = appearances.select(key, *order, F.posexplode(attachments).alias("place", "a")).withColumn("identity", attachment_identity(F.col("a.url")))
    span = F.coalesce(F.col("a.pages").cast("string"), F.lit(""))
    first = rows.groupBy(key, "identity", span.alias("span")).agg(F.min(F.struct(*order, "place", "a")).alias("first"))
    listed = F.array_sort(F.collect_list(F.struct(*[F.col(f"first.{c}").alias(c) for c in [*order, "place"]], "identity", "first.a")))
    return first.groupBy(key).agg(F.transform(listed, lambda x: x["a"]).alias("attachments"))


def newest_versions(names: DataFrame, key: str, name: str) -> DataFrame:
    """Of each key's versioned files only the highest version; files without a version stay."""
    base, version = file_version(F.col(name))
    rows = names.withColumn("__base", base).withColumn("__version", version)
    versioned = rows.where("__version > 0")
    best = versioned.groupBy(key, "__base").agg(F.max_by(name, F.struct("__version", name)).alias(name))
    return rows.where("__version = 0").select(key, name).unionByName(best.select(key, name))


def source_audit(items: DataFrame, parent: str, decision: str) -> DataFrame:
    """Counts of filter reasons and rules of each parent as maps."""
    rows = items.where(F.col(decision).isNotNull()).select(parent, F.col(f"{decision}.reason").alias("reason"), F.col(f"{decision}.rule_id").alias("rule"))
    as_map = lambda df, c: df.groupBy(parent, c).agg(F.count(F.lit(1)).alias("n")).groupBy(parent).agg(F.map_from_entries(F.collect_list(F.struct(c, "n"))).alias(f"{c}s"))
    return as_map(rows, "reason").join(as_map(rows, "rule"), parent)


def pick_document(candidates: Column, prefer_closed: bool = False) -> Column:
    """Best of an array of documents (name, url): closed or open agenda as asked, no draft, no viewer page, PDF first; ties keep their order."""

    def rank(d: Column, place: Column) -> Column:
        name = F.lower(F.concat_ws(" ", d["name"], d["url"]))
        closed = name.rlike("closed|executive session")
        viewer = name.rlike("view(er)?[./?]|\\.html?$")
        marks = [closed != F.lit(prefer_closed), name.contains("draft"), viewer, ~name.contains(".pdf")]
        return F.struct(*[m.cast("int").alias(f"m{i}") for i, m in enumerate(marks)], place.alias("place"), d.alias("document"))

    return F.get(F.array_sort(F.transform(candidates, rank)), 0)["document"]


def first_json(text: str | None) -> str | None:
    """The first JSON object of a text, after small repairs: code fences, trailing commas, bare quotes; null if none can be read."""
    if text is None:
        return None
    body = re.sub(r"```(?:json)?", "", text)
    start = body.find("{")
    if start < 0:
        return None
    body = body[start:]
    decoder = json.JSONDecoder(strict=False)
    for repair in (lambda s: s, lambda s: re.sub(r",\s*([}\]])", r"\1", s), lambda s: re.sub(r"[“”]", '"', s), lambda s: s + '"' * (s.count('"') % 2) + "]" * max(0, s.count("[") - s.count("]")) + "}" * max(0, s.count("{") - s.count("}"))):
        body = repair(body)
        try:
            return json.dumps(decoder.raw_decode(body)[0])
        except ValueError:
            continue
    return None


@F.pandas_udf(StringType())
def parse_lenient(text: pd.Series) -> pd.Series:
    return text.map(first_json)


def better_ocr(original: Column, ocr: Column) -> Column:
    """True if OCR's text should replace a text layer: clearly longer, or about as long with more letters."""
    letters = lambda t: F.length(F.regexp_replace(t, r"[^\p{L}]", "")) / F.greatest(F.length(t), F.lit(1))
    a, b = F.coalesce(original, F.lit("")), F.coalesce(ocr, F.lit(""))
    return (F.length(b) > 1.5 * F.length(a)) & (letters(b) > 0.4) | (F.length(b) >= 0.8 * F.length(a)) & (letters(b) > letters(a) + 0.1)


def leading_number(title: Column) -> Column:
    """Number before a title, permissively: a first token with a digit, or a single letter, closed by a mark; null without one."""
    found = F.regexp_extract(title, r"^\s*((?:[A-Za-z]{0,4}[-.]?\d[\w.-]*|[A-Za-z]))[.):]\s", 1)
    return F.when(found != "", found)
