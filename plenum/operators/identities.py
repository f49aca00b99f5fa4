"""Bridges between rows that name one member: equal names first, then shorter or abbreviated ones that can mean nobody else.

Members whose votes are published are the anchors. Rows are grouped by their folded
name; a group joins the one anchor that it holds, or stands alone if it is one row.
A group without an anchor may then join the only anchor of its scope with the same
last word, if its words end that anchor's name or differ in middle names only. Two
anchors under a name, or several rows without any, block the merge. Groups hang on
anchors directly, so merges never chain.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plenum.functions.text import clean_name, fold


def name_key(name: Column) -> Column:
    """Words of a folded name without titles and punctuation; null or empty if nothing is left."""
    return F.trim(F.regexp_replace(fold(clean_name(name)), r"[^\p{L}\p{N}]+", " "))


def words(key: Column) -> Column:
    return F.split(key, " ", -1)


def agree(a: Column, b: Column) -> Column:
    """Two middle names are the same, or one is the other's initial."""
    return (a == b) | ((F.length(a) == 1) & b.startswith(a)) | ((F.length(b) == 1) & a.startswith(b))


def middles_agree(a: Column, b: Column) -> Column:
    """Equally many words between first and last, agreeing pair by pair."""
    inner = F.zip_with(F.slice(a, F.lit(2), F.greatest(F.size(a) - 2, F.lit(0))), F.slice(b, F.lit(2), F.greatest(F.size(b) - 2, F.lit(0))), lambda x, y: F.coalesce(agree(x, y), F.lit(False)))
    return (F.size(a) == F.size(b)) & F.forall(inner, lambda x: x)


def same_ends(a: Column, b: Column) -> Column:
    return (F.get(a, F.lit(0)) == F.get(b, F.lit(0))) & (F.element_at(a, -1) == F.element_at(b, -1))


def is_suffix(short: Column, full: Column) -> Column:
    extra = F.size(full) - F.size(short)
    return (extra > 0) & (F.slice(full, F.greatest(extra, F.lit(0)) + 1, F.size(short)) == short)


def is_middle_variant(short: Column, full: Column) -> Column:
    two = (F.size(full) == 2) | (F.size(short) == 2)
    return (F.size(full) >= 2) & (F.size(short) >= 2) & same_ends(short, full) & (two | middles_agree(short, full))


def keyed(rows: DataFrame, scope: str) -> DataFrame:
    """Distinct ``member_id`` and ``key`` of a scope; a member is an anchor if any of its rows has votes."""
    named = rows.select(scope, "member_id", F.coalesce("has_votes", F.lit(False)).alias("has_votes"), name_key(F.col("name")).alias("key"))
    anchor = F.max("has_votes").over(Window.partitionBy(scope, "member_id"))
    return named.withColumn("anchor", anchor).where("key <> ''").select(scope, "member_id", "key", "anchor").distinct()


def identity_keys(rows: DataFrame, scope: str) -> DataFrame:
    """What each name of a scope stands for: ``key``, ``target`` (null if it is ambiguous) and ``basis``."""
    every = keyed(rows, scope)
    voter = F.when(F.col("anchor"), F.col("member_id"))
    groups = every.groupBy(scope, "key").agg(F.count(F.lit(1)).alias("n"), F.count(voter).alias("n_anchors"), F.min(voter).alias("voter"), F.min("member_id").alias("single"))
    groups = groups.withColumn("own", F.when(F.col("n_anchors") == 1, F.col("voter")).when(F.col("n") == 1, F.col("single"))).withColumn("last", F.element_at(words(F.col("key")), -1))
    anchors = every.where("anchor").groupBy(scope, F.element_at(words(F.col("key")), -1).alias("last"))
    anchors = anchors.agg(F.min("member_id").alias("other"), F.max("member_id").alias("__most"), F.min("key").alias("full")).where(F.col("other") == F.col("__most")).drop("__most")
    short, full = words(F.col("key")), words(F.col("full"))
    open_ = (F.col("n_anchors") == 0) & F.col("own").isNotNull()
    how = F.when(open_ & is_suffix(short, full), "unique_anchor_suffix").when(open_ & is_middle_variant(short, full), "unique_anchor_middle_name")
    bridged = groups.join(anchors, [scope, "last"], "left").withColumn("basis", how)
    target = F.when(F.col("basis").isNotNull(), F.col("other")).otherwise(F.col("own"))
    return bridged.select(scope, "key", target.alias("target"), "basis")


def bridges(rows: DataFrame, scope: str) -> DataFrame:
    """``canonical_id`` and ``basis`` of each member and name (``scope``, ``member_id``, ``name``, ``has_votes``).

    Rows without a name that can be read have no result; a repeated row counts
    once. An ambiguous name has no canonical id, and the basis says so.
    """
    found = keyed(rows, scope).join(identity_keys(rows, scope), [scope, "key"])
    basis = F.when(F.col("target").isNull(), "ambiguous").when(F.col("basis").isNotNull(), F.col("basis")).when(F.col("member_id") == F.col("target"), "own").otherwise("equal_name")
    return found.select(scope, "member_id", "key", F.col("target").alias("canonical_id"), basis.alias("basis"))


def resolved(mentions: DataFrame, rows: DataFrame, scope: str, name: str = "name") -> DataFrame:
    """Mentions with the ``member_id`` that their whole name stands for; null if it is unknown or ambiguous."""
    keys = identity_keys(rows, scope).select(scope, F.col("key").alias("__key"), F.col("target").alias("member_id"))
    return mentions.withColumn("__key", name_key(F.col(name))).join(keys, [scope, "__key"], "left").drop("__key")


def conflicting(pairs: DataFrame, rows: DataFrame, scope: str, raw: str = "raw", chosen: str = "chosen") -> DataFrame:
    """``pairs`` with ``conflict``: the printed name stands for another member than the chosen one, or has other middle names."""
    keys = identity_keys(rows, scope).where("target is not null").select(scope, "key", "target")
    named = keyed(rows, scope).groupBy(scope, F.col("member_id").alias("__chosen")).agg(F.min("key").alias("__full"))
    out = pairs.withColumn("__rawkey", name_key(F.col(raw))).withColumn("__chosenkey", name_key(F.col(chosen)))
    for side in ("raw", "chosen"):
        out = out.join(keys.withColumnsRenamed({"key": f"__{side}key", "target": f"__{side}"}), [scope, f"__{side}key"], "left")
    out = out.join(named, [scope, "__chosen"], "left")
    a, b = words(F.col("__rawkey")), words(F.coalesce("__full", "__chosenkey"))
    middles = (F.size(a) >= 3) & (F.size(b) >= 3) & same_ends(a, b) & ~middles_agree(a, b)
    return out.select(*pairs.columns, (F.coalesce(F.col("__raw") != F.col("__chosen"), F.lit(False)) | F.coalesce(middles, F.lit(False))).alias("conflict"))
