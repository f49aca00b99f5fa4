"""Snapshot merges, reconciliation and change capture as full-outer joins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Policy = Callable[[Column, Column], Column]

# Merge policies: (stored, incoming) to merged.
newest: Policy = lambda old, new: F.coalesce(new, old)  # noqa: E731  an incoming null keeps the stored value
keep: Policy = lambda old, new: F.coalesce(old, new)  # noqa: E731  fills nulls only
smallest: Policy = lambda old, new: F.least(old, new)
largest: Policy = lambda old, new: F.greatest(old, new)


def upsert(stored: DataFrame, incoming: DataFrame, keys: list[str], policies: dict[str, Policy], frozen_if: Column | None = None, frozen: list[str] | None = None) -> DataFrame:
    """Merged snapshot: keys in either, each column by its policy.

    Where ``frozen_if`` (over ``old`` columns) holds, the ``frozen`` columns keep the stored value,
    null included. Incoming keys have to be unique.
    """
    columns = [c for c in stored.columns if c not in keys]
    o = stored.select(*keys, F.struct(*columns).alias("old"))
    n = incoming.select(*keys, F.struct(*[c for c in columns if c in incoming.columns]).alias("new"))
    rows = o.join(n, keys, "full_outer")
    out = []
    for c in columns:
        merged = policies.get(c, newest)(F.col(f"old.{c}"), F.col(f"new.{c}")) if c in incoming.columns else F.col(f"old.{c}")
        if frozen_if is not None and c in (frozen or []):
            merged = F.when(F.coalesce(frozen_if, F.lit(False)), F.col(f"old.{c}")).otherwise(merged)
        out.append(merged.alias(c))
    return rows.select(*keys, *out)


def changed_rows(before: DataFrame, after: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Keys whose columns differ null-safely, or that came or went: ``change`` is insert, delete or update.

    ``fields`` names the columns that differ, in the order given.
    """
    b = before.select(*keys, F.struct(*columns).alias("b"))
    a = after.select(*keys, F.struct(*columns).alias("a"))
    rows = b.join(a, keys, "full_outer")
    fields = F.array_compact(F.array(*[F.when(~F.col(f"b.{c}").eqNullSafe(F.col(f"a.{c}")), F.lit(c)) for c in columns]))
    kind = F.when(F.col("b").isNull(), "insert").when(F.col("a").isNull(), "delete").when(F.size(fields) > 0, "update")
    return rows.withColumn("change", kind).withColumn("fields", fields).where("change is not null")


def revisions(before: DataFrame, after: DataFrame, keys: list[str], columns: list[str], lengths_only: tuple[str, ...] = ()) -> DataFrame:
    """Per-field old and new values as text (for ``lengths_only`` columns, lengths) of updated keys."""
    rows = changed_rows(before, after, keys, columns).where("change = 'update'")
    show = lambda side, c: F.length(f"{side}.{c}").cast("string") if c in lengths_only else F.col(f"{side}.{c}").cast("string")
    entries = F.array(*[F.struct(F.lit(c).alias("field"), show("b", c).alias("old"), show("a", c).alias("new")) for c in columns])
    kept = F.filter(entries, lambda e: F.array_contains("fields", e["field"]))
    return rows.select(*keys, F.map_from_entries(F.transform(kept, lambda e: F.struct(e["field"], F.struct(e["old"].alias("old"), e["new"].alias("new"))))).alias("changes"))


def reconcile(stored: DataFrame, desired: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """Keys to delete and keys to insert so that ``stored`` becomes ``desired``."""
    s, d = stored.select(*keys).distinct(), desired.select(*keys).distinct()
    return s.join(d, keys, "left_anti"), d.join(s, keys, "left_anti")


def append_absent(stored: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """Stored rows and the incoming ones whose key is new, one a key."""
    return stored.unionByName(incoming.dropDuplicates(keys).join(stored.select(*keys), keys, "left_anti"))


def replace_children(stored: DataFrame, incoming: DataFrame, parent: str) -> DataFrame:
    """Children of the parents in the batch are replaced, the others stay."""
    return stored.join(incoming.select(parent).distinct(), parent, "left_anti").unionByName(incoming.distinct())


def archive_and_retire(stored: DataFrame, current: DataFrame, scope: str, key: str) -> tuple[DataFrame, DataFrame]:
    """Rows that stay, and a journal (``scope``, ``key``, ``row`` as JSON) of those superseded within the scopes of the batch."""
    touched = stored.join(current.select(scope).distinct(), scope, "left_semi")
    gone = touched.join(current.select(scope, key), [scope, key], "left_anti")
    journal = gone.select(scope, key, F.to_json(F.struct("*")).alias("row"))
    return stored.join(gone.select(scope, key), [scope, key], "left_anti"), journal


def purge(tables: dict[str, tuple[DataFrame, str]], keys: DataFrame, key: str) -> dict[str, DataFrame]:
    """Every table without the rows of the purged keys."""
    return {name: df.join(keys.select(F.col(key).alias(column)).distinct(), column, "left_anti") for name, (df, column) in tables.items()}


def overlay(old: Column, new: Column, fields: list[str]) -> Column:
    """Struct in which new non-null fields win."""
    return F.struct(*[F.coalesce(new[f], old[f]).alias(f) for f in fields])


def compare_and_set(projection: DataFrame, state: DataFrame, key: str, expected: str, current: str) -> tuple[DataFrame, DataFrame]:
    """Rows whose expected version is still the current one, and the superseded ones."""
    rows = projection.join(state.select(key, current), key, "left")
    same = F.col(expected).eqNullSafe(F.col(current))
    return rows.where(same).drop(current), rows.where(~same)


def attempts_after(same_version: Column, attempts: Column) -> Column:
    """Attempt counter that starts anew with each work version."""
    return F.when(same_version, F.coalesce(attempts, F.lit(0)) + 1).otherwise(F.lit(1))


def matter_decision(has_attachments: Column, stored_hash: Column, current_hash: Column, stored_version: Column, current_version: Column, disposition: Column, attempts: Column, most: int = 3) -> Column:
    """Whether a matter has to be processed, with the reason, by the first rule that applies."""
    says = lambda go, why: F.struct(F.lit(go).alias("enqueue"), F.lit(why).alias("reason"))
    same = stored_version.eqNullSafe(current_version)
    return (
        F.when(~has_attachments, says(False, "no_attachments"))
        .when(stored_hash.isNull(), says(True, "new"))
        .when(~stored_hash.eqNullSafe(current_hash), says(True, "attachments_changed"))
        .when(~same, says(True, "work_changed"))
        .when(F.coalesce(disposition, F.lit("")) == "done", says(False, "unchanged"))
        .when(F.coalesce(attempts, F.lit(0)) >= most, says(False, "attempts_exhausted"))
        .otherwise(says(True, "retry"))
    )


def meeting_decision(items: DataFrame, meeting: str, summary: str, filter_reason: str) -> DataFrame:
    """Meetings with ``enqueue`` true unless every item is summarised or filtered."""
    done = F.col(summary).isNotNull() | F.col(filter_reason).isNotNull()
    return items.groupBy(meeting).agg((~F.bool_and(done)).alias("enqueue"))


def reconciliation_plan(desired_version: Column, queue_version: Column, queue_status: Column, canonical_version: Column) -> Column:
    """NONE, ENQUEUE_VERSION or REACTIVATE_VERSION of a matter, by its queue row and canonical state."""
    live = queue_status.isin("pending", "processing")
    return (
        F.when(desired_version.isNull(), "NONE")
        .when(canonical_version.eqNullSafe(desired_version), "NONE")
        .when(queue_version.isNull() | ~queue_version.eqNullSafe(desired_version), "ENQUEUE_VERSION")
        .when(F.coalesce(live, F.lit(False)), "NONE")
        .otherwise("REACTIVATE_VERSION")
    )


def ordered_links(parents: DataFrame, key: str, names: str) -> DataFrame:
    """Desired links of a list column: one row per distinct normalised name, first place as order, the first is primary."""
    rows = parents.select(key, F.posexplode(names).alias("pos", "name")).withColumn("name", F.lower(F.trim("name"))).where("name <> ''")
    first = rows.groupBy(key, "name").agg(F.min("pos").alias("pos"))
    top = first.groupBy(key).agg(F.min("pos").alias("least"))
    return first.join(top, key).select(key, "name", "pos", (F.col("pos") == F.col("least")).alias("is_primary"))


def stable_ids(items: DataFrame, base: str, semantic: str) -> DataFrame:
    """Ids of items: the base id, with a digest of the meaning where different items share it; exact repeats collapse."""
    distinct = items.dropDuplicates([base, semantic])
    counts = distinct.groupBy(base).agg(F.count(F.lit(1)).alias("__n"))
    suffix = F.concat(F.col(base), F.lit("_"), F.substring(F.sha2(F.col(semantic).cast("string"), 256), 1, 8))
    return distinct.join(counts, base).withColumn("item_id", F.when(F.col("__n") > 1, suffix).otherwise(F.col(base))).drop("__n")


def reconcile_by_source(stored: DataFrame, observed: DataFrame, scope: str, keys: list[str], source: str, value: str) -> DataFrame:
    """Rows after a scope's votes were observed: observed ones win, and only rows of the same source that are no longer observed go.

    Scopes that were not observed, and other sources, stay as they are.
    """
    touched = observed.select(scope).distinct().withColumn("__touched", F.lit(True))
    rows = stored.alias("s").join(observed.select(*keys, F.col(value).alias("__new"), F.lit(True).alias("__seen")), keys, "full_outer")
    rows = rows.join(touched, scope, "left")
    orphan = F.col("__touched") & F.col("__seen").isNull() & (F.col("source") == source)
    kept = rows.where(~F.coalesce(orphan, F.lit(False)))
    merged = kept.withColumn(value, F.coalesce("__new", F.col(value))).withColumn("source", F.coalesce("source", F.lit(source)))
    return merged.select(*stored.columns)


def publication(items: DataFrame, tracking: DataFrame, key: str) -> DataFrame:
    """What to publish for each affected matter: enqueue, tombstone (no appearance left), copy a prior summary, or nothing.

    ``items`` has the retained rows with ``summary`` and ``attachments``; ``tracking``
    the affected keys with the newest prior ``summary`` and the work version done.
    """
    now = items.groupBy(key).agg(F.count(F.lit(1)).alias("appearances"), F.bool_and(F.col("summary").isNotNull()).alias("complete"), F.max("work_version").alias("work_version"))
    rows = tracking.join(now, key, "left")
    action = (
        F.when(F.col("appearances").isNull(), "tombstone")
        .when(F.col("complete"), "nothing")
        .when(F.col("done_version").eqNullSafe(F.col("work_version")) & F.col("prior_summary").isNotNull(), "copy_summary")
        .otherwise("enqueue")
    )
    return rows.withColumn("action", action)
