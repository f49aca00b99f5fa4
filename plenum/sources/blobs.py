"""Content-addressed originals and extractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plenum.functions.text import garbled, padded_layout
from plenum.operators.documents import sniff_format
from plenum.operators.keyed import latest_per_key
from plenum.operators.merge import append_absent


def originals(files: DataFrame, most_bytes: int = 500_000_000) -> tuple[DataFrame, DataFrame]:
    """Blobs by SHA-256 and their sightings, from ``source_url``, ``content``, ``declared_type`` and ``seen_at``.

    Content over the cap is left out. The blob itself is taken once: hashes are
    compared, not bytes.
    """
    hashed = files.where(F.octet_length("content").between(1, most_bytes)).withColumn("sha256", F.sha2("content", 256)).withColumn("n_bytes", F.octet_length("content"))
    sightings = hashed.groupBy("sha256", "source_url").agg(F.min("seen_at").alias("first_seen"), F.max("seen_at").alias("last_seen"))
    blobs = hashed.dropDuplicates(["sha256"]).select("sha256", "n_bytes", sniff_format(F.col("content"), F.col("declared_type")).alias("format"), "content")
    return blobs, sightings


def archive(stored: DataFrame, blobs: DataFrame) -> DataFrame:
    """Stored blobs and new ones: the first writer of a hash wins."""
    return append_absent(stored, blobs, ["sha256"])


def persist_extractions(stored: DataFrame, results: DataFrame) -> DataFrame:
    """Extractions by hash and extractor version, first writer wins; a result with missing pages is partial."""
    status = F.when(F.coalesce(F.size("missing_pages"), F.lit(1)) == 0, "succeeded").otherwise("partial")
    return append_absent(stored, results.withColumn("status", status).select(*stored.columns), ["sha256", "extract_version"])


def usable_extractions(wanted: DataFrame, extractions: DataFrame, versions: list[str], complete: bool = True) -> DataFrame:
    """Cached texts for the wanted hashes: of a compatible version, readable and, if asked, complete; newest version first."""
    fit = extractions.where(F.col("extract_version").isin(versions)).where(~garbled(F.col("text")) & ~padded_layout(F.col("text")))
    if complete:
        fit = fit.where("status = 'succeeded'")
    order = F.array_position(F.array(*[F.lit(v) for v in versions]), F.col("extract_version"))
    best = latest_per_key(fit, ["sha256"], [order.desc()])
    return wanted.join(best, "sha256", "left")


def refresh_documents(items: DataFrame, sightings: DataFrame, candidates: str = "identities") -> DataFrame:
    """Each item's attachment resolved to the newest blob of its first known identity (``item_id``, ``place``, ``sha256``)."""
    asked = items.select("item_id", "place", F.posexplode(candidates).alias("rank", "source_url"))
    newest = latest_per_key(sightings, ["source_url"], [F.desc("last_seen"), F.col("sha256")])
    hits = asked.join(newest.select("source_url", "sha256"), "source_url")
    return latest_per_key(hits, ["item_id", "place"], [F.col("rank")]).select("item_id", "place", "sha256")
