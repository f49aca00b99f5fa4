"""Deterministic identities: keys, their validation, and content digests."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Titles that never identify a matter, and prefixes of readings.
GENERIC_TITLES = ["vta", "caltrain", "city staff", "public comment", "public letters", "staff comments", "future business", "review of minutes", "city and district reports", "open forum", "closed session", "oral communications"]
READING_PREFIXES = [r"^FIRST\s+READ(?:ING)?:\s*", r"^SECOND\s+READ(?:ING)?:\s*", r"^THIRD\s+READ(?:ING)?:\s*", r"^FINAL\s+READ(?:ING)?:\s*", r"^REINTRODUCED\s+(?:FIRST\s+)?(?:SECOND\s+)?READ(?:ING)?:\s*"]
TITLE_LEAST = 30  # shorter titles are generic
SIGNATURE_KEYS = ["x-amz-signature", "x-amz-credential", "signature", "sig", "expires", "token", "awsaccesskeyid"]


def present(value: Column) -> Column:
    return F.coalesce(F.length(value) > 0, F.lit(False))


def squeezed(value: Column) -> Column:
    """White space collapsed to single spaces and trimmed."""
    return F.trim(F.regexp_replace(value, r"\s+", " "))


def without_reading(title: Column) -> Column:
    for prefix in READING_PREFIXES:
        title = F.regexp_replace(title, "(?i)" + prefix, "")
    return title


def title_key(title: Column) -> Column:
    """Title that can identify a matter, or null if it is short or generic."""
    first = squeezed(title)
    key = F.lower(squeezed(without_reading(first)))
    return F.when((F.length(first) >= TITLE_LEAST) & ~F.lower(first).isin(GENERIC_TITLES) & (F.length(key) >= TITLE_LEAST), key)


def tagged(digits: int, *parts: Column | str) -> Column:
    """Leading hex digits of the SHA-256 of the joined parts."""
    return F.substring(F.sha2(F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts]), 256), 1, digits)


def matter_id(banana: Column, matter_file: Column, vendor_id: Column, title: Column, year: Column | None = None) -> Column:
    """File number, else vendor id, else title key; the year counts only with a file number. Null if nothing identifies."""
    suffix = F.lit("") if year is None else F.when(present(year), F.concat(F.lit(":year:"), year)).otherwise("")
    key = F.when(present(matter_file), F.concat(F.lit(":file:"), matter_file, suffix)).when(present(vendor_id), F.concat(F.lit(":id:"), vendor_id)).otherwise(F.concat(F.lit(":title:"), title_key(title)))
    return F.concat(banana, F.lit("_"), tagged(16, banana, key))


def meeting_id(banana: Column, vendor_id: Column, date: Column, title: Column) -> Column:
    when = F.coalesce(F.date_format(date, "yyyyMMdd'T'HHmmss"), F.lit("undated"))
    return F.concat(banana, F.lit("_"), F.substring(F.md5(F.concat_ws(":", banana, vendor_id, when, title)), 1, 8))


def item_id(meeting: Column, sequence: Column, vendor_item_id: Column) -> Column:
    vendor = F.lower(F.regexp_replace(vendor_item_id, r"\s+", ""))
    by_place = F.concat(F.lit("seq"), F.lpad(sequence.cast("string"), 3, "0"), F.lit("_"), tagged(8, meeting, ":seq:", sequence.cast("string")))
    return F.concat(meeting, F.lit("_"), F.when(present(vendor), vendor).otherwise(by_place))


def member_id(banana: Column, name: Column) -> Column:
    return F.concat(banana, F.lit("_cm_"), tagged(16, banana, ":council_member:", F.lower(squeezed(name))))


def committee_id(banana: Column, name: Column) -> Column:
    return F.concat(banana, F.lit("_comm_"), tagged(16, banana, ":committee:", F.lower(squeezed(name))))


def docket_id(banana: Column, system: Column, case_key: Column) -> Column:
    return F.concat(banana, F.lit("_dk_"), tagged(16, system, ":", F.trim(case_key)))


def filing_id(docket: Column, vendor_filing_id: Column) -> Column:
    return F.concat(docket, F.lit("_f_"), tagged(12, F.trim(vendor_filing_id)))


def body_id(banana: Column, folded_name: Column) -> Column:
    return tagged(12, banana, ":", folded_name)


def is_matter_id(value: Column) -> Column:
    return F.coalesce(value.rlike("^[A-Za-z0-9]+_[0-9a-f]{16}$"), F.lit(False))


def is_meeting_id(value: Column) -> Column:
    return F.coalesce(value.rlike("^[A-Za-z0-9]+_[0-9a-fA-F]{8}$"), F.lit(False))


def is_member_id(value: Column, tag: str = "cm") -> Column:
    return F.coalesce(value.rlike(f"^[A-Za-z0-9]+_{tag}_[0-9a-f]{{16}}$"), F.lit(False))


def banana_of(value: Column) -> Column:
    return F.split_part(value, F.lit("_"), F.lit(1))


def attachment_identity(url: Column) -> Column:
    """Address without its query if the query is a signature that changes each time, else as it is."""
    query = F.coalesce(F.regexp_extract(url, r"\?([^#]*)", 1), F.lit(""))
    signed = query.rlike("(?i)(?:^|&)(?:" + "|".join(SIGNATURE_KEYS) + ")=")
    return F.when(signed, F.regexp_replace(url, r"[?#].*$", "")).otherwise(url)


def source_identities(url: Column) -> Column:
    """Addresses under which a document may be known: as given, without signature, without fragment, without query."""
    return F.array_distinct(F.array(url, attachment_identity(url), F.regexp_replace(url, "#.*$", ""), F.regexp_replace(url, r"[?#].*$", "")))


def attachment_set_hash(attachments: Column, version: str = "v2") -> Column:
    """Order-independent digest of (identity, name) pairs; an empty list has none."""
    pairs = F.array_sort(F.transform(attachments, lambda a: F.concat_ws("\x1f", attachment_identity(a["url"]), F.coalesce(a["name"], F.lit("")))))
    return F.when(F.size(attachments) > 0, F.concat(F.lit(version + ":"), F.sha2(F.array_join(pairs, "\x1e"), 256)))


def body_text_key(text: Column) -> Column:
    """Body text for comparison: blanks (also non-breaking) collapsed, under 40 characters none."""
    plain = squeezed(F.translate(F.coalesce(text, F.lit("")), " ", " "))
    return F.when(F.length(plain) < 40, F.lit("")).otherwise(plain)


def work_version(*parts: Column) -> Column:
    """Digest of whatever decides that work has to be done anew."""
    return F.sha2(F.to_json(F.struct(*[p.alias(f"p{i}") for i, p in enumerate(parts)])), 256)
