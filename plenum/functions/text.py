"""Scalar text functions as native expressions; Arrow functions where built-ins can't say it."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from plenum.functions.identity import squeezed

# Synonyms of vote values.
VOTES = {
    "yes": "yes", "no": "no", "abstain": "abstain", "absent": "absent", "present": "present", "recused": "recused", "not_voting": "not_voting",
    "aye": "yes", "yea": "yes", "nay": "no", "abstained": "abstain", "excused": "absent", "not present": "absent", "recuse": "recused",
}


def vote_value(value: Column) -> Column:
    """One of seven values; unknown words mean not voting, blank means no vote."""
    low = F.lower(F.trim(value))
    known = F.create_map(*[F.lit(x) for pair in VOTES.items() for x in pair])
    return F.when(F.length(low) > 0, F.coalesce(F.try_element_at(known, low), F.lit("not_voting")))


def tokens_key(value: Column) -> Column:
    """Letters and digits in lower case, everything else one space."""
    return F.trim(F.regexp_replace(F.lower(value), r"[^\p{L}\p{N}]+", " "))


def garbled(text: Column) -> Column:
    """True for strong signs of a broken character map in a text of 200 characters or more."""
    sample = F.trim(F.coalesce(text, F.lit("")))
    count = lambda keep: F.length(F.regexp_replace(sample, f"[^{keep}]", ""))
    total = F.length(sample)
    controls = count(r"\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x9f")
    ascii_letters, digits, letters, solid = count("A-Za-z"), count("0-9"), count(r"\p{L}"), F.length(F.regexp_replace(sample, r"\s", ""))
    some = F.greatest(solid, F.lit(1))
    odd = ((ascii_letters + digits) / some < 0.20) & ((letters + digits) / some < 0.35) & ((letters - ascii_letters) / F.greatest(letters, F.lit(1)) >= 0.35)
    return (total >= 200) & ((controls / F.greatest(total, F.lit(1)) >= 0.01) | odd)


def padded_layout(text: Column) -> Column:
    """True if nearly all is spaces and a line is very long."""
    text = F.coalesce(text, F.lit(""))
    spaces = F.length(text) - F.length(F.translate(text, " ", ""))
    longest = F.array_max(F.transform(F.split(text, "\r\n|\n|\r", -1), F.length))
    return (F.length(text) > 2000) & (spaces / F.greatest(F.length(text), F.lit(1)) > 0.85) & (longest > 2000)


# What a summary must not hold, and what it should.
ERROR_PATTERNS = [r"failed to (process|summarize|extract)", r"error (processing|extracting)", r"no text (found|extracted)"]
TRUNCATIONS = ["...", "[truncated]", "[continued]"]
SECTIONS = ["**", "##", "Key Agenda Items:", "Important Details:", "Public Participation:"]
SUSPICIOUS = [r"(?m)^=== DOCUMENT \d+ ===$", r"(?m)^\d+\|", r"(?m)^CREATE TABLE"]


def summary_quality(summary: Column, least: int = 100) -> Column:
    """Quality of a summary and the confidence in that, by the first test that applies."""
    says = lambda q, c: F.struct(F.lit(q).alias("quality"), F.lit(float(c)).alias("confidence"))
    truncated = F.lit(False)
    for mark in TRUNCATIONS:
        times = (F.length(summary) - F.length(F.replace(summary, F.lit(mark), F.lit("")))) / len(mark)
        truncated = truncated | summary.endswith(mark) | (times > 2)
    sections = F.lit(False)
    for mark in SECTIONS:
        sections = sections | summary.contains(mark)
    return (
        F.when(summary.isNull() | (summary == ""), says("empty", 10))
        .when(summary.rlike("(?i)" + "|".join(ERROR_PATTERNS)), says("error", 9))
        .when(F.length(summary) < least, says("too_short", 8))
        .when(truncated, says("truncated", 7))
        .when(summary.rlike("|".join(SUSPICIOUS)), says("suspicious", 6))
        .when(~sections, says("suspicious", 5))
        .otherwise(says("good", 9))
    )


def strip_markdown(text: Column) -> Column:
    for pattern, put in ((r"(?m)^#{1,6}\s+", ""), (r"\*\*(.+?)\*\*", "$1"), (r"\*(.+?)\*", "$1"), (r"`([^`]*)`", "$1"), (r"\[([^\]]+)\]\([^)]*\)", "$1")):
        text = F.regexp_replace(text, pattern, put)
    return text


def context(text: Column, keyword: str, length: int = 150) -> Column:
    """Window of about ``length`` characters around the first occurrence, cut at spaces, with ellipses; null without one."""
    at = F.locate(keyword.lower(), F.lower(text))
    start = F.greatest(F.lit(1), at - (length - len(keyword)) // 2)
    raw = F.substr(text, start.cast("int"), F.lit(length))
    ends = start + length > F.length(text)
    left = F.when(start > 1, F.concat(F.lit("..."), F.regexp_replace(raw, r"^\S*\s+", ""))).otherwise(raw)
    return F.when(at > 0, F.when(ends, left).otherwise(F.concat(F.regexp_replace(left, r"\s+\S*$", ""), F.lit("..."))))


def summary_section(text: Column) -> Column:
    """What stands under the heading Summary, up to the next heading; the whole text without it."""
    found = F.trim(F.regexp_extract(text, r"(?s)##\s*Summary\s*\n(.*?)(?=\n##|\z)", 1))
    return F.when(F.length(found) > 0, found).otherwise(text)


def strip_nulls(text: Column) -> Column:
    return F.translate(text, "\x00", "")


FILE_ENDINGS = {"pdf", "doc", "docx", "ppt", "pptx", "xls", "xlsx"}
VERSION_WORDS = {"compressed", "compr", "final", "draft"}


def is_stamp(tail: str) -> bool:
    """True for the digits of a date or of a copy's number at the end of a file name."""
    inside = tail.strip("()")
    if inside.isdigit() and tail.startswith("(") and tail.endswith(")"):
        return True
    sizes = [len(g) for g in inside.replace(".", "-").replace("/", "-").split("-")]
    if len(sizes) == 1:
        return 6 <= sizes[0] <= 8
    return len(sizes) == 2 and sizes[0] == 4 and 2 <= sizes[1] <= 4 or len(sizes) == 3 and max(sizes[:2]) <= 2 <= sizes[2] <= 4 and 0 not in sizes


def bare_name(name: str | None) -> str | None:
    """A file name without ending, trailing dates, version words and copy numbers, and without a file number and "agenda item" in front."""
    if name is None:
        return None
    stem, dot, ending = name.strip().rpartition(".")
    words = stem if dot and ending.strip().lower() in FILE_ENDINGS else name.strip()
    while True:
        words = words.rstrip(" _-")
        tail = words[len(words.rstrip("0123456789-./()")) :].lstrip("-./")
        if tail and is_stamp(tail):
            words = words[: len(words) - len(tail)]
            continue
        cut = max(words.rfind("-"), words.rfind("_"))
        last = words[cut + 1 :].lower()
        if cut >= 0 and (last in VERSION_WORDS or last[:1] == "v" and last[1:].isdigit()):
            words = words[:cut]
            continue
        break
    first, _, rest = words.lstrip().partition(" ")
    head, dash, number = first.partition("-")
    if dash and head.isdigit() and number.isdigit() and 2 <= len(head) <= 4 and 2 <= len(number) <= 5:
        words = rest
    start = words.lstrip()
    if " ".join(start.lower().split()).startswith("agenda item"):
        words = start[start.lower().index("item") + 4 :].lstrip(" -–:")
    return " ".join(words.replace("_", " ").split(" "))


@F.pandas_udf(StringType())
def bare_names(names: pd.Series) -> pd.Series:
    return names.map(bare_name, na_action="ignore")


def title_from_filename(title: Column) -> Column:
    """The title inside a file name, or null if no real title is left."""
    return accepted_title(bare_names(title))


def accepted_title(value: Column) -> Column:
    from plenum.functions.rules import garbage_title

    t = F.regexp_replace(value, r"^[ \-–_]+|[ \-–_]+$", "")
    return F.when(t.rlike("[A-Za-z]{4}") & garbage_title(t).isNull(), F.substring(t, 1, 150))


def subject_line(text: Column) -> Column:
    """Title after a subject label, on its line or the next that is not blank."""
    found = F.regexp_extract(text, r"(?im)^\s*(?:subject|re|regarding)\s*:[ \t]*(?:\n\s*)?(\S[^\n]*)", 1)
    return accepted_title(F.trim(found))


def attachment_kind(url: Column, name: Column) -> Column:
    both = F.lower(F.concat_ws(" ", url, name))
    return F.when(both.rlike(r"\.pdf\b"), "pdf").when(both.rlike(r"\.docx?\b"), "doc").when(both.rlike(r"\.(xlsx?|csv)\b"), "spreadsheet").when(both.rlike(r"\.(pptx?)\b"), "presentation").when(both.rlike(r"\.(png|jpe?g|gif|tiff?)\b"), "image").otherwise("unknown")


def looks_like_minutes(label: Column) -> Column:
    return F.coalesce(tokens_key(label).rlike(r"(^| )(minutes|min|action summary)( |$)"), F.lit(False))


def file_version(name: Column) -> tuple[Column, Column]:
    """Base name and version number (0 without one) of a versioned file name."""
    version = F.coalesce(F.regexp_extract(name, r"(?i)\bver\s?(\d+)", 1).try_cast("int"), F.lit(0))
    return F.trim(F.regexp_replace(F.lower(name), r"(?i)\bver\s?\d+", "")), version


def city_state(text: Column) -> Column:
    """City and two-letter state from "City, ST" or "City ST"; state null if none is given."""
    plain = squeezed(text)
    state = F.upper(F.regexp_extract(plain, r"[,\s]\s*([A-Za-z]{2})$", 1))
    has = (F.length(state) == 2) & plain.rlike(r"^.+[,\s]\s*[A-Za-z]{2}$")
    city = F.when(has, F.trim(F.regexp_replace(plain, r"\s*[,\s]\s*[A-Za-z]{2}$", ""))).otherwise(plain)
    return F.struct(city.alias("city"), F.when(has, state).alias("state"))


def banana_key(city: Column, state: Column) -> Column:
    return F.concat(F.lower(F.regexp_replace(city, r"[^A-Za-z0-9]", "")), F.upper(state))


EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
PHONE = r"\(?\b\d{3}\)?[-. ]\d{3}[-. ]\d{4}\b"
LINK = r"https?://[^\s<>\"')\]]+"


def contacts(text: Column) -> Column:
    """Distinct e-mail addresses, telephone numbers (ten digits, leading +1) and addresses of streams in a text."""
    every = lambda p: F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(f"({p})"))
    phones = F.array_distinct(F.transform(every(PHONE), lambda p: F.concat(F.lit("+1"), F.regexp_replace(p, r"\D", ""))))
    streams = F.filter(F.array_distinct(every(LINK)), lambda u: u.rlike(r"(?i)zoom\.us|youtube\.com|youtu\.be|teams\.microsoft|webex|granicus|swagit"))
    return F.struct(F.array_distinct(F.transform(every(EMAIL), F.lower)).alias("emails"), phones.alias("phones"), streams.alias("streams"))


def email_purpose(text: Column, email: Column) -> Column:
    """Purpose inferred from the words within a hundred characters of an address."""
    at = F.locate("@", text)
    around = F.lower(F.substr(text, F.greatest(F.lit(1), F.instr(text, email) - 100), F.length(email) + 200))
    return F.when(at == 0, None).when(around.rlike("public comment|written comment|comments? (?:to|at)"), "comments").when(around.rlike("accommodat|accessib|ada "), "accessibility").when(around.rlike("clerk"), "clerk").otherwise("general")


def base36(number: Column) -> Column:
    return F.lower(F.conv(number.cast("string"), 10, 36))


# Functions that built-ins can't express -------------------------------------


def fold_text(text: str | None) -> str | None:
    """Without accents, lower case."""
    if text is None:
        return None
    return "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c)).lower()


@F.pandas_udf(StringType())
def fold(text: pd.Series) -> pd.Series:
    return text.map(fold_text)


TITLES = re.compile(r"(?i)^(?:(?:council(?:l?or|\s*(?:member|man|woman|person))|(?:board|committee|commission)?\s*member|ald|alder(?:man|woman|person)|commissioner|supervisor|trustee|mayor(?:\s+pro\s+tem(?:pore)?)?|vice[\s-]+mayor|president|vice[\s-]+president|chair(?:man|woman|person)?|vice[\s-]+chair(?:man|woman|person)?|mr|mrs|ms|dr|hon)\b\.?\s*)+")


def clean_person(name: str | None) -> str | None:
    """A name without titles, parentheses, generational suffixes and what follows a sentence end."""
    if name is None:
        return None
    name = re.sub(r"\([^)]*\)", " ", name)
    name = re.sub(r"(?<=[a-z]{2})\.\s.*$", "", name.strip())
    name = TITLES.sub("", name.strip())
    name = re.sub(r",?\s+(?:jr|sr|ii|iii|iv)\.?$", "", name, flags=re.I)
    return re.sub(r"\s+", " ", name).strip(" ,.;:-") or None


@F.pandas_udf(StringType())
def clean_name(name: pd.Series) -> pd.Series:
    return name.map(clean_person)


def people(blob: str | None) -> list[str]:
    """Names of a list written with commas, semicolons, ampersands or "and"."""
    parts = re.split(r"\s*(?:,|;|&|\band\b)\s*", blob or "")
    return [n for n in map(clean_person, parts) if n and not re.fullmatch(r"(?i)jr|sr|ii|iii|iv", n)]


@F.pandas_udf(ArrayType(StringType()))
def split_names(blob: pd.Series) -> pd.Series:
    return blob.map(people)


def looks_like_name(name: Column) -> Column:
    """One to four capitalised words without digits."""
    return F.coalesce(name.rlike(r"^\p{Lu}[\p{L}'’.-]*(?: \p{Lu}?[\p{L}'’.-]+){0,3}$") & ~name.rlike(r"\d"), F.lit(False))


def run_lengths(line: str, least: int = 4) -> str:
    """Runs of ``least`` or more equal tokens as VALUE*N."""
    out, tokens, i = [], line.split(" "), 0
    while i < len(tokens):
        j = i
        while j < len(tokens) and tokens[j] == tokens[i]:
            j += 1
        out += [f"{tokens[i]}*{j - i}"] if j - i >= least and tokens[i] else tokens[i:j]
        i = j
    return " ".join(out)


@F.pandas_udf(StringType())
def compact_runs(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else "\n".join(run_lengths(x) for x in t.split("\n")))


def digits36(number: int) -> str:
    out = ""
    while True:
        number, d = divmod(number, 36)
        out = "0123456789abcdefghijklmnopqrstuvwxyz"[d] + out
        if not number:
            return out


def dictionary_text(text: str) -> str:
    """Repeated lines replaced by short aliases, where that saves characters; the aliases come first."""
    lines = text.split("\n")
    counts: dict[str, int] = {}
    for line in lines:
        counts[line] = counts.get(line, 0) + 1
    alias: dict[str, str] = {}
    for line, n in counts.items():
        short = f"@{digits36(len(alias))}"
        if n > 1 and len(line) * n > len(short) * n + len(line) + len(short) + 2:
            alias[line] = short
    return "\n".join([f"{a}={line}" for line, a in alias.items()] + [alias.get(x, x) for x in lines])


@F.pandas_udf(StringType())
def dictionary_encode(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else dictionary_text(t))
