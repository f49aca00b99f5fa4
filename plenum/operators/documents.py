"""Document structure: HTML cleaning, agenda splitting, furniture lines, outlines and links."""

from __future__ import annotations

import re
from collections.abc import Callable
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

HIDDEN = {"script", "style", "nav", "header", "footer", "form", "select", "button", "textarea", "noscript", "template"}
LINES = {"p", "div", "li", "tr", "br", "h1", "h2", "h3", "h4", "h5", "h6", "section", "article", "td", "title"}


class Lines(HTMLParser):
    """Visible text of a page as lines; the title comes first."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.hidden, self.in_title = 0, False
        self.title, self.parts = [], []

    def handle_starttag(self, tag: str, attrs: list) -> None:
        said = dict(attrs)
        if tag in HIDDEN or "hidden" in said or (self.hidden and tag not in ("br", "img", "input", "hr", "meta", "link")):
            self.hidden += tag not in ("input", "br", "img", "hr", "meta", "link")
        self.in_title |= tag == "title"
        if tag in LINES:
            self.parts.append("\n")

    def handle_endtag(self, tag: str) -> None:
        self.hidden = max(0, self.hidden - 1) if self.hidden else 0
        if tag == "title":
            self.in_title = False
        if tag in LINES:
            self.parts.append("\n")

    def handle_data(self, data: str) -> None:
        if self.in_title:
            self.title.append(data)
        elif not self.hidden:
            self.parts.append(data)


def visible_text(html: str | None) -> str | None:
    """Lines of visible text without consecutive repeats."""
    if html is None:
        return None
    parser = Lines()
    parser.feed(html)
    parser.close()
    lines = [re.sub(r"\s+", " ", x).strip() for x in "".join([*parser.title, "\n", *parser.parts]).split("\n")]
    out: list[str] = []
    for line in lines:
        if line and (not out or out[-1] != line):
            out.append(line)
    return "\n".join(out)


@F.pandas_udf(StringType())
def sanitize_html(html: pd.Series) -> pd.Series:
    return html.map(visible_text)


def document_links(html: Column) -> Column:
    """Distinct link targets that look like documents."""
    links = F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit(r'(?i)<a\b[^>]*\bhref="([^"]+)"'))
    return F.array_distinct(F.filter(links, lambda u: u.rlike(r"(?i)\.(pdf|docx?|xlsx?|pptx?)(?:[?#]|$)|/(?:document|attachment|file|view)s?/")))


MAGIC = [("pdf", b"%PDF-"), ("zip", b"PK\x03\x04"), ("ole", b"\xd0\xcf\x11\xe0"), ("rtf", b"{\\rtf"), ("png", b"\x89PNG"), ("jpeg", b"\xff\xd8\xff"), ("tiff", b"II*\x00"), ("gif", b"GIF8")]


def sniff_format(data: Column, declared: Column | None = None) -> Column:
    """Format of binary content by its first bytes; Office files by their listing; markup and text by look, else the declared type."""
    head = F.hex(F.substring(data, 1, 16))
    found = F.lit(None).cast("string")
    for name, magic in reversed(MAGIC):
        found = F.when(head.startswith(magic.hex().upper()), name).otherwise(found)
    body = F.hex(F.substring(data, 1, 4096))
    has = lambda s: body.contains(s.encode().hex().upper())
    office = F.when(has("word/"), "docx").when(has("xl/"), "xlsx").when(has("ppt/"), "pptx").otherwise("zip")
    html = has("<html") | has("<HTML") | has("<!DOCTYPE html") | has("<!doctype html")
    other = F.when(html, "html").otherwise(F.lit("unknown") if declared is None else F.coalesce(F.regexp_extract(F.lower(declared), r"(pdf|html|plain|msword|json)", 1), F.lit("unknown")))
    return F.when(found == "zip", office).otherwise(F.coalesce(found, other))


def repeated_lines(docs: DataFrame, key: str, text: str, least: int = 3) -> DataFrame:
    """Lines that occur ``least`` times or more within a document: headers and footers."""
    lines = docs.select(key, F.explode(F.split(text, "\n", -1)).alias("line")).withColumn("line", F.trim("line")).where("line <> ''")
    return lines.groupBy(key, "line").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)


HEADING = re.compile(r"^\s*(?:item\s+)?((?:\d{1,3}|[A-Z])(?:\.\d{1,2}|[a-z])?)[.)]\s+(\S.{2,})$")
ALONE = re.compile(r"^\s*((?:\d{1,3}|[A-Z])(?:\.\d{1,2})?)[.)]\s*$")


def headings(lines: list[str]) -> list[tuple[int, str, str]]:
    """(line, number, title) of numbered headings on one line, or with the number alone on the line before."""
    out, seen = [], set()
    for i, line in enumerate(lines):
        m = HEADING.match(line)
        number, title = (m[1], m[2]) if m else (None, None)
        if not m and (m := ALONE.match(line)):
            title = next((x.strip() for x in lines[i + 1 : i + 3] if x.strip()), "")
            number = m[1] if len(title) > 3 else None
        if number and (number, title) not in seen:
            seen.add((number, title))
            out.append((i, number, title.strip()))
    return out


def agenda_items(text: str | None, least: int = 3, most: int = 80) -> list[dict]:
    """Items of a flat agenda: each heading owns the lines up to the next; too few or too many headings give none."""
    lines = (text or "").split("\n")
    found = headings(lines)
    if not least <= len(found) <= most:
        return []
    ends = [x[0] for x in found[1:]] + [len(lines)]
    return [{"number": n, "title": t, "body": "\n".join(lines[i + 1 : e]).strip()} for (i, n, t), e in zip(found, ends)]


@F.pandas_udf(ArrayType(StructType([StructField(n, StringType()) for n in ("number", "title", "body")])))
def split_agenda(text: pd.Series) -> pd.Series:
    return text.map(agenda_items)


def ordered_rungs(ladder: list[str], hint: str | None) -> list[str]:
    """The ladder with the hinted rung first; a hint reorders and never adds."""
    return [hint, *[r for r in ladder if r != hint]] if hint in ladder else list(ladder)


def cascade(text: str | None, engines: dict[str, Callable[[str], list[dict]]], ladder: list[str], hint: str | None = None) -> dict:
    """First rung that yields items, with every attempt and why it failed."""
    attempts = []
    for rung in ordered_rungs(ladder, hint):
        try:
            items = engines[rung](text or "")
            why = None if items else "no_items"
            if items and numeric_table(items):
                items, why = [], "numeric_table"
        except Exception as error:  # a rung may fail on any text; the next one is tried
            items, why = [], type(error).__name__
        attempts.append({"rung": rung, "items": len(items), "failure": why})
        if items:
            return {"rung": rung, "items": items, "attempts": attempts}
    return {"rung": None, "items": [], "attempts": attempts}


def numeric_table(items: list[dict]) -> bool:
    """True if ten or more items have mostly digits for titles."""
    digits = [sum(c.isdigit() for c in x["title"]) * 2 > len(x["title"].replace(" ", "")) for x in items]
    return len(items) >= 10 and sum(digits) >= 0.8 * len(digits)


def segmentation_smell(numbered_lines: Column, items: Column) -> Column:
    """under_split if the document numbers far more lines than items were found, over_split the other way."""
    under = (items > 0) & (numbered_lines >= F.greatest(F.lit(6), 2 * items))
    over = (numbered_lines >= 3) & (items >= F.greatest(F.lit(10), 3 * numbered_lines))
    return F.when(under, "under_split").when(over, "over_split")


def morphology(external: Column, internal: Column, pages: Column, outline: Column, has_text: Column, numbered: Column) -> Column:
    """Shape of a document from its profile, structure before scans and links before headings."""
    return (
        F.when(external >= 3, "linked_agenda")
        .when((internal >= 3) & (pages >= 10), "anchored_packet")
        .when((outline >= 3) & (pages >= 10), "toc_packet")
        .when(outline >= 3, "toc_agenda")
        .when(~has_text, "scanned")
        .when((numbered >= 3) & (pages <= 15) & (external <= 2), "flat_text_agenda")
        .otherwise("monolith")
    )


def bare_document(pages: Column, links: Column, characters: Column) -> Column:
    """One short page that links nowhere; unknown figures mean no."""
    return F.coalesce((pages == 1) & (links == 0) & (characters <= 2000), F.lit(False))


def page_span(text: Column, first: Column, last: Column, mark: str = "--- PAGE ") -> Column:
    """Pages first to last (from 1) of a text whose pages begin with a mark."""
    parts = F.filter(F.split(text, r"(?=\Q" + mark + r"\E\d)", -1), lambda p: p.startswith(mark))
    return F.array_join(F.slice(parts, first, F.greatest(last - first + 1, F.lit(0))), "")


def link_clusters(links: DataFrame, page: str, y: str, gap: float) -> DataFrame:
    """Links grouped where the vertical gap to the one before is larger than ``gap``: gaps and islands."""
    w = Window.partitionBy("doc_id").orderBy(page, y)
    new = (F.lag(page).over(w) != F.col(page)) | (F.col(y) - F.lag(y).over(w) > gap) | F.lag(page).over(w).isNull()
    return links.withColumn("cluster", F.sum(new.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))


def owner_above(lines: DataFrame, page: str, y: str, is_heading: str, heading: str) -> DataFrame:
    """Each line with the nearest heading at or above it, by one pass over the document's order."""
    w = Window.partitionBy("doc_id").orderBy(page, y).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return lines.withColumn("owner", F.last(F.when(F.col(is_heading), F.col(heading)), ignorenulls=True).over(w))


def outline_ranges(outline: DataFrame, pages: str) -> DataFrame:
    """Item page ranges between outline entries: each ends before the next begins, the last with the document."""
    w = Window.partitionBy("doc_id").orderBy("page", "entry")
    following = F.lead("page").over(w)
    return outline.withColumn("last_page", F.greatest(F.col("page"), F.coalesce(following - 1, F.col(pages))))


def outline_levels(outline: DataFrame) -> DataFrame:
    """Entries of level 3 with their section and item: the last level-1 and level-2 entries before them."""
    w = Window.partitionBy("doc_id").orderBy("page", "entry").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    at = lambda n: F.last(F.when(F.col("level") == n, F.col("title")), ignorenulls=True).over(w)
    return outline.withColumn("section", at(1)).withColumn("item", at(2))


# What makes a text a table, and marks a redline.
TABLE_LINES, WIDE_SHARE, NUMBER_SHARE, REPEATING_LINES = 200, 0.20, 0.45, 20
STRUCK_SPANS = 3


def fixed_width_table(text: Column) -> Column:
    """True for report output in columns: many lines with two wide gaps, many of mostly digits, or some that repeat the same few words.

    Whole texts are looked at; those of fewer than ``TABLE_LINES`` lines are never tables.
    """
    lines = F.filter(F.split(F.coalesce(text, F.lit("")), r"\r\n|[\n\r]", -1), lambda x: F.trim(x) != "")
    gaps = lambda x: F.regexp_count(x, F.lit(r"[ \t]{2,}")) >= 2
    digits = lambda x: F.regexp_count(x, F.lit("[0-9]"))
    numeric = lambda x: (digits(x) >= 4) & (digits(x) >= 0.20 * F.length(F.trim(x)))
    words = lambda x: F.regexp_extract_all(x, F.lit(r"(\S+)"))
    repeating = lambda x: (F.size(words(x)) >= 8) & (2 * F.size(F.array_distinct(words(x))) <= F.size(words(x)))
    total = F.size(lines)
    count = lambda test: F.size(F.filter(lines, test))
    shaped = (count(gaps) >= WIDE_SHARE * total) | (count(numeric) >= NUMBER_SHARE * total) | (count(repeating) >= REPEATING_LINES)
    return (total >= TABLE_LINES) & shaped


def redline_counts(struck: Column, underlined: Column) -> Column:
    """True if so many struck and underlined spans mark a redline: three struck ones, or one of each."""
    return (struck >= STRUCK_SPANS) | (F.least(struck, underlined) >= 1)
