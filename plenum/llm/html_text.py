"""Main text of HTML pages from text-to-tag ratios (operator 2)."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed values of the HTML standard: elements without an end tag, elements that
# start a new line, and elements whose content is never article text.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = set(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot "
    "th thead tr ul".split()
)
SILENT = set("head script style noscript template button select textarea option label input iframe object svg canvas audio video".split())
FURNITURE_TAGS = {"nav", "aside", "footer", "dialog", "menu"}
HEADING = {"h1", "h2", "h3", "h4", "h5", "h6"}
CLOSES_P = BLOCK - {"body", "html", "td", "th", "tr", "tbody", "thead", "tfoot", "caption"}
LISTS = {"ul", "ol", "dl", "table", "menu", "select"}
BOXES = {"div", "section", "td", "th", "li", "form", "ul", "ol", "dl", "table", "blockquote", "fieldset", "body", "header", "details", "center", "figure"}
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alert", "menu", "menubar", "toolbar"}
# Words in class names and ids that say what an element is for. A name counts if it
# has a word of the first list and no words but of the three lists.
FURNITURE_WORDS = set(
    "ad ads adsense advert adverts advertisement advertising banner sponsor sponsored promo promotion cookie cookies consent gdpr notice notices "
    "alert popup modal overlay nav navbar navigation menu menus breadcrumb breadcrumbs pager pagination toolbar topbar masthead header footer foot "
    "sidebar aside rail widget widgets related recommended recommendations trending popular share sharing social newsletter subscribe signup login "
    "search comment comments disqus reply replies respond discussion legal copyright disclaimer skip hidden tagcloud".split()
)
CONTENT_WORDS = set("article articlebody articles post posts entry entries story content contents main maincontent body text page".split())
NEUTRAL_WORDS = set("site page box bar wrap wrapper container inner outer block area unit slot list item items link links left right top bottom side section row col column global primary secondary my the js is has".split())
BLANKS = re.compile(r"\s+")
TAIL = re.compile(r"<[/!?a-zA-Z][^<>]*\Z")
NAME_WORDS = re.compile(r"[a-z]+|[A-Z][a-z]+|[A-Z]+")
FURNITURE, FORM, PLAIN, CONTENT = 0.0, 0.15, 1.0, 3.0  # prior weights of a line's score


def names_kind(names: str, whole: bool) -> float:
    """What the names of an element say: ``FURNITURE``, ``CONTENT`` or ``PLAIN``; with ``whole``, content words save a name from being furniture."""
    kind = PLAIN
    for name in names.split():
        words = {w.lower() for w in NAME_WORDS.findall(name)}
        if words & FURNITURE_WORDS and words <= FURNITURE_WORDS | NEUTRAL_WORDS | (set() if whole else CONTENT_WORDS):
            return FURNITURE
        if words & CONTENT_WORDS and words <= CONTENT_WORDS | NEUTRAL_WORDS:
            kind = CONTENT
    return kind


class Line:
    """Text between two block boundaries: its pieces, tags, link share, prior weight and region."""

    __slots__ = ("heading", "link_chars", "parts", "prior", "region", "tags")

    def __init__(self) -> None:
        self.parts: list[str] = []
        self.tags = 1
        self.link_chars = 0
        self.prior = PLAIN
        self.region = 0
        self.heading = False


class LineReader(HTMLParser):
    """Streams parser events into lines; nothing but the open elements and the lines is held.

    Open elements are found by name through the places of each name and of the
    elements that stop a search, so every event costs the same however deep the page.
    """

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, float, int, bool, bool]] = []  # tag, prior, region, inside an article, silent
        self.places: dict[str, list[int]] = {}
        self.stops: dict[str, list[int]] = {"block": [], "not p": [], "list": []}
        self.headings = 0
        self.lines: list[Line] = []
        self.line = Line()
        self.regions = 0

    def state(self) -> tuple[float, int, bool, bool]:
        return self.open[-1][1:] if self.open else (PLAIN, 0, False, False)

    def end_line(self) -> None:
        if self.line.parts:
            self.lines.append(self.line)
        self.line = Line()

    def push(self, tag: str, *state) -> None:
        at = len(self.open)
        self.places.setdefault(tag, []).append(at)
        if tag in BLOCK:
            self.stops["block"].append(at)
            if tag != "p":
                self.stops["not p"].append(at)
        if tag in LISTS:
            self.stops["list"].append(at)
        self.headings += tag in HEADING
        self.open.append((tag, *state))

    def close_open(self, tag: str, stop: str | None) -> None:
        """Close the last open ``tag`` and all inside it, unless an element that stops the search lies between."""
        places = self.places.get(tag)
        if not places or stop and self.stops[stop] and self.stops[stop][-1] > places[-1]:
            return
        upto = places[-1]
        while len(self.open) > upto:
            name = self.open.pop()[0]
            self.places[name].pop()
            if name in BLOCK:
                self.stops["block"].pop()
                if name != "p":
                    self.stops["not p"].pop()
            if name in LISTS:
                self.stops["list"].pop()
            self.headings -= name in HEADING

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in CLOSES_P:
            self.close_open("p", "not p")
        if tag in ("li", "dt", "dd", "tr", "td", "th", "option"):
            self.close_open(tag, "list")
        if tag in BLOCK:
            self.end_line()
        elif tag == "br":
            self.line.parts.append(" ")
        self.line.tags += 1
        if tag in VOID:
            return
        prior, region, inside, silent = self.state()
        said = {k: v or "" for k, v in attrs}
        role = said.get("role", "").lower()
        kind = names_kind(f"{said.get('class', '')} {said.get('id', '')}", tag in ("html", "body", "article", "main")) if "class" in said or "id" in said else PLAIN
        hidden = "hidden" in said or said.get("aria-hidden") == "true" or "style" in said and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", said["style"], re.I)
        silent = silent or tag in SILENT or bool(hidden)
        if tag in FURNITURE_TAGS or tag == "header" and not inside or role in ROLES or kind == FURNITURE and tag not in ("html", "body"):
            prior = FURNITURE
        elif not inside and (tag in ("article", "main") or role in ("main", "article") or said.get("itemprop", "").lower() == "articlebody" or kind == CONTENT and tag in ("div", "section", "td")):
            inside, prior = True, prior * CONTENT
            self.regions += 1
            region = self.regions
        elif tag == "form":
            prior *= FORM
        if tag in BOXES and not inside:
            self.regions += 1
            region = self.regions
        self.push(tag, prior, region, inside, silent)

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        self.line.tags += 1
        if tag in BLOCK:
            self.end_line()
        self.close_open(tag, None if tag in BLOCK else "block")

    def handle_data(self, data: str) -> None:
        prior, region, _, silent = self.state()
        if not data or silent:
            return
        line = self.line
        if line.parts and (line.prior, line.region) != (prior, region) and any(not p.isspace() for p in line.parts):
            self.end_line()
            line = self.line
        line.prior, line.region = prior, region
        line.parts.append(data)
        if self.places.get("a"):
            line.link_chars += len(data)
        line.heading |= self.headings > 0


def smooth(values: list[float], sigma: float = 1.0) -> list[float]:
    """Gaussian smoothing with a kernel cut at three deviations and renormalised at the ends."""
    reach = max(1, math.ceil(3 * sigma))
    kernel = [math.exp(-(k * k) / (2 * sigma * sigma)) for k in range(reach + 1)]
    out = []
    for i in range(len(values)):
        total = weight = 0.0
        for k in range(-reach, reach + 1):
            if 0 <= i + k < len(values):
                total += kernel[abs(k)] * values[i + k]
                weight += kernel[abs(k)]
        out.append(total / weight)
    return out


def threshold(values: list[float]) -> float:
    """Boundary between the low and the high cluster of ratios (two-means on one axis)."""
    cut = sum(values) / len(values)
    for _ in range(50):
        low = [v for v in values if v <= cut]
        high = [v for v in values if v > cut]
        if not low or not high:
            return min(values)
        new = (sum(low) / len(low) + sum(high) / len(high)) / 2
        if abs(new - cut) < 1e-9:
            break
        cut = new
    return min(cut, sum(values) / len(values))


def content_lines(lines: list[Line], sizes: list[int], sigma: float = 1.0) -> list[int]:
    """Places of the lines of the content regions.

    A line's ratio is its characters per tag, those in links counting twice
    against it. Ratios are smoothed over neighbouring lines and weighted by what
    the structure says (articles up, forms down, furniture nothing). Two clusters
    of these scores give the threshold. A region (an article container, else the
    nearest box) is content if the mean score of its text reaches the threshold,
    and its mean before smoothing a quarter of it, so that a menu next to long text
    is not carried along; plain regions between content regions go with them unless they are links, as
    do the headings just before.
    """
    ratio = [max(0.0, n - 2 * x.link_chars) / x.tags for x, n in zip(lines, sizes)]
    scores = [x.prior * s if x.prior else 0.0 for x, s in zip(lines, smooth(ratio, sigma))]
    if not any(scores):
        return []
    cut = threshold(scores)
    total: dict[int, float] = {}
    weight: dict[int, float] = {}
    plain: dict[int, float] = {}
    for x, n, s, r in zip(lines, sizes, scores, ratio):
        if x.prior:
            total[x.region] = total.get(x.region, 0.0) + n * s
            weight[x.region] = weight.get(x.region, 0.0) + n
            plain[x.region] = plain.get(x.region, 0.0) + n * r * x.prior
    chosen = {k for k in total if total[k] / weight[k] >= cut and plain[k] / weight[k] >= cut / 4 and plain[k] > 0}
    if not chosen:
        best = max((k for k in total if plain[k] > 0), key=lambda k: total[k] / weight[k], default=None)
        chosen = set() if best is None else {best}
    picked = [i for i, x in enumerate(lines) if x.prior and x.region in chosen]
    if not picked:
        return []
    highest = max(lines[i].prior for i in picked)
    if highest < CONTENT:  # no article container: what stands between content regions belongs to them
        first, last = picked[0], picked[-1]
        while first and lines[first - 1].heading and lines[first - 1].prior:
            first -= 1
        between = range(first, last + 1)
        return [i for i in between if lines[i].prior and (lines[i].region in chosen or ratio[i] > 0 or not lines[i].link_chars)]
    return picked


def main_text(html: str | None, sigma: float = 1.0) -> str:
    """Article text of one page.

    Lines are the runs between block boundaries. Scripts, styles and hidden
    elements give none; menus, headers, footers, sidebars, notices, adverts and
    reader comments, told by element, role and class, are never content; of the
    rest :func:`content_lines` selects regions by smoothed text-to-tag ratios.
    Null, empty and text-free pages give an empty string.
    """
    if not html:
        return ""
    reader = LineReader()
    reader.feed(TAIL.sub("", html))
    reader.close()
    reader.end_line()
    lines, texts = [], []
    for line in reader.lines:
        if text := BLANKS.sub(" ", "".join(line.parts)).strip():
            lines.append(line)
            texts.append(text)
    return " ".join(texts[i] for i in content_lines(lines, [len(t) for t in texts], sigma))


def op2(pages: DataFrame) -> DataFrame:
    """Main texts of all pages."""
    return extract_pages(pages)


def extract_pages(pages: DataFrame) -> DataFrame:
    """``pages`` (``page_id``, ``url``, ``html``) with the main ``text`` and ``n_chars`` of each row.

    One row per input row, repeated rows included; a null or empty html gives an
    empty text. Each page is parsed alone, so memory is bounded by one Arrow batch.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x.as_py()) for x in batch.column(2)]
            counts = pa.array([len(t) for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), counts], ["page_id", "url", "text", "n_chars"])

    source = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))
    return source.mapInArrow(run, "page_id long, url string, text string, n_chars long")
