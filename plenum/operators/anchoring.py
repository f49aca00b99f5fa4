"""Where each agenda item begins in the minutes: every place that tells of an item is weighed, and the heaviest chain in agenda order wins.

A meeting's text, which is a row, meets its items in one join and is read once, with
its tokens, leading numbers and words looked up in tables of that meeting: a file number or the code that
leads a title by its longest token, an agenda number by the number that leads a
line, a title by its rarest words. How much a word of a title counts follows how
few lines of the meeting have it. What several kinds say of one line is summed, so
a heading outweighs a mention in passing, wherever the mention stands.
"""

from __future__ import annotations

import math
import re
import sys
import unicodedata
from collections import defaultdict
from collections.abc import Iterator, Sequence
from functools import cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plenum.operators.rollcall import FURNITURE

# Words of titles that say nothing about which item it is.
COMMON = (
    "the a an of and or to for in on at by with from as is be that this city county council approve "
    "approval consider consideration action item regarding re"
).split()
TITLE_WORDS, LEAST_WORDS = 8, 3  # words of a title that count, and fewer than which tell nothing
SHARE = 0.8  # of the weight of a title's words that a place must have
WRAP = 2  # lines below its first over which a title may run on
EARLY = 12  # characters of a line within which a file number or code leads it

# Weights in thousandths. A number alone says least: lists inside an item have numbers too.
FILE, CODE, TITLE, NUMBER, LEADS = 4000, 4000, 3000, 1500, 1000
KINDS = ["file", "code", "title", "number"]

LINE_NUMBER = r"^\s*(?:(?i:item)\s+)?([A-Za-z0-9][A-Za-z0-9.]{0,11}?)([.)]?)\s+(?=[A-Za-z(\"'])"
MEASURE = r"^\d+(?:\.\d+)+$"
NUMBERED = r"^\d{1,2}\.[A-Za-z0-9]{1,2}$"
SHORT = r"^(?:\d{1,2}|[A-Za-z])$"


def telling_words(text: Column) -> Column:
    """Distinct words of three letters or more, in order, without common ones."""
    words = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"(\p{L}[\p{L}'-]{2,})"))
    return F.array_distinct(F.filter(words, lambda w: ~w.isin(COMMON)))


@cache
def word_pattern(ascii_only: bool) -> re.Pattern:
    """Words of :func:`telling_words` in a text in lower case."""
    if ascii_only:
        return re.compile(r"[a-z][a-z'-]{2,}")
    letters = [c for c in range(sys.maxunicode + 1) if unicodedata.category(chr(c))[0] == "L"]
    edges = [c for i, c in enumerate(letters) if i == 0 or letters[i - 1] != c - 1], [c for i, c in enumerate(letters) if i == len(letters) - 1 or letters[i + 1] != c + 1]
    spans = "".join(f"{re.escape(chr(a))}-{re.escape(chr(z))}" for a, z in zip(*edges))
    return re.compile(rf"[{spans}][{spans}'-]{{2,}}")


def words_of(low: str) -> list[str]:
    return [w for w in dict.fromkeys(word_pattern(low.isascii()).findall(low)) if w not in DULL]


DULL = frozenset(COMMON)
TOKEN = re.compile(r"[a-z0-9]+")
LEADING = re.compile(LINE_NUMBER, re.ASCII)
ALONE = re.compile(SHORT, re.ASCII)
FURNISHED = re.compile(FURNITURE, re.ASCII)


def bounded(core: str, low: str) -> bool:
    """Does ``core`` stand in ``low`` where no letter or digit touches it?"""
    touches = lambda c: "a" <= c <= "z" or "0" <= c <= "9"
    at = low.find(core)
    while at >= 0:
        if not touches(low[at - 1 : at] if at else "") and not touches(low[at + len(core) : at + len(core) + 1]):
            return True
        at = low.find(core, at + 1)
    return False


class Lines:
    """A meeting's lines without page furniture, and which of them have a token, a leading number or a word."""

    def __init__(self, text: str, low: str) -> None:
        pairs = [(n, line, small) for n, (line, small) in enumerate(zip(text.split("\n"), low.split("\n"))) if not FURNISHED.search(line)]
        self.number = [n for n, _, _ in pairs]
        self.low = [small for _, _, small in pairs]
        self.words = [words_of(small) for small in self.low]
        self.token: dict[str, list[int]] = defaultdict(list)
        self.led: dict[str, list[tuple[int, bool]]] = defaultdict(list)
        self.word: dict[str, list[int]] = defaultdict(list)
        for rank, (_, line, small) in enumerate(pairs):
            for t in set(TOKEN.findall(small)):
                self.token[t].append(rank)
            for w in self.words[rank]:
                self.word[w].append(rank)
            if found := LEADING.search(line):
                self.led[found[1]].append((rank, found[2] != ""))


def by_token(lines: Lines, core: str | None, weight: int) -> Iterator[tuple[int, int]]:
    """Lines (rank, weight) with ``core``, a file number or code, that no letter or digit touches."""
    tokens = TOKEN.findall(core or "")
    for rank in lines.token.get(max(tokens, key=lambda t: (len(t), t)), ()) if tokens else ():
        if bounded(core, low := lines.low[rank]):
            yield rank, weight + LEADS * (0 <= low.lstrip(" ").find(core) < EARLY)


def by_number(lines: Lines, number: str | None) -> Iterator[tuple[int, int]]:
    """Lines that begin with the agenda number; one of two digits or a letter needs its stop or bracket."""
    if number:
        alone = ALONE.search(number)
        yield from ((rank, NUMBER) for rank, marked in lines.led.get(number, ()) if marked or not alone)


def by_title(lines: Lines, title: list[str]) -> Iterator[tuple[int, int]]:
    """Lines where a title begins that has its words, up to a fifth of their weight, on the line or, run on, on the next ones.

    Who has all but a fifth of the weight has one of the rarest words that make up
    more than a fifth; only their lines are looked at.
    """
    if len(title) < LEAST_WORDS:
        return
    counts = {w: math.log1p(len(lines.number) / (len(lines.word.get(w, ())) or 1)) for w in title}
    total, before, near = sum(counts.values()), 0.0, set()
    for w in sorted(title, key=lambda w: -counts[w]):
        if before > (1 - SHARE) * total + 1e-9:
            break
        near.update(rank - k for rank in lines.word.get(w, ()) for k in range(WRAP + 1))
        before += counts[w]
    share = lambda held: sum(c for w, c in counts.items() if w in held) / total
    for rank in near:
        if rank < 0:
            continue
        here = lines.words[rank]
        most = share(here)
        if most < 1 - 1e-9 and title[0] in here:
            most = max(most, share({w for line in lines.words[rank : rank + WRAP + 1] for w in line}))
        if most >= SHARE - 1e-9:
            yield rank, math.floor(most * TITLE + 1e-6) + LEADS * (here[:1] == title[:1])


def places(lines: Lines, item: dict) -> dict[int, tuple[int, str]]:
    """Every line that tells of an item: its weight in sum, and the strongest kind that says so."""
    kinds = {"file": by_token(lines, item["file"], FILE), "code": by_token(lines, item["code"], CODE), "title": by_title(lines, item["words"] or []), "number": by_number(lines, item["number"])}
    found: dict[int, tuple[int, str]] = {}
    for kind in KINDS:
        for rank, weight in kinds[kind]:
            at = lines.number[rank]
            found[at] = (found[at][0] + weight, found[at][1]) if at in found else (weight, kind)
    return found


def heaviest_chain(groups: Sequence[Sequence[tuple[int, int]]]) -> list[tuple[int, int]]:
    """(group, place) of the chain with the greatest sum of weights: one (place, weight) a group at most, places growing with the groups.

    Of chains of equal weight the one that takes earlier places counts. The best
    chain below a place is a maximum over smaller places, kept in a tree of prefix maxima.
    """
    rank = {p: i for i, p in enumerate(sorted({p for g in groups for p, _ in g}))}
    tree: list[tuple[int, int]] = [(0, 0)] * (len(rank) + 1)  # weight, minus the number of the link
    links: list[tuple[int, int, int]] = [(-1, -1, 0)]  # group, place, link before
    best = (0, 0)
    for g, options in enumerate(groups):
        reached = []
        for place, weight in sorted(options):
            below, node = (0, 0), rank[place]
            while node > 0:
                below = max(below, tree[node])
                node -= node & -node
            links.append((g, place, -below[1]))
            reached.append((rank[place] + 1, (below[0] + weight, 1 - len(links))))
        for node, chain in reached:  # only now, so that no group is taken twice
            best = max(best, chain)
            while node < len(tree):
                tree[node] = max(tree[node], chain)
                node += node & -node
    out, at = [], -best[1]
    while at:
        g, place, at = links[at]
        out.append((g, place))
    return out[::-1]


def anchors(meetings: DataFrame, items: DataFrame) -> DataFrame:
    """Line where each item begins (``meeting_id``, ``item_id``, ``line_no``, ``kind``, ``weight``), in agenda order.

    ``meetings`` has ``meeting_id`` and ``text``; ``items`` has ``meeting_id``,
    ``item_id``, ``sequence``, ``matter_file``, ``agenda_number`` and ``title``, each
    of which may be null. Items without any place, or whose places stand against
    the agenda's order for less weight, have no row. ``kind`` is the strongest kind
    that tells of the line. Repeated rows of an item count once (the smallest sequence);
    equal sequences go by ``item_id``. A meeting's text and items come together in one row.
    """
    # One row an item: what the rest of its repeated rows say goes with the smallest sequence.
    one = items.groupBy("meeting_id", "item_id").agg(F.min_by(F.struct("sequence", "matter_file", "agenda_number", "title"), F.coalesce("sequence", F.lit(0))).alias("i")).select("meeting_id", "item_id", "i.*")
    name = F.trim("matter_file")
    file = F.lower(F.trim(F.when(name.contains(" "), F.regexp_replace(name, r"^\S+\s+", "")).otherwise(name)))
    code = F.nullif(F.lower(F.regexp_extract("title", r"^\s*([A-Za-z]{1,8}\d{4,10})\b", 1)), F.lit(""))
    plain = F.regexp_replace(F.trim("agenda_number"), r"[.)]+$", "")
    number = F.when(F.length(plain).between(1, 12) & ~(plain.rlike(MEASURE) & ~plain.rlike(NUMBERED)), plain)
    asked = F.struct(
        F.coalesce("sequence", F.lit(0)).alias("sequence"), "item_id", F.when(F.length(file) >= 4, file).alias("file"), code.alias("code"),
        number.alias("number"), F.slice(telling_words(F.col("title")), 1, TITLE_WORDS).alias("words"),
    )
    agenda = one.where("item_id IS NOT NULL").groupBy("meeting_id").agg(F.collect_list(asked).alias("items"))
    text = F.coalesce("text", F.lit(""))
    joined = meetings.select("meeting_id", text.alias("text")).join(agenda, "meeting_id").select("meeting_id", "items", "text", F.lower("text").alias("low"))
    shape = T.StructType([joined.schema["meeting_id"], one.schema["item_id"], T.StructField("line_no", T.IntegerType()), T.StructField("kind", T.StringType()), T.StructField("weight", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, kinds = batch.column(0), [batch.column(0).type, batch.column(1).type.value_type.field("item_id").type, pa.int32(), pa.string(), pa.int64()]
            of, rows = [], []
            for i, (agenda, text, low) in enumerate(zip(*(batch.column(k) for k in (1, 2, 3)))):
                lines = Lines(text.as_py(), low.as_py())
                agenda = sorted(agenda.as_py(), key=lambda x: (x["sequence"], x["item_id"]))
                told = [places(lines, item) for item in agenda]
                for g, at in heaviest_chain([[(p, w) for p, (w, _) in sorted(t.items())] for t in told]):
                    of.append(i)
                    rows.append((agenda[g]["item_id"], at, told[g][at][1], told[g][at][0]))
            columns = list(zip(*rows)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([names.take(pa.array(of, pa.int64())), *(pa.array(c, k) for c, k in zip(columns, kinds[1:]))], names=shape.names)

    return joined.mapInArrow(run, shape)
