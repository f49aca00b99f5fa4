"""Minutes: attendance, item anchors, vote evidence and checked observations."""

from __future__ import annotations

import re
from bisect import bisect_left
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plenum.functions.text import clean_person, fold_text, people

PRESENT = re.compile(r"(?is)\b(?:members?\s+)?(?:present|in attendance)\s*(?:were|included|:|-)?\s*(?:\((\d+)\)|(\d+)\s*[-:])?\s*:?\s*([^.;]*?)(?=\.\s|\.$|;|\n\s*\n|\babsent\b|$)")
ABSENT = re.compile(r"(?is)\babsent\s*(?:\((\d+)\)|(\d+)\s*[-:])?\s*:\s*([^.;]*?)(?=\.\s|\.$|;|\n\s*\n|\bpresent\b|\n[A-Z ]{6,}|$)")
NARRATIVE = re.compile(r"(?is)(?:^|(?<=\.)\s|\n)([^.\n]*(?:\n[^.\n]+)*?)\s+(?:was|were)\s+(present|absent)\b")


@dataclass
class Attendance:
    present: list[str] = field(default_factory=list)
    absent: list[str] = field(default_factory=list)
    present_count: int | None = None


def attendance(text: str | None) -> Attendance:
    """Who was there, from labels or from sentences; a stated count comes along."""
    text = re.sub(r"[ \t]+", " ", text or "")
    out = Attendance()
    if m := ABSENT.search(text):
        out.absent = people(m[3].replace("\n", " "))
    if (m := PRESENT.search(text)) and m[3].strip():
        out.present = [p for p in people(m[3].replace("\n", " ")) if p]
        stated = m[1] or m[2]
        out.present_count = int(stated) if stated else len(out.present)
    if not out.present:
        for blob, kind in NARRATIVE.findall(text):
            names = people(re.sub(r"(?i)\b(deputy\s+)?(mayors?|council\s*members?|commissioners?|trustees?)\b", " ", blob.replace("\n", " ")))
            (out.present if kind.lower() == "present" else out.absent).extend(n for n in names if n[:1].isupper())
        out.present_count = len(out.present) or None
    return out


SECTION = re.compile(r"(?im)^\s*(ayes?|yeas?|yes|noes|nays?|no|abstain(?:ed|ing)?|abstentions?|absent|recused?)\s*(?:\((\d+)\)|[-:]?\s*(\d+)\s*[-:]|[:-])\s*(.*)$")
SIDES = {"a": "yes", "y": "yes", "n": "no"}
RESULT = re.compile(r"(?i)\bmotion\s+(?:was\s+)?(carried|carries|passed|passes|approved|failed|fails|defeated)\b(?:\s+unanimously)?(?:[^.\n]*?\b(\d{1,2})\s*[-–]\s*(\d{1,2})\b)?")
MOVER = re.compile(r"(?i)\b(?:moved by|motion by|motion made by)\s+([^,.;\n]+?)(?:,?\s+(?:and\s+)?second(?:ed)?(?:\s+by)?\s+([^,.;\n]+))?(?=[,.;\n]|$)")


def side_of(word: str) -> str:
    word = word.lower()
    if word.startswith("abst"):
        return "abstain"
    if word.startswith("absent"):
        return "absent"
    return "recused" if word.startswith("recus") else SIDES[word[0]]


def evidence(block: str | None) -> list[dict]:
    """Motions of a block with outcome, stated tally, movers, unanimity and the members listed on each side."""
    block = block or ""
    found = list(RESULT.finditer(block))
    out = []
    for i, m in enumerate(found):
        start = found[i - 1].end() if i else 0
        stop = found[i + 1].start() if i + 1 < len(found) else len(block)
        around, after = block[start : m.end()], block[m.end() : stop]
        members, stated = {}, {}
        for s in SECTION.finditer(block[start:stop]):
            side = side_of(s[1])
            names = [] if re.fullmatch(r"(?i)\s*(none|0)?\.?\s*", s[4]) else people(s[4])
            members.setdefault(side, []).extend(names)
            if s[2] or s[3]:
                stated[side] = int(s[2] or s[3])
        mover = list(MOVER.finditer(around))
        out.append(
            {
                "outcome": "failed" if m[1].lower()[:2] in ("fa", "de") else "passed",
                "yes": int(m[2]) if m[2] else stated.get("yes"),
                "no": int(m[3]) if m[3] else stated.get("no"),
                "unanimous": bool(re.search(r"(?i)unanimous", around + after[:80])),
                "mover": clean_person(mover[-1][1]) if mover else None,
                "seconder": clean_person(mover[-1][2]) if mover and mover[-1][2] else None,
                "members": [{"side": k, "name": n} for k, names in members.items() for n in names],
                "start": m.start(),
            }
        )
    return out


ABBREVIATION = re.compile(r"(?i)\b(?:mr|mrs|ms|dr|st|no|jr|sr|inc|ave|blvd|[a-z])\.$")


def sentence_spans(text: str) -> list[tuple[int, int]]:
    """Offsets of sentences; a full stop after an abbreviation or an initial ends none."""
    out, start = [], 0
    for m in re.finditer(r"[.!?](?=\s|$)", text):
        if not ABBREVIATION.search(text[start : m.end()]):
            out.append((start, m.end()))
            start = m.end() + len(text[m.end() :]) - len(text[m.end() :].lstrip())
    if text[start:].strip():
        out.append((start, len(text)))
    return out


def increasing(anchors: list[tuple[int, str]]) -> list[tuple[int, str]]:
    """Longest subsequence whose offsets increase: anchors that stand in the items' order; among equals the earliest.

    The longest run before an offset is a maximum over smaller offsets, kept in a
    tree of prefix maxima, so the work grows with n log n.
    """
    ranks = sorted({offset for offset, _ in anchors})
    tree = [(0, 1)] * (len(ranks) + 1)  # (length, minus the anchor's place); a place of -1 for none
    before: list[int] = []
    best = (0, 1)
    for i, (offset, _) in enumerate(anchors):
        at = bisect_left(ranks, offset)
        longest, node = (0, 1), at
        while node > 0:
            longest = max(longest, tree[node])
            node -= node & -node
        before.append(-longest[1])
        mine, node = (longest[0] + 1, -i), at + 1
        while node < len(tree):
            tree[node] = max(tree[node], mine)
            node += node & -node
        best = max(best, mine)
    out, at = [], -best[1]
    while at >= 0:
        out.append(anchors[at])
        at = before[at]
    return out[::-1]


def anchors_of(text: str, items: list[dict]) -> list[tuple[int, str]]:
    """Offset of each item in the minutes: by file number, else agenda number at a line start, else most of its title's words."""
    low = fold_text(text) or ""
    lines, at = [], 0
    for line in low.split("\n"):
        lines.append((at, line))
        at += len(line) + 1
    found = []
    for item in items:
        offset = -1
        if item.get("matter_file"):
            offset = low.find(fold_text(item["matter_file"]))
        if offset < 0 and item.get("agenda_number"):
            number = re.escape(fold_text(item["agenda_number"]).rstrip(".)"))
            m = re.search(rf"(?m)^\s*(?:item\s+)?{number}[.)]\s", low)
            offset = m.start() if m else -1
        if offset < 0 and item.get("title"):
            words = set(re.findall(r"\w{4,}", fold_text(item["title"])))
            scored = [(len(words & set(re.findall(r"\w{4,}", line))) / max(1, len(words)), -o) for o, line in lines if words]
            share, place = max(scored, default=(0, 0))
            offset = -place if share >= 0.7 else -1
        if offset >= 0:
            found.append((offset, item["id"]))
    return increasing(found)


def item_blocks(text: str, items: list[dict]) -> list[tuple[str, int, int]]:
    """(item id, start, end) from each anchor to the next, or to a heading that ends the business."""
    found = anchors_of(text, items)
    out = []
    for i, (start, name) in enumerate(found):
        end = found[i + 1][0] if i + 1 < len(found) else len(text)
        stop = re.search(r"(?m)^\s*(?:ADJOURN\w*|PUBLIC COMMENT|CONSENT AGENDA)\b", text[start + 1 : end])
        out.append((name, start, start + 1 + stop.start() if stop else end))
    return out


def roster_keys(roster: list[str]) -> dict[str, str]:
    """Keys that name exactly one member: full name, last name, last two names, initial and last name."""
    owners: dict[str, set[str]] = {}
    for name in roster:
        words = (fold_text(clean_person(name) or "") or "").split()
        if words:
            for key in {" ".join(words), words[-1], " ".join(words[-2:]), f"{words[0][0]} {words[-1]}"}:
                owners.setdefault(key, set()).add(name)
    return {k: next(iter(v)) for k, v in owners.items() if len(v) == 1}


def resolve(raw: str, keys: dict[str, str]) -> str | None:
    words = (fold_text(clean_person(raw) or "") or "").replace(".", "").split()
    tries = [" ".join(words), " ".join(words[-2:]), f"{words[0][0]} {words[-1]}" if words else "", words[-1] if words else ""]
    return next((keys[t] for t in tries if t in keys), None)


def observe(text: str, items: list[dict], roster: list[str]) -> list[dict]:
    """Claims of the minutes about each item's motions; what contradicts itself is withheld, with the reason.

    The outcome stands by itself. A tally is withheld if the listed sides have
    other numbers, and the members with it; a member is withheld if the name is
    unknown, ambiguous, or on two sides.
    """
    keys, out = roster_keys(roster), []
    for item, start, end in item_blocks(text, items):
        for index, e in enumerate(evidence(text[start:end])):
            listed = {}
            for m in e["members"]:
                listed[m["side"]] = listed.get(m["side"], 0) + 1
            clash = any(e[s] is not None and s in listed and listed[s] != e[s] for s in ("yes", "no"))
            out.append({"item_id": item, "motion_index": index, "claim": "outcome", "value": e["outcome"], "member": None, "withheld": None})
            if e["yes"] is not None:
                out.append({"item_id": item, "motion_index": index, "claim": "tally", "value": f"{e['yes']}-{e['no'] or 0}", "member": None, "withheld": "tally_contradicts_lists" if clash else None})
            named = [(resolve(m["name"], keys), m) for m in e["members"]]
            for who, m in named:
                twice = who is not None and len({x["side"] for w, x in named if w == who}) > 1
                why = "tally_contradicts_lists" if clash else "unknown_member" if who is None else "two_sides" if twice else None
                out.append({"item_id": item, "motion_index": index, "claim": "vote", "value": m["side"], "member": who or m["name"], "withheld": why})
    return out


def observations(meetings: DataFrame) -> DataFrame:
    """Claims of many meetings (``meeting_id``, ``text``, ``items``, ``roster``), one row each; a meeting is read by itself."""

    def run(batches):
        for pdf in batches:
            rows = []
            for m, text, items, roster in zip(pdf["meeting_id"], pdf["text"], pdf["items"], pdf["roster"]):
                parts = [dict(x) if isinstance(x, dict) else x.asDict() for x in (items if items is not None else [])]
                rows += [{"meeting_id": m, **o} for o in observe(text or "", parts, list(roster if roster is not None else []))]
            yield pd.DataFrame(rows, columns=["meeting_id", "item_id", "motion_index", "claim", "value", "member", "withheld"])

    return meetings.select("meeting_id", "text", "items", "roster").mapInPandas(run, "meeting_id string, item_id string, motion_index int, claim string, value string, member string, withheld string")


def compare(parsed: DataFrame, published: DataFrame, keys: list[str]) -> DataFrame:
    """Agreement of parsed and published votes (``member``, ``vote``) per motion; not comparable where either side has none."""
    a = parsed.select(*keys, "member", F.col("vote").alias("ours"))
    b = published.select(*keys, "member", F.col("vote").alias("theirs"))
    both = a.join(b, [*keys, "member"], "full_outer")
    stats = both.groupBy(*keys).agg(F.count("ours").alias("parsed"), F.count("theirs").alias("published"), F.count_if(F.col("ours") == F.col("theirs")).alias("same"), F.count(F.lit(1)).alias("members"))
    verdict = F.when((F.col("parsed") == 0) | (F.col("published") == 0), "not_comparable").when(F.col("same") == F.col("members"), "agreement").otherwise("disagreement")
    return stats.withColumn("verdict", verdict)


def motions(votes: DataFrame, explicit: DataFrame, keys: list[str], best: str = "minutes") -> DataFrame:
    """Motions with their votes nested, of the preferred source per item; ``summary`` marks each matter's last motion."""
    from pyspark.sql import Window

    nested = votes.groupBy(*keys, "motion_index", "source").agg(F.array_sort(F.collect_list(F.struct("member", "vote"))).alias("votes"))
    every = nested.join(explicit.select(*keys, "motion_index", "source", "outcome"), [*keys, "motion_index", "source"], "full_outer")
    has_best = F.coalesce(F.max(F.col("source") == best).over(Window.partitionBy(*keys)), F.lit(False))
    kept = every.withColumn("__best", has_best).where((F.col("source") == best) | ~F.col("__best")).drop("__best")
    last = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("motion_index"), "source")) == 1
    return kept.withColumn("summary", last)
