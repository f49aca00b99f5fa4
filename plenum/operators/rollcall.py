"""Votes out of the lines of minutes: results, tallies, lists of names and movers become claims with their own verdicts.

Minutes are read as rows, a line each. Expressions say what a line may be (a result, the
heading of a list, a label, prose); windows over a meeting's lines carry the state
between them (which list a line continues, which result a list belongs to, which item
is open). Names meet the roster in an equality join. Python runs for the split and the folding of names only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plenum.functions.text import clean_name, fold, split_names

# Headings of lists, and what their names did.
SIDES = {
    "yes": ["aye", "ayes", "yea", "yeas", "yes", "for", "in favor", "voting aye", "voting yes", "deemed aye"],
    "no": ["no", "noes", "nay", "nays", "against", "opposed", "voting no", "voting nay", "dissenting", "deemed nay"],
    "abstain": ["abstain", "abstained", "abstaining", "abstention", "abstentions"],
    "recused": ["recuse", "recused", "recusal", "recusals"],
    "absent": ["absent", "excused", "not present"],
    "not_voting": ["not voting"],
}
PASSED = ["carried", "carries", "passed", "passes", "prevailed", "approved", "adopted"]
FAILED = ["failed", "fails", "defeated", "denied", "lost"]
VERB = "|".join(PASSED + FAILED)
TALLY = r"(\d{1,2})\s*([-–/])\s*(\d{1,2})(?:\s*([-–/])\s*(\d{1,2}))?(?![\d/–-]|\.\d)"

# How a result is told. Each has one group: the verb that decides it.
RESULTS = [
    rf"(?i)^\s*result\s*:\s*({VERB})\b",
    rf"(?i)\b({VERB})\s+by\s+(?:the\s+)?following\s+(?:roll\s+call\s+)?vote",
    rf"(?i)\bmotion\b[^.;:]{{0,120}}\b({VERB})\b",
    rf"(?i)\b({VERB})\s*,?\s*[(\[]?\d{{1,2}}\s*[-–/]\s*\d{{1,2}}(?![\d/])",
    rf"(?i)\b({VERB})\s+unanimously\b",
    rf"(?i)\bunanimously\s+({VERB})\b",
    r"(?i)\b(vote)[ds]?\s*:?\s*(?:of\s+)?\d{1,2}\s*[-–/]\s*\d{1,2}(?![\d/])",
]
TELLING = rf"(?i){VERB}|vote"  # every result has one of these words
BARE = rf"(?i)^\s*({VERB})\s*\.?\s*$"
BEFORE_TALLY = rf"(?i)(?:\bvote[ds]?|\bvoting|\bmotion|\bunanimously|\b(?:{VERB})|[(\[])\s*[:,]?\s*(?:of\s+)?[(\[]?\s*{TALLY}"
PROCEDURAL = r"(?i)\bto\s+(?:adjourn|recess|reconvene)\b|\b(?:closed|executive)\s+session\b|\b(?:be\s+adjourned|adjournment)\b"
NAME = r"((?:\p{Lu}[\p{L}'’.-]*[ ]?(?:member[ ])?){1,4})"
MOVERS = [rf"(?:(?i:motion\s+(?:was\s+)?(?:made\s+|offered\s+)?(?:by|of)|\bmoved\s+by|^\s*mover:))\s+{NAME}", rf"{NAME}\s*(?:moved|(?:made|offered)\s+(?:a|the)\s+motion)\b"]
SECONDERS = [rf"(?:(?i:\bsecond(?:ed)?\s+by|^\s*seconder:))\s+{NAME}", rf"{NAME}\s*seconded\b(?!\s+by)"]
HEADING = r"^\s*([A-Za-z]+(?: [A-Za-z]+)?)\s*(?::|\s[-–]\s|(?=\s\d{1,2}\s*(?:[-–]|$)))"
LABEL = r"^\s*[A-Za-z][A-Za-z /-]{0,35}:"
FURNITURE = r"(?i)^\s*-{2,}\s*page\s+\d+\s*-{2,}\s*$"
NOBODY = r"(?i)^[\s(]*(?:none|nil|n/a|0|-)?[\s).]*$"
LOOK_BACK, LOOK_AHEAD = 14, 8  # lines between a result and a list of its own, if no prose stands there
PROSE = 40  # characters from which a line is prose rather than a disposition or a heading


def numbered_lines(meetings: DataFrame) -> DataFrame:
    """``meeting_id``, ``line_no``, ``start`` (offset in the text) and ``line`` of every line but page furniture."""
    rows = meetings.select("meeting_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n", -1)).alias("line_no", "line"))
    before = Window.partitionBy("meeting_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("start", F.coalesce(F.sum(F.length("line") + 1).over(before), F.lit(0)))
    return placed.where(~F.col("line").rlike(FURNITURE))


def verb_in(text: Column) -> Column:
    """The word that tells the result, of the first way of telling that fits; null if none does."""
    return F.when(text.rlike(TELLING), F.lower(F.coalesce(*[F.nullif(F.regexp_extract(text, p, 1), F.lit("")) for p in RESULTS])))


def side_of_heading(line: Column) -> Column:
    words = F.lower(F.regexp_replace(F.regexp_extract(line, HEADING, 1), r"\s+", " "))
    known = F.create_map(*[F.lit(x) for side, heads in SIDES.items() for h in heads for x in (h, side)])
    return F.try_element_at(known, words)


def last_before(mark: Column, w) -> Column:
    """Number of the last line before this one where ``mark`` holds."""
    return F.last(F.when(mark, F.col("line_no")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))


def read_lines(lines: DataFrame, starts: DataFrame) -> DataFrame:
    """What each line is: ``side`` of a heading, ``verb``, ``anchor``, ``rendering``, ``piece`` of a list, and the numbers of motion, list, section and item.

    A result that wraps is found on the line where it begins. A bare verb or a
    result box near a result with no list between tells the same one again; a bare
    verb after lists closes them. ``starts`` has ``meeting_id``, ``line_no`` and ``item_id`` where items begin.
    """
    w = Window.partitionBy("meeting_id").orderBy("line_no")
    up_to = w.rowsBetween(Window.unboundedPreceding, 0)
    after = w.rowsBetween(1, Window.unboundedFollowing)
    line, following = F.col("line"), F.coalesce(F.lead("line").over(w), F.lit(""))
    rows = lines.join(starts.select("meeting_id", "line_no", "item_id"), ["meeting_id", "line_no"], "left")
    rows = rows.withColumn("begins", F.col("item_id").isNotNull()).withColumn("item_id", F.last("item_id", ignorenulls=True).over(up_to)).withColumn("side", side_of_heading(line))
    rows = rows.withColumn("next", following).withColumn("own", verb_in(line)).withColumn("far", verb_in(F.concat_ws(" ", F.rtrim(line), F.ltrim(F.col("next")))))
    told = F.col("own").isNotNull() | (F.col("far").isNotNull() & verb_in(F.col("next")).isNull())
    rows = rows.withColumn("bare", line.rlike(BARE)).withColumn("box", line.rlike(RESULTS[0]))
    rows = rows.withColumn("told", told & F.col("side").isNull()).withColumn("head", F.col("side").isNotNull())
    rows = rows.withColumn("verb", F.when(F.col("bare"), F.lower(F.regexp_extract(line, BARE, 1))).when(F.col("told"), F.coalesce("far", "own")))
    result = F.col("told") | F.col("bare")
    rows = rows.withColumn("result_before", last_before(result, w)).withColumn("head_before", last_before(F.col("head"), w))
    gap = F.col("line_no") - F.col("result_before")
    clear = F.col("result_before").isNotNull() & (F.coalesce("head_before", F.lit(-1)) < F.col("result_before"))
    again = clear & ((F.col("bare") & (gap <= 4)) | (F.col("box") & (gap <= LOOK_BACK)))
    closes = F.col("bare") & F.col("head_before").isNotNull() & (F.col("line_no") - F.col("head_before") <= LOOK_AHEAD) & ~clear
    rows = rows.withColumn("rendering", F.coalesce(result & again, F.lit(False)))
    rows = rows.withColumn("anchor", F.coalesce((F.col("told") | closes) & ~F.col("rendering"), F.lit(False)))
    blank, label = F.trim(line) == "", line.rlike(LABEL)
    rows = rows.withColumn("stop", (blank | (label & ~F.col("head")) | result | F.col("begins")) & ~F.col("head"))
    rows = rows.withColumn("last_stop", F.last(F.when(F.col("stop"), F.col("line_no")), ignorenulls=True).over(up_to))
    rows = rows.withColumn("goes_on", ~F.col("head") & ~F.col("stop") & F.coalesce(F.col("head_before") > F.coalesce("last_stop", F.lit(-1)), F.lit(False)))
    words = ~F.col("head") & ~F.col("stop") & ~F.col("goes_on") & ((F.length(F.trim(line)) > PROSE) | F.rtrim(line).endswith("."))
    prose = words | (F.col("begins") & ~result)
    rows = rows.withColumn("prose", prose)
    broken = F.greatest(last_before(F.col("prose"), w), last_before(F.col("anchor"), w))
    opens = F.col("head") & (F.col("head_before").isNull() | F.coalesce(broken > F.col("head_before"), F.lit(False)))
    rows = rows.withColumn("opens", opens).withColumn("prose_before", last_before(F.col("prose"), w)).withColumn("anchor_before", last_before(F.col("anchor"), w))
    rows = rows.withColumn("anchor_after", F.first(F.when(F.col("anchor"), F.col("line_no")), ignorenulls=True).over(after))
    rows = rows.withColumn("prose_after", F.first(F.when(F.col("prose"), F.col("line_no")), ignorenulls=True).over(after))
    count = lambda mark: F.sum(F.col(mark).cast("int")).over(up_to)
    rows = rows.withColumn("motion", count("anchor")).withColumn("list", count("opens")).withColumn("section", count("head"))
    piece = F.when(F.col("head"), F.regexp_replace(line, HEADING, "")).when(F.col("goes_on"), line)
    here = F.struct("line_no", "line", "head")
    near = [F.lag(here, k).over(w) for k in range(6, 0, -1)] + [here] + [F.lead(here, k).over(w) for k in range(1, 4)]
    rows = rows.withColumn("piece", F.trim(piece)).withColumns({f"__near_{i}": x for i, x in enumerate(near)})
    names = [f"__near_{i}" for i in range(len(near))]
    return rows.withColumn("around", F.when(F.col("anchor"), F.filter(F.array(*names), lambda x: x.isNotNull()))).drop(*names)


def telling(rows: DataFrame) -> DataFrame:
    """Rows of :func:`read_lines` and columns of them that claims are made of; the line itself stays only where a result is."""
    at_result = [F.when(F.col("anchor"), F.col(c)).alias(c) for c in ("line", "next")]
    kept = ["meeting_id", "line_no", "start", "item_id", "side", "head", "verb", "bare", "anchor", "rendering", "motion", "list", "section", "piece", "around"]
    marks = ["head_before", "anchor_before", "prose_before", "anchor_after", "prose_after"]
    return rows.where("anchor OR rendering OR head OR piece IS NOT NULL").select(*kept, *marks, *at_result)


def lists_of(rows: DataFrame) -> DataFrame:
    """Motion of each list: the result before it, else the one after it, if no prose stands between."""
    ends = rows.where("head").groupBy("meeting_id", "list").agg(
        F.min(F.struct("line_no", "motion", "anchor_before", "prose_before")).alias("a"), F.max(F.struct("line_no", "anchor_after", "prose_after")).alias("z")
    )
    first_of = F.row_number().over(Window.partitionBy("meeting_id", "a.motion").orderBy("list")) == 1
    back = first_of & (F.col("a.line_no") - F.col("a.anchor_before") <= LOOK_BACK) & (F.coalesce("a.prose_before", F.lit(-1)) < F.col("a.anchor_before"))
    ahead = (F.col("z.anchor_after") - F.col("z.line_no") <= LOOK_AHEAD) & (F.coalesce("z.prose_after", F.lit(1 << 30)) > F.col("z.anchor_after"))
    motion = F.when(back, F.col("a.motion")).when(ahead, F.col("a.motion") + 1)
    return ends.select("meeting_id", "list", motion.alias("motion")).where("motion is not null")


def sections_of(rows: DataFrame) -> DataFrame:
    """Sections of all motions: ``side``, ``stated`` count and ``names``. Wrapped lists are joined; counts stand before or after the names."""
    parts = rows.where("piece is not null").groupBy("meeting_id", "section").agg(
        F.min("list").alias("list"), F.min_by("side", "line_no").alias("side"), F.array_sort(F.collect_list(F.struct("line_no", "piece"))).alias("parts")
    )
    blob = F.trim(F.array_join(F.col("parts.piece"), " "))
    leading = F.nullif(F.regexp_extract(blob, r"^(\d{1,2})\s*(?:[-–]|$)", 1), F.lit(""))
    trailing = F.nullif(F.regexp_extract(blob, r"\((\d{1,2})\)\s*\.?\s*$", 1), F.lit(""))
    names = F.regexp_replace(F.regexp_replace(blob, r"^\d{1,2}\s*(?:[-–]\s*|$)", ""), r"\s*(?:[-–]\s*)?(?:\p{L}+\s*)?\(\d{1,2}\)\s*\.?\s*$", "")
    # A number word before a count in parentheses follows a dash; a name does not.
    kept = F.when(blob.rlike(r"[-–]\s*\p{L}+\s*\(\d{1,2}\)\s*\.?\s*$"), names).otherwise(F.regexp_replace(F.regexp_replace(blob, r"^\d{1,2}\s*(?:[-–]\s*|$)", ""), r"\s*\(\d{1,2}\)\s*\.?\s*$", ""))
    nobody = kept.rlike(NOBODY)
    out = parts.select("meeting_id", "section", "list", "side", F.coalesce(leading, trailing).cast("int").alias("printed"), kept.alias("kept"), nobody.alias("nobody"))
    listed = F.when(F.col("nobody"), F.array().cast("array<string>")).otherwise(split_names("kept"))
    out = out.withColumn("names", listed).withColumn("stated", F.when(F.col("nobody"), F.coalesce("printed", F.lit(0))).otherwise(F.col("printed")))
    return out.drop("kept", "nobody", "printed")


def motions_of(rows: DataFrame) -> DataFrame:
    """Results with place, item, outcomes told, printed tally, movers, unanimity and whether they are procedural."""
    spot = rows.where("anchor")
    # A bare verb that closes lists has them between the motion's sentence and itself.
    since = F.when(F.col("bare"), F.coalesce("anchor_before", F.lit(-1))).otherwise(F.coalesce(F.greatest("anchor_before", "head_before"), F.lit(-1)))
    near = F.filter("around", lambda x: ~x["head"] & (x["line_no"] > since) & ((x["line_no"] <= F.col("line_no") + 1) | x["line"].rlike(r"(?i)^\s*(?:mover|seconder|moved by|seconded by)\s*:")))
    told_next = verb_in(F.col("next")).isNotNull() | side_of_heading(F.col("next")).isNotNull()
    here = F.concat_ws(" ", F.rtrim("line"), F.when(~told_next, F.ltrim("next")))
    digits = [F.nullif(F.regexp_extract(here, BEFORE_TALLY, g), F.lit("")) for g in range(1, 6)]
    dated = (digits[1] == "/") & F.coalesce(digits[3] == "/", F.lit(False))
    out = spot.withColumn("context", F.array_join(F.transform(near, lambda x: F.trim(x["line"])), "\n"))
    flat = F.regexp_replace("context", r"\s*\n\s*(?!(?i:mover|seconder)\s*:)", " ")
    out = out.withColumn("context", flat)

    def last_name(patterns: list[str]) -> Column:
        found = [F.regexp_extract_all("context", F.lit(("(?m)" if "^" in p else "") + p), F.lit(1)) for p in patterns]
        return F.coalesce(*[F.element_at(F.when(F.size(x) > 0, x), -1) for x in found])

    whole = lambda i: F.when(~F.coalesce(dated, F.lit(False)), digits[i]).cast("int")
    return out.select(
        "meeting_id", "motion", "item_id", "line_no", "start", (F.col("start") + F.length("line")).alias("end"), "verb",
        whole(0).alias("yes"), whole(2).alias("no"), whole(4).alias("other"), last_name(MOVERS).alias("mover"), last_name(SECONDERS).alias("seconder"),
        here.rlike(r"(?i)\bunanimous").alias("unanimous"), F.col("context").rlike(PROCEDURAL).alias("procedural"),
    )


def roster_keys(roster: DataFrame) -> DataFrame:
    """``meeting_id``, ``key`` and ``member`` of every way to name a member; ``member`` is null where a key fits several.

    Keys: the whole name, the last word, the last two, and initial with last word.
    Rows of a meeting with one whole name are one member, the smallest.
    """
    words = F.split(F.trim(F.regexp_replace(fold(clean_name("name")), r"[.\s]+", " ")), " ", -1)
    named = roster.select("meeting_id", "member", words.alias("w")).groupBy("meeting_id", "w").agg(F.min("member").alias("member")).where(F.array_join("w", "") != "")
    last = F.element_at("w", -1)
    keys = F.array(F.array_join("w", " "), last, F.array_join(F.slice("w", F.greatest(F.size("w") - 1, F.lit(1)), 2), " "), F.concat(F.substring(F.element_at("w", 1), 1, 1), F.lit(" "), last))
    spread = named.select("meeting_id", "member", F.explode(F.array_distinct(keys)).alias("key"))
    one = spread.groupBy("meeting_id", "key").agg(F.min("member").alias("low"), F.max("member").alias("high"))
    return one.select("meeting_id", "key", F.when(F.col("low") == F.col("high"), F.col("low")).alias("member"))


def resolved(names: DataFrame, keys: DataFrame) -> DataFrame:
    """``names`` (with ``meeting_id`` and ``raw``) with ``member`` and ``known``: whether the roster has the name at all."""
    key = F.trim(F.regexp_replace(fold("raw"), r"[.\s]+", " "))
    mine = names.withColumn("key", key)
    tagged = keys.withColumn("known", F.lit(True))
    return mine.join(tagged, ["meeting_id", "key"], "left").withColumn("known", F.coalesce("known", F.lit(False))).drop("key")


def claims(meetings: DataFrame, starts: DataFrame, roster: DataFrame) -> DataFrame:
    """Claims of minutes: ``meeting_id``, ``item_id``, ``motion`` (from 1 in a meeting), ``claim``, ``value``, ``member``, ``raw``, ``start``, ``end``, ``withheld``.

    ``meetings`` has ``meeting_id`` and ``text``, ``starts`` the lines where items begin (:func:`read_lines`), ``roster`` ``meeting_id``, ``member`` (string) and ``name``.
    Claims are ``outcome`` (passed, failed), ``tally`` (yes-no or yes-no-other), ``vote`` (a member's side), ``mover`` and ``seconder``.
    A claim that nothing speaks against has a null ``withheld``; else it holds the first reason of:
    ``no_item``, ``procedural`` (all claims of the motion); ``not_stated``, ``renderings_disagree`` (outcome);
    ``all_zero``, ``tally_contradicts_lists`` (tally, and with it the votes); ``count_contradicts_names`` (votes of that list);
    ``ambiguous_member``, ``unknown_member``, ``listed_twice`` (a vote, mover or seconder). A meeting without results or with a null text has no claims.
    ``start`` and ``end`` are the result line's offsets in the text.
    """
    rows = telling(read_lines(numbered_lines(meetings), starts)).persist()
    motions = motions_of(rows)
    failed = F.col("verb").isin(FAILED)
    told = rows.where("anchor or rendering").where("verb <> 'vote'").groupBy("meeting_id", "motion").agg(F.min(failed.cast("int")).alias("low"), F.max(failed.cast("int")).alias("high"))
    sections = sections_of(rows).join(lists_of(rows), ["meeting_id", "list"])
    sections = sections.withColumn("size", F.size("names")).withColumn("count", F.coalesce("stated", "size"))
    sections = sections.withColumn("uneven", F.coalesce((F.col("stated") != F.col("size")) & (F.col("size") > 0), F.lit(False)))
    side = lambda s: F.sum(F.when(F.col("side") == s, F.col("count")))
    sums = sections.groupBy("meeting_id", "motion").agg(F.coalesce(side("yes"), F.lit(0)).alias("yes_listed"), F.coalesce(side("no"), F.lit(0)).alias("no_listed"), F.bool_or("uneven").alias("uneven_lists"), F.lit(True).alias("listed"))
    base = motions.join(told, ["meeting_id", "motion"], "left").join(sums, ["meeting_id", "motion"], "left")
    printed = F.col("yes").isNotNull()
    base = base.withColumn("clash", F.coalesce(printed & F.col("listed") & ((F.col("yes") != F.col("yes_listed")) | (F.col("no") != F.col("no_listed"))), F.lit(False)))
    base = base.withColumn("whole", F.when(F.col("item_id").isNull(), "no_item").when(F.col("procedural"), "procedural"))
    place = ["meeting_id", "item_id", "motion", "start", "end"]
    nothing = F.lit(None).cast("string")

    def said(df: DataFrame, claim: str, value: Column, why: Column, member: Column = nothing, raw: Column = nothing) -> DataFrame:
        return df.select(*place, F.lit(claim).alias("claim"), value.alias("value"), member.alias("member"), raw.alias("raw"), F.coalesce("whole", why).alias("withheld"))

    outcome = F.when(F.col("low") == 1, "failed").when(F.col("high") == 0, "passed")
    parts = [said(base, "outcome", outcome, F.when(F.col("low").isNull(), "not_stated").when(F.col("low") != F.col("high"), "renderings_disagree"))]
    yes, no = F.coalesce("yes", "yes_listed"), F.coalesce("no", "no_listed")
    tally = F.concat_ws("-", yes.cast("string"), no.cast("string"), F.col("other").cast("string"))
    counted = base.where(printed | (F.col("listed") & ~F.col("uneven_lists")))
    parts.append(said(counted, "tally", tally, F.when((yes == 0) & (no == 0), "all_zero").when(F.col("clash"), "tally_contradicts_lists")))
    keys = roster_keys(roster)
    votes = sections.select("meeting_id", "motion", "side", "uneven", F.explode("names").alias("raw"))
    named = resolved(votes, keys)
    whose = F.coalesce(F.concat(F.lit("="), F.col("member")), F.col("raw"))
    twice = F.count(F.lit(1)).over(Window.partitionBy("meeting_id", "motion", whose)) > 1
    unknown = F.when(~F.col("known"), "unknown_member").when(F.col("member").isNull(), "ambiguous_member")
    named = named.withColumn("twice", twice).join(base.select(*place, "whole", "clash"), ["meeting_id", "motion"])
    why = F.when(F.col("clash"), "tally_contradicts_lists").when(F.col("uneven"), "count_contradicts_names").otherwise(F.coalesce(unknown, F.when(F.col("twice"), "listed_twice")))
    parts.append(said(named, "vote", F.col("side"), why, F.col("member"), F.col("raw")))
    for role in ("mover", "seconder"):
        who = resolved(base.where(F.col(role).isNotNull()).withColumn("raw", clean_name(role)).where("raw is not null"), keys)
        parts.append(said(who, role, nothing, unknown, F.col("member"), F.col("raw")))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
