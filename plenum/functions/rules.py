"""First-match rule tables compiled to one expression."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

ITEM_VERSION = "ifv2"
ATTACHMENT_VERSION = "afv1"

# Filter patterns by family, tried in this order, case-insensitive.
PROCEDURAL = [
    r"roll call",
    r"invocation",
    r"pledge of allegiance",
    r"flag salute",
    r"approval of\s+(?:the\s+|draft\s+)?(?:meeting\s+)?(?:minutes|agenda)\b",
    r"^approval of.{0,80}\bminutes\b",
    r"\bapprove\s+(?:the\s+|draft\s+)?(?:meeting\s+)?minutes\b",
    r"adopt minutes",
    r"review of minutes",
    r"^minutes of",
    r"draft.*minutes",
    r"adjourn",
    r"call to order",
    r"\brecess\b",
    r"moment of silence",
    r"public comment",
    r"^to\s+speak\s+on\s+an\s+agenda\s+item,?\s+please\s+approach\s+the\s+podium\b",
    r"^if\s+your\s+issue\s+is\s+not\s+a\s+topic\s+on\s+the\s+agenda,?\s+please\s+approach\s+the\s+podium\b",
    r"^if\s+you\s+require\s+accommodations?\s+for\s+this\s+meeting\b",
    r"^communications?\s*$",
    r"^public communications?\s*$",
    r"communications? from\s+the\s+public",
    r"time fixed for next",
    r"identify items (to|for)",
    r"meeting schedule for",
    r"^approve bills\.?\s*$",
    r"^ratify\b.*\b(disburse|payment|warrant)",
    r"^(authorize|authorization)\s+(?:advertising|advertisement)\s+for\s+(bids?|proposals)",
]
CEREMONIAL = [
    r"\bproclamations?(?!.{0,30}\b(emergency|disaster|local emergency|state of emergency))",
    r"\bcommendation\b",
    r"\brecognition\b",
    r"\bceremonial\b",
    r"\bbenediction\b",
    r"\boath of office\b",
    r"\bswearing[ -]in\b",
    r"\bin memoriam\b",
    r"\bopening remarks?\b",
    r"\b(?:employee|officer|firefighter|teacher) of the (?:month|quarter|year)\b",
    r"(?i)congratulations (to|extended to|for)",
    r"(?i)tribute to (late|the late)",
    r"(?i)\bon (his|her|their) retirement\b",
    r"(?i)retirement of",
    r"(?i)happy birthday",
    r"(?i)birthday (wishes|greetings|recognition|celebration)",
]
ADMINISTRATIVE = [
    r"\bappointment\b",
    r"\bconfirmation of\b.*\b(appointment|appointee|nominee|hiring|director|chief|officer|commissioner)",
    r"(?i)liquor license",
    r"(?i)beer (and|&) wine license",
    r"(?i)alcoholic beverage license",
    r"issuance of permits? for sign",
    r"signboard permit",
    r"fee waiver for",
    r"(various )?small claims?",
]
PUBLIC_COMMENT = [
    r"public comment",
    r"public correspondence",
    r"comment letter",
    r"comment ltrs",
    r"written comment",
    r"public hearing comment",
    r"citizen comment",
    r"correspondence received",
    r"public input",
    r"public testimony",
    r"letters received",
    r"petitions",
    r"pub corr",
    r"pulbic corr",
    r"comm pkt",
    r"cmte pkt",
    r"committee packet",
    r"board pkt",
    r"co-?sponsor(ship)?\s*(request|ltr|letter)",
    r"sponsor(ship)?\s*request",
    r"communications?\s+from\s+public",
    r"community impact statement",
    r"speaker card",
]
PARCEL_TABLES = [
    r"parcel table",
    r"parcel list",
    r"parcel map",
    r"tax parcel",
    r"property list",
    r"property table",
    r"assessor(?:.s)?\s+(?:parcel\s+)?(?:table|list|report|roll|data)",
    r"apn list",
    r"parcel number",
]
BOILERPLATE = [
    r"omnia partners contract",
    r"sourcewell contract",
    r"naspo valuepoint",
    r"u\.?s\.? communities",
    r"hgac.?buy",
    r"master agreement",
    r"terms and conditions",
    r"general conditions",
    r"insurance certificate",
    r"certificate of insurance",
    r"w-?9",
    r"bid tabulation",
    r"^budget transfer form$",
    r"^director'?s?\s+form$",
]
ROUTING = [
    r"ceqa det",
    r"ceqa determination",
    r"referral ceqa",
    r"referral fyi",
    r"myr memo",
    r"mayor.?s? memo",
    r"comm rpt rqst",
    r"committee report request",
    r"referral.*pc\b",
    r"hearing notice",
    r"notice of (?:public )?hearing",
]
ENVIRONMENTAL = [
    r"\bfeir\b",
    r"\bdeir\b",
    r"\bseir\b",
    r"\beir\b",
    r"environmental impact report",
    r"ceqa findings",
    r"initial study",
    r"negative declaration",
    r"notice of preparation",
]
MEETING_SKIP = [r"\bmock\b", r"\btest\b", r"\bdemo\b", r"\btraining\b", r"\bpractice\b"]
MATTER_TYPES_SKIP = ["Minutes (Min)", "Introduction & Referral Calendar (IRC)", "Information Item (Inf)", "Information Item", "Information Only", "Minutes", "Min", "IRC", "Referral Calendar"]
# Kinds of titles that are no titles, tried in this order.
GARBAGE_TITLES = [
    ("filename", r"(?i)\.(pdf|docx?|pptx?|xlsx?)\s*$"),
    ("cover_page", r"(?i)^[-–\s]*cover\s*page\s*$"),
    ("generic_label", r"(?i)^[-–\s]*(agenda|attachment|staff\s*report|item|memo(randum)?|exhibit)\s*$"),
    ("numeric_or_date", r"^[\d\s.,()$/:–-]+$"),
    ("register_code", r"(?i)^[A-Z]\d{5,}\s+\d+$"),
    ("empty_or_tiny", r"^.{0,2}$"),
]

ITEM_FAMILIES = [("procedural", PROCEDURAL), ("ceremonial", CEREMONIAL), ("administrative", ADMINISTRATIVE)]
ATTACHMENT_FAMILIES = [("public_comment", PUBLIC_COMMENT), ("parcel_table", PARCEL_TABLES), ("boilerplate", BOILERPLATE), ("procedural", ROUTING), ("environmental", ENVIRONMENTAL)]


def rule_id(namespace: str, pattern: str) -> str:
    """Stable id of a rule: its namespace and the start of its pattern's hash."""
    return f"{namespace}:{hashlib.sha256(pattern.encode()).hexdigest()[:16]}"


@dataclass(frozen=True)
class Rule:
    reason: str
    pattern: str
    rule_id: str


def rule_list(families: list[tuple[str, list[str]]]) -> list[Rule]:
    return [Rule(reason, pattern, rule_id(reason, pattern)) for reason, patterns in families for pattern in patterns]


def first_match(value: Column, families: list[tuple[str, list[str]]], version: str) -> Column:
    """Reason, rule id and version of the first rule that ``value`` matches; null if none.

    Rules are known when the plan is made, so the table becomes one coalesce of
    regex tests inside code generation, with nothing to join.
    """
    tests = [F.when(value.rlike("(?i)" + r.pattern), F.struct(F.lit(r.reason).alias("reason"), F.lit(r.rule_id).alias("rule_id"), F.lit(version).alias("version"))) for r in rule_list(families)]
    return F.coalesce(*tests)


def any_match(value: Column, patterns: list[str]) -> Column:
    """True if any pattern is found in ``value``; false for null."""
    return F.coalesce(value.rlike("(?i)" + "|".join(f"(?:{p})" for p in patterns)), F.lit(False))


def item_filter(title: Column, kind: Column | None = None) -> Column:
    """Filter decision of an agenda item; its type is looked at with its title."""
    text = title if kind is None else F.concat_ws(" ", title, kind)
    return first_match(text, ITEM_FAMILIES, ITEM_VERSION)


def attachment_filter(name: Column) -> Column:
    return first_match(name, ATTACHMENT_FAMILIES, ATTACHMENT_VERSION)


def skip_meeting(title: Column) -> Column:
    return any_match(title, MEETING_SKIP)


def skip_matter_type(kind: Column) -> Column:
    """True if the type holds one of the skipped types; an empty type never does."""
    low = F.lower(kind)
    hits = F.lit(False)
    for name in MATTER_TYPES_SKIP:
        hits = hits | low.contains(name.lower())
    return F.when(F.length(F.trim(kind)) > 0, hits).otherwise(F.lit(False))


def garbage_title(title: Column) -> Column:
    """Label of the first kind of non-title that matches, null for a real title."""
    text = F.trim(F.coalesce(title, F.lit("")))
    return F.coalesce(*[F.when(text.rlike(p), F.lit(label)) for label, p in GARBAGE_TITLES])
