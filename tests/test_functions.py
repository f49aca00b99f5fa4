"""Scalar functions on literal cases of our own."""

import datetime
import hashlib
import random

import pytest
from pyspark.sql import functions as F

from plenum.functions import dates, identifiers, identity, rules, text
from plenum.operators import documents, minutes, series, shapes


def one(spark, column, **values):
    schema = ", ".join(f"{k} {v[1]}" for k, v in values.items()) or "x int"
    row = tuple(v[0] for v in values.values()) or (1,)
    return spark.createDataFrame([row], schema).select(column.alias("r")).first()["r"]


def s(value):
    return F.lit(value).cast("string")


@pytest.mark.parametrize(
    "title,reason",
    [("Roll Call", "procedural"), ("APPROVAL OF THE MINUTES", "procedural"), ("Proclamation for Arbor Day", "ceremonial"), ("Proclamation of a local emergency", None), ("Appointment of the clerk", "administrative"), ("Recession report", None), ("Telecommunications Agreement", None), (None, None), ("", None)],
)
def test_item_filter(spark, title, reason):
    got = one(spark, rules.item_filter(s(title)))
    assert (got and got["reason"]) == reason
    if got:
        assert got["version"] == "ifv2" and got["rule_id"].startswith(reason + ":") and len(got["rule_id"].split(":")[1]) == 16


def test_other_rules(spark):
    assert one(spark, rules.attachment_filter(s("Tax Parcel list.pdf")))["reason"] == "parcel_table"
    assert one(spark, rules.skip_meeting(s("Mock Hearing"))) is True and one(spark, rules.skip_meeting(s(None))) is False
    assert one(spark, rules.skip_matter_type(s("minutes (Min)"))) is True and one(spark, rules.skip_matter_type(s(""))) is False
    assert [one(spark, rules.garbage_title(s(t))) for t in ("- Staff Report", "12/31/2024", "R12345 7", "a", None, "Budget hearing")] == ["generic_label", "numeric_or_date", "register_code", "empty_or_tiny", "empty_or_tiny", None]


def test_identities(spark):
    digest = lambda k, n=16: hashlib.sha256(k.encode()).hexdigest()[:n]
    assert one(spark, identity.matter_id(s("xCA"), s("BL-1"), s("v"), s("t"))) == "xCA_" + digest("xCA:file:BL-1")
    assert one(spark, identity.matter_id(s("xCA"), s("66"), s("v"), s("t"), s("2024"))) == "xCA_" + digest("xCA:file:66:year:2024")
    assert one(spark, identity.matter_id(s("xCA"), s(None), s("v9"), s("t"), s("2024"))) == "xCA_" + digest("xCA:id:v9")
    title = "FIRST READING:  An Ordinance to adopt the annual budget of the city"
    assert one(spark, identity.matter_id(s("xCA"), s(""), s(None), s(title))) == "xCA_" + digest("xCA:title:an ordinance to adopt the annual budget of the city")
    assert one(spark, identity.matter_id(s("xCA"), s(None), s(None), s("Public Comment"))) is None
    when = F.lit(datetime.datetime(2025, 1, 15, 10, 0))
    assert one(spark, identity.meeting_id(s("xCA"), s("12"), when, s("Council"))) == "xCA_" + hashlib.md5(b"xCA:12:20250115T100000:Council").hexdigest()[:8]
    assert one(spark, identity.meeting_id(s("xCA"), s("12"), F.lit(None).cast("timestamp"), s("Council"))) == "xCA_" + hashlib.md5(b"xCA:12:undated:Council").hexdigest()[:8]
    assert one(spark, identity.item_id(s("m"), F.lit(3), s(" A b "))) == "m_ab" and one(spark, identity.item_id(s("m"), F.lit(3), s(None))) == "m_seq003_" + digest("m:seq:3", 8)
    assert one(spark, identity.member_id(s("x"), s(" Ann  LEE "))) == "x_cm_" + digest("x:council_member:ann lee")
    assert one(spark, identity.is_matter_id(s("x_" + "0" * 16))) and not one(spark, identity.is_matter_id(s(None)))
    assert one(spark, identity.attachment_identity(s("http://h/a.pdf?X-Amz-Signature=1&b=2"))) == "http://h/a.pdf" and one(spark, identity.attachment_identity(s("http://h/a?id=2"))) == "http://h/a?id=2"
    files = "array<struct<name:string,url:string>>"
    a, b = [("n", "http://h/1"), ("m", "http://h/2?sig=9")], [("m", "http://h/2?sig=7"), ("n", "http://h/1")]
    assert one(spark, identity.attachment_set_hash(F.col("f")), f=(a, files)) == one(spark, identity.attachment_set_hash(F.col("f")), f=(b, files))
    assert one(spark, identity.attachment_set_hash(F.col("f")), f=([], files)) is None


def test_text(spark):
    assert [one(spark, text.vote_value(s(v))) for v in ("AYE ", "nay", "not present", "maybe", " ", None)] == ["yes", "no", "absent", "not_voting", None, None]
    assert one(spark, text.fold(s("Núñez"))) == "nunez"
    assert text.people("Mayor Ann Lee, Dr. Bo Kay Jr.; Council Member Cy Dee and Ed Eff & Gil") == ["Ann Lee", "Bo Kay", "Cy Dee", "Ed Eff", "Gil"]
    assert [one(spark, text.looks_like_name(s(n))) for n in ("Ann Lee", "ann lee", "Room 7", "A B C D E", None)] == [True, False, False, False, False]
    assert one(spark, text.garbled(s("§±¶ " * 100 + "éß"))) in (True, False) and not one(spark, text.garbled(s("plain words " * 50)))
    assert one(spark, text.garbled(s("\x85" * 10 + "ordinary text " * 40)))
    assert one(spark, text.padded_layout(s(" " * 3000 + "x"))) and not one(spark, text.padded_layout(s(None)))
    assert [one(spark, text.summary_quality(s(x)))["quality"] for x in (None, "", "failed to process", "short", "x" * 120 + "...", "x" * 120, "## A\n" + "x" * 120)] == ["empty", "empty", "error", "too_short", "truncated", "suspicious", "good"]
    assert one(spark, text.strip_markdown(s("# T\n**b** *i* `c` [l](u)"))) == "T\nb i c l"
    snippet = one(spark, text.context(s("word " * 100 + "Needle " + "tail " * 100), "needle", 60))
    assert "Needle" in snippet and snippet.startswith("...") and snippet.endswith("...") and one(spark, text.context(s("abc"), "zzz")) is None
    assert one(spark, text.summary_section(s("## Thinking\nx\n## Summary\nThe body\n## More\ny"))) == "The body"
    assert one(spark, text.title_from_filename(s("2026-412 Agenda Item - Water Shortage Update 2026-0615.pdf"))) == "Water Shortage Update"
    assert one(spark, text.subject_line(s("City of X\nSUBJECT:\n Award of the paving contract\n"))) == "Award of the paving contract"
    got = one(spark, text.contacts(s("Mail Clerk@City.gov or clerk@city.gov, call (555) 123-4567 or 555-123-4567, see https://zoom.us/j/1")))
    assert (got["emails"], got["phones"], got["streams"]) == (["clerk@city.gov"], ["+15551234567"], ["https://zoom.us/j/1"])
    assert tuple(one(spark, text.city_state(s("Palo Alto, ca")))) == ("Palo Alto", "CA") and one(spark, text.city_state(s("Boston")))["state"] is None
    assert one(spark, text.base36(F.lit(123456))) == text.digits36(123456) == "2n9c"
    assert text.run_lengths("a a a a b b") == "a*4 b b"
    assert "@0=" in text.dictionary_text("\n".join(["a long repeated line of text"] * 5)) and text.dictionary_text("a\na") == "a\na"
    assert one(spark, text.attachment_kind(s("http://h/x.PDF"), s(None))) == "pdf" and one(spark, text.looks_like_minutes(s("Final Minutes")))


def test_identifier_forms():
    f = identifiers.find_identifier
    assert f("Resolution No. 2026-081 authorizing a grant").file == "Resolution 2026-081"
    assert f("Council Bill No. 11-26, an ordinance").file == "Bill 11-26" and f("Board Bill 108 Plan").file == "Bill 108"
    assert f("Report, per CA Assembly Bill No. 482") is None and f("Resolution No. _____ amending Resolution No. 1805 to lease") is None
    assert f("Ordinance No. 2026") is None and f("Concepts", "x" * 400 + " required by Ordinance No. 1188.") is None
    assert f("Resolution No. 2026-15 approving Contract No. 12346 with A").file == "Contract 12346"
    assert f("Bill No. 65, 2024 on parks") == identifiers.Identifier("Bill 65", "Bill", "2024")
    assert f("Lease", "adopt Ordinance No. 7,892-N.S. authorizing").file == "Ordinance 7,892-N.S"
    assert f("25-0584 Street vacation").file == "25-0584" and f("2026-0615 Meeting notes") is None and f("Rezoning (ZON-1234)").file == "ZON-1234"
    assert f(None) is None and f("", "") is None


def test_identifiers_as_printed():
    """Printed examples: what is the item's own number, what is cited, unassigned or a date."""
    f = lambda *x: (identifiers.find_identifier(*x) or identifiers.Identifier(None)).file
    own = {
        "Ordinance No. 2026-77 - Introduced by Council": "Ordinance 2026-77", "Council Bill 2026-138 (Horton)": "Bill 2026-138",
        "CASE FILE NO. 2026-08-V": "File 2026-08-V", "CASE FILE NO. 2025-91-P(ETJ)": "File 2025-91-P", "File No. 15121 workers comp": "File 15121",
        "2026-470 Advisory Boards and Committee Reports": "2026-470", "22-1201-S50CD 13Motion relative to the reappointment": "22-1201-S50",
        "(PC-11016) Application by a church to rezone": "PC-11016", "ZON-26-05-0015 - Zoning Change/Concept Plan": "ZON-26-05-0015",
        "CU-26-013 Conditional use permit for 12 Main St": "CU-26-013", "O-080-26 AN ORDINANCE AMENDING ORDINANCE NO. 103, SERIES 2016": "O-080-26",
        "Adoption of Resolution No. 2026-15 approving the budget": "Resolution 2026-15", "Second Reading of Ordinance No. 1763, Land Development Code": "Ordinance 1763",
        "Consideration of Resolution Number 2026 - 060 related to Horizon": "Resolution 2026-060", "Resolution No. 2026-16APPROVING a plat": "Resolution 2026-16",
        "Settlement L24-1234 of a claim": "File L24-1234", "Master Contract No. 55555 and Contract No. 66666": "Contract 66666",
    }
    assert {k: f(k) for k in own} == own
    nothing = [
        "2026-05-20 Architectural Review Board Meeting Minutes", "2027-28 Urban Forestry Work Plan", "2026-2027 Operating Budget", "2026-0615 Review", "Approval of minutes 03-25",
        "CC-06-15 Committee report on parks", "Item III.A - R-26-XXX- A RESOLUTION AUTHORIZING THE MANAGER", "Item III.B - Ordinance_No._26-_Ambulance_Charges.docx",
        "A) Consideration of adopting Ordinance #O-26-___ increasing the rates", "Adopt Resolution No. 2026-XXX approving", "Adopt Resolution No. 2026-0XX approving", "Adopt Resolution No. XX-2026 approving",
        "devices shall be on mute pursuant to District Ordinance No. 13.", "in accordance with Policy Resolution No. 11 (R2016-6).", "Annual Report in compliance with Ordinance #1869.",
        "An ordinance to install speed humps pursuant to Ordinance Number 70334", "Repealing Ordinance No. 51 and Ordinance No. 52",
    ]
    assert {k: f(k) for k in nothing} == dict.fromkeys(nothing)
    assert f("IH Borrower LP", "Section 2 (Zoning permit), from Ordinance no. 2927 of the City") is None


def test_file_names(spark):
    names = {
        "Staff_Report_Park_Plan_final_(2).docx": "Staff Report Park Plan", "Budget Hearing Notice 06-15-2026.pdf": "Budget Hearing Notice", "Lease Agreement-draft-v3.DOC": "Lease Agreement",
        "20260615.pdf": None, "agenda item: Sewer Rates 20260615": "Sewer Rates", "Water-Rate Study.xlsx": "Water-Rate Study", None: None,
    }
    assert {k: one(spark, text.title_from_filename(s(k))) for k in names} == names


def test_files_and_periods(spark):
    assert [one(spark, identifiers.canonical_file(s(v))) for v in (" BL  25 ", "-----", "2026-XX", "Recommendation into Closure at 5", None)] == ["BL 25", None, None, None, None]
    day = datetime.date(2026, 6, 1)
    starts = [datetime.date(2026, 1, 5), datetime.date(2025, 1, 4)]
    period = lambda file, year, high, sibling: one(spark, identifiers.numbering_period(s(file), s(year), F.lit(day), F.col("starts"), F.lit(high).cast("int"), s(sibling)), starts=(starts, "array<date>"))
    assert [period("Bill 5", None, 40, None), period("Bill 60", None, 40, None), period("Bill 5", "2019", 40, None), period("Bill 5", None, 40, "2020"), period("Bill 2026-5", None, 40, None)] == ["2026", "2025", "2019", "2020", None]


def test_numbering_runs(spark):
    day = datetime.date(2024, 1, 1)
    step = datetime.timedelta(days=3)
    rows = [("a", day + step * i, i + 1) for i in range(80)] + [("a", day + step * (80 + i), i + 1) for i in range(30)] + [("b", day + step * i, i + 1) for i in range(50)]
    from pyspark.sql.types import DateType, IntegerType, LongType, StructField, StructType

    shape = StructType([StructField("series", LongType()), StructField("day", DateType()), StructField("number", IntegerType())])
    got = series.numbering_runs(spark.createDataFrame([(ord(k), d, n) for k, d, n in rows], shape)).collect()
    assert [(r["series"], r["start"]) for r in got] == [(ord("a"), day + step * 80)]


def test_dates(spark):
    assert one(spark, dates.title_date(s("Council - Sep 30, 2026"))) == datetime.date(2026, 9, 30) and one(spark, dates.title_date(s("none"))) is None
    for clock, hour in (("6:30 PM", 18), ("06:30", 6), ("7pm", 19), ("soon", 0)):
        assert one(spark, dates.combined(s("3/4/2025"), s(clock))).hour == hour
    assert one(spark, dates.combined(s("n/a"), s("7pm"))) is None
    assert one(spark, dates.percentage(F.lit(1), F.lit(3))) == 33.3 and one(spark, dates.percentage(F.lit(1), F.lit(0))) == 0


def test_documents(spark):
    html = "<html><head><title>T</title><style>x</style></head><body><nav>menu</nav><p>A</p><p>A</p><div hidden>no</div><p>B &amp; C</p><a href='/f.pdf'>f</a></body></html>"
    assert documents.visible_text(html) == "T\nA\nB & C\nf" and documents.visible_text(None) is None
    assert one(spark, documents.document_links(s('<a href="/x.pdf"> <a class=q href="/about">'))) == ["/x.pdf"]
    assert [one(spark, documents.sniff_format(F.lit(b).cast("binary"))) for b in (bytearray(b"%PDF-1.7"), bytearray(b"PK\x03\x04..word/doc"), bytearray(b"<html>"), bytearray(b"??"))] == ["pdf", "docx", "html", "unknown"]
    agenda = "CITY\n1. Call to order\n2. Budget hearing\nstaff memo\n3.\nLand use plan\n"
    assert [(i["number"], i["title"]) for i in documents.agenda_items(agenda)] == [("1", "Call to order"), ("2", "Budget hearing"), ("3", "Land use plan")]
    assert documents.agenda_items("1. only one here") == []
    got = documents.cascade("text", {"a": lambda t: 1 / 0, "b": lambda t: [], "c": lambda t: [{"title": "x"}]}, ["a", "b", "c"], hint="b")
    assert got["rung"] == "c" and [(x["rung"], x["failure"]) for x in got["attempts"]] == [("b", "no_items"), ("a", "ZeroDivisionError"), ("c", None)]
    assert [one(spark, documents.segmentation_smell(F.lit(a), F.lit(b))) for a, b in ((20, 2), (3, 12), (5, 5))] == ["under_split", "over_split", None]
    assert one(spark, documents.page_span(s("--- PAGE 1 ---a--- PAGE 2 ---b--- PAGE 3 ---c"), F.lit(2), F.lit(3))) == "--- PAGE 2 ---b--- PAGE 3 ---c"
    assert documents.ordered_rungs(["a", "b"], "z") == ["a", "b"]


def test_geometry(spark):
    square = lambda x, y, n: [[(x, y), (x + n, y), (x + n, y + n), (x, y + n)]]
    ell = [[(0, 0), (4, 0), (4, 1), (1, 1), (1, 4), (0, 4)]]
    hole = [square(0, 0, 4)[0], square(1, 1, 2)[0]]
    plain = lambda p: [[list(map(float, q)) for q in r] for r in p]
    two = [(square(0, 0, 4), square(2, 2, 4), 4), (ell, ell, 7), (ell, square(0, 0, 2), 3), (ell, square(9, 9, 1), None), (hole, square(0, 0, 4), 12)]
    rows = spark.createDataFrame([(i, plain(p), plain(q)) for i, (p, q, _) in enumerate(two)], f"id int, p {shapes.SHAPE}, q {shapes.SHAPE}")
    got = {r["id"]: round(r["area"], 6) for r in shapes.covered_area(rows, ["p", "q"]).collect()}
    assert got == {i: a for i, (_, _, a) in enumerate(two) if a}
    shape = f"id string, polygon {shapes.SHAPE}"
    left = spark.createDataFrame([("a", plain(square(0, 0, 4))), ("b", plain(square(50, 50, 4)))], shape)
    right = spark.createDataFrame([("z", plain(square(1, 1, 4))), ("y", plain(square(3, 3, 4)))], shape)
    assert [(r["left_id"], r["right_id"], round(r["shared"], 6)) for r in shapes.assign_by_area(left, right, 0.25, 3.0).collect()] == [("a", "z", 9.0)]


MINUTES = """ROLL CALL
Members present: Ann Lee, Bo Kay, Cy Dee and Ed Eff. Absent: Gil Hay.
1. Adoption of the annual budget
Moved by Lee, seconded by Kay. Motion carried 3-1.
Ayes: Lee, Kay, Dee
Noes: Eff
2. Rezoning of the mill site
Motion by Dee. Motion failed 1-3.
Ayes: Lee, Kay
Noes: Eff
ADJOURNMENT
"""


def test_minutes(spark):
    who = minutes.attendance(MINUTES)
    assert who.present == ["Ann Lee", "Bo Kay", "Cy Dee", "Ed Eff"] and who.absent == ["Gil Hay"] and who.present_count == 4
    told = minutes.attendance("Mayor Oak and Councilmembers Elm, Ash,\nand Fir were present. Councilmember Yew was absent.")
    assert told.present == ["Oak", "Elm", "Ash", "Fir"] and told.absent == ["Yew"]
    items = [{"id": "i1", "agenda_number": "1.", "title": "Adoption of the annual budget", "matter_file": None}, {"id": "i2", "agenda_number": "2.", "title": "Rezoning of the mill site", "matter_file": None}]
    roster = ["Ann Lee", "Bo Kay", "Cy Dee", "Ed Eff"]
    got = minutes.observe(MINUTES, items, roster)
    first = {(o["claim"], o["member"]): (o["value"], o["withheld"]) for o in got if o["item_id"] == "i1"}
    assert first[("outcome", None)] == ("passed", None) and first[("tally", None)] == ("3-1", None) and first[("vote", "Ed Eff")] == ("no", None)
    second = [o for o in got if o["item_id"] == "i2"]
    assert [o["withheld"] for o in second if o["claim"] == "outcome"] == [None] and {o["withheld"] for o in second if o["claim"] != "outcome"} == {"tally_contradicts_lists"}
    assert minutes.sentence_spans("Mr. Lee spoke. It passed.") == [(0, 14), (15, 25)]
    assert minutes.increasing([(5, "a"), (1, "b"), (7, "c"), (9, "d")]) == [(5, "a"), (7, "c"), (9, "d")]
    shape = "meeting_id string, text string, items array<struct<id:string,agenda_number:string,title:string,matter_file:string>>, roster array<string>"
    rows = [("m", MINUTES, [tuple(i[k] for k in ("id", "agenda_number", "title", "matter_file")) for i in items], roster), ("n", None, None, None)]
    assert minutes.observations(spark.createDataFrame(rows, shape)).count() == len(got)


def test_random_names_resolve():
    rng = random.Random(1)
    keys = minutes.roster_keys(["Ann Lee", "Bo Lee", "Cy Dee"])
    assert minutes.resolve("Dee", keys) == "Cy Dee" and minutes.resolve("Lee", keys) is None and minutes.resolve("A. Lee", keys) == "Ann Lee"
    assert minutes.resolve("".join(rng.choice("xyz") for _ in range(5)), keys) is None


def test_arrays(spark):
    from plenum.functions import arrays

    assert one(spark, arrays.count_of(s('[1, 2]'))) == 2 and one(spark, arrays.count_of(s('{"a": 1}'))) == 0
    topics = {"house": "housing", "homes": "housing", "park": "parks"}
    assert one(spark, arrays.canonical_topics(F.col("t"), topics), t=(["New homes", "PARK", "none"], "array<string>")) == ["housing", "parks"]
    assert one(spark, arrays.single_topic(s("Zoning "), topics)) == "zoning"
    assert one(spark, arrays.allowed_topics(F.col("t"), ["a"]), t=(["x"], "array<string>")) == ["other"] and one(spark, arrays.allowed_topics(F.col("t"), ["a"]), t=([], "array<string>")) == []
    got = one(spark, arrays.patched(F.col("o"), F.col("n")), o=({"a": "1", "b": "2"}, "map<string,string>"), n=({"b": "3"}, "map<string,string>"))
    assert got == {"a": "1", "b": "3"}
    docs = [("Closed agenda.pdf", "u"), ("Draft agenda.pdf", "u"), ("Agenda", "http://h/view.html"), ("Agenda.pdf", "u1"), ("Agenda.pdf", "u2")]
    assert one(spark, arrays.pick_document(F.col("d")), d=(docs, "array<struct<name:string,url:string>>"))["url"] == "u1"
    assert [arrays.first_json(t) for t in ('x ```json {"a": [1, 2,],}``` y', "none", None, '{"a": "b')] == ['{"a": [1, 2]}', None, None, '{"a": "b"}']
    files = spark.createDataFrame([(1, "Leg Ver2.pdf"), (1, "Leg Ver10.pdf"), (1, "Memo.pdf")], "k int, name string")
    assert sorted(r["name"] for r in arrays.newest_versions(files, "k", "name").collect()) == ["Leg Ver10.pdf", "Memo.pdf"]
    assert [one(spark, arrays.leading_number(s(t))) for t in ("3.a) Budget", "A. Minutes", "Budget of 3")] == ["3.a", "A", None]
    items = spark.createDataFrame([(1, ["a", "b"]), (1, ["b"])], "m int, topics array<string>")
    assert arrays.topics_by_frequency(items, "m", "topics").first()["topics"] == ["b", "a"]
    shape = "k int, at int, attachments array<struct<name:string,url:string,pages:array<int>>>"
    rows = spark.createDataFrame([(1, 2, [("n", "http://h/1?sig=2", None)]), (1, 1, [("m", "http://h/2", None), ("n", "http://h/1?sig=1", None)])], shape)
    assert [a["name"] for a in arrays.distinct_attachments(rows, "k", ["at"]).first()["attachments"]] == ["m", "n"]
    assert one(spark, arrays.better_ocr(s("§§ 1"), s("A readable line of text")))


def test_sinks(spark, tmp_path):
    from plenum.sources import sinks

    rows = spark.createDataFrame([("x", '{"type":"Point","coordinates":[1,2]}', 3), ("y", None, 0)], "name string, geo string, n int")
    import json

    got = [json.loads(r["value"]) for r in sinks.features(rows, "geo", ["name", "n"]).collect()]
    assert got[0]["geometry"]["coordinates"] == [1, 2] and got[1]["geometry"] is None and got[0]["properties"] == {"name": "x", "n": 3}
    assert one(spark, sinks.coverage_tier({"item": F.lit(2), "matter": F.lit(0)})) == "item" and one(spark, sinks.coverage_tier({})) == "pending"
    assert sinks.telemetry({"a": rows, "b": rows.limit(1)}).count() == 3
    calls = []
    compute = lambda: calls.append(1) or rows.limit(1)
    for minute, times in ((0, 1), (30, 1), (90, 2)):
        stored = sinks.snapshot(spark, f"{tmp_path}/s", compute, datetime.datetime(2025, 1, 1, 0, 0) + datetime.timedelta(minutes=minute))
        assert stored.count() == 1 and len(calls) == times


def test_table_shapes_and_redlines(spark):
    from plenum.operators import documents

    prose = "\n".join(f"Line {i} of an ordinary report that has words and few numbers in it" for i in range(300))
    columns = "\n".join(f"Precinct {i}   {i * 7}   {i * 3}" for i in range(250))
    numbers = "\n".join(f"{i}00 {i}50 x" for i in range(1000, 1250))
    repeats = prose + "\n" + "\n".join(["yes no yes no yes no yes no"] * 25)
    got = [one(spark, documents.fixed_width_table(s(x))) for x in (prose, columns, numbers, repeats, "\n".join(columns.split("\n")[:150]), "", None)]
    assert got == [False, True, True, True, False, False, False]
    assert [one(spark, documents.redline_counts(F.lit(a), F.lit(b))) for a, b in ((3, 0), (1, 1), (2, 0), (0, 9), (0, 0))] == [True, True, False, False, False]
