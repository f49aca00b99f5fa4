"""Votes in minutes: six shapes of our own, each claim checked."""

import re

import pytest

from plenum.operators import rollcall

ROSTER = ["Ann Ash", "Bo Birch", "Cy Cedar", "Di Dogwood", "Ed Elm", "Flo Fir", "Gil Hazel Grove", "Pat Oak", "Sam Oak", "Zoë Peña"]

# A narrative with a wrapped result, bare disposition and lists with counts at the end.
EN_BLOC = """ROLL CALL
RESOLUTIONS

26-11 A resolution about parks
A motion offered by Ash, duly seconded by Birch, that Resolution
26-11 be adopted en bloc, carried by the following vote:

Adopted

Aye:          Ash, Birch, Cedar, Dogwood,
           Elm, Hazel Grove (6)
--- PAGE 2 ---
Nay:        (None) (0)
"""
# Counts first, one motion after another, and a result that breaks before its last word.
COUNTED = """7. Towing rules
        A motion was made by Councilor Fir that this matter be Amended. Councilor
        Fir moved Amendment No. 1. The motion carried by the following vote:

              For:  3 -  Ash, Birch, and Fir

        A motion was made by Councilor Cedar that this matter be Sent to Council
        Without Recommendation, as Amended. The motion failed by the following
        vote:

              For:  1 -  Cedar

          Against:  2 -  Ash, and
                         Birch
"""
# A result box with labels, told in prose before.
BOX = """1. Variance at 4 Main Street
   Vice-Chair Birch made the motion to table. The motion passed unanimously.

   RESULT:       PASSED [UNANIMOUS]
   MOVER:        Bo Birch,
   SECONDER:     Ann Ash,
   AYES:         Ann Ash, Bo Birch, Cy
                 Cedar, Zoe Pena
"""
# Tallies in parentheses and seconds in sentences of their own.
TALLIES = """3. Sign permit
   Board Member Dogwood offered a motion to approve the sign as submitted.

       Board Member Elm seconded the motion.

       Motion carried (5-0).

4. Paint scheme
   Chair Fir moved to continue. Seconded by Member Elm. Motion failed, 2-3.
   The permit was last approved 8/11/26 in part.
5. Closing
   Ann Ash moved to adjourn. Motion carried 5-0.
"""
# Lists before the result.
LISTS_FIRST = """I. Ordinance on kratom
   The department explained the ordinance and its history at length.

   Ayes: Supervisor Ash, Supervisor Birch – Two (2)
   Noes:
   Excused:
   Abstained:
   Motion passed 2/0
II. Ordinance on scooters
   The department explained the second ordinance and its history at length.

   Ayes: Ash, Cedar
   Noes: Birch
   Abstain: None
   Passed
"""
# Blank lines between categories, and everything that must be held back.
FAULTS = """A. Licence of J. Doe
   Ald. Ash moved denial. (Prevailed 3-1)
   AMENDED

       Aye  3 -  Ash, Birch, and Cedar

       No  1 -   Dogwood

       Excused  1 -   Nobody Known
B. Licence of K. Doe
   Moved by Stranger, seconded by Oak. Motion carried 4-0.
       Aye  3 -  Ash, Birch, and Cedar
C. Licence of L. Doe
   The motion carried by the following vote:
       Aye  4 -  Ash, Birch, Cedar
       No  2 -  Elm, Oak
D. Licence of M. Doe
   The motion passed.
   RESULT: FAILED
       Ayes: Ash, Birch
       Noes: Ash, Cedar
E. Licence of N. Doe
   Vote: 0-0
"""
TEXTS = {"en bloc": EN_BLOC, "counted": COUNTED, "box": BOX, "tallies": TALLIES, "lists first": LISTS_FIRST, "faults": FAULTS}
STARTS = {"en bloc": {"i": "26-11 A"}, "counted": {"i": "7."}, "box": {"i": "1."}, "tallies": {"a": "3.", "b": "4.", "c": "5."}, "lists first": {"a": "I.", "b": "II."}, "faults": {x: f"{x}. Lic" for x in "ABCDE"}}


@pytest.fixture(scope="module")
def found(spark):
    meetings = spark.createDataFrame([*TEXTS.items(), ("no text", None), ("no votes", "Minutes of a quiet day.\nNo 5 people spoke."), ("no item", "Motion carried 3-0.")], "meeting_id string, text string")
    starts = [(m, i, name) for m, names in STARTS.items() for name, head in names.items() for i, line in enumerate(TEXTS[m].split("\n")) if line.startswith(head)]
    roster = spark.createDataFrame([(m, n, n) for m in [*TEXTS, "no item"] for n in ROSTER], "meeting_id string, member string, name string")
    rows = rollcall.claims(meetings, spark.createDataFrame(starts, "meeting_id string, line_no int, item_id string"), roster).collect()
    out = {}
    for r in rows:
        out.setdefault((r["meeting_id"], r["motion"]), []).append((r["claim"], r["value"], r["member"] or r["raw"], r["withheld"], r["item_id"], r["start"], r["end"]))
    return out


def told(found, meeting, motion, claim):
    return sorted((c[1:4] for c in found.get((meeting, motion), []) if c[0] == claim), key=str)


def votes(side, *names):
    return [(side, n, None) for n in names]


def test_wrapped_result_and_lists_over_a_page_break(found):
    assert told(found, "en bloc", 1, "outcome") == [("passed", None, None)] and ("en bloc", 2) not in found
    assert told(found, "en bloc", 1, "tally") == [("6-0", None, None)]
    assert told(found, "en bloc", 1, "vote") == votes("yes", "Ann Ash", "Bo Birch", "Cy Cedar", "Di Dogwood", "Ed Elm", "Gil Hazel Grove")
    assert told(found, "en bloc", 1, "mover") == [(None, "Ann Ash", None)] and told(found, "en bloc", 1, "seconder") == [(None, "Bo Birch", None)]


def test_counts_before_names(found):
    assert [told(found, "counted", m, "outcome") for m in (1, 2, 3)] == [[("passed", None, None)], [("failed", None, None)], []]
    assert [told(found, "counted", m, "tally") for m in (1, 2)] == [[("3-0", None, None)], [("1-2", None, None)]]
    assert told(found, "counted", 2, "vote") == sorted(votes("yes", "Cy Cedar") + votes("no", "Ann Ash", "Bo Birch"), key=str)
    assert [told(found, "counted", m, "mover") for m in (1, 2)] == [[(None, "Flo Fir", None)], [(None, "Cy Cedar", None)]]


def test_box_tells_the_same_result_again(found):
    assert told(found, "box", 1, "outcome") == [("passed", None, None)] and ("box", 2) not in found
    assert told(found, "box", 1, "vote") == votes("yes", "Ann Ash", "Bo Birch", "Cy Cedar", "Zoë Peña")


def test_tallies(found):
    assert told(found, "tallies", 1, "tally") == [("5-0", None, None)] and told(found, "tallies", 1, "mover") == [(None, "Di Dogwood", None)]
    assert told(found, "tallies", 1, "seconder") == [(None, "Ed Elm", None)]
    assert told(found, "tallies", 2, "outcome") == [("failed", None, None)] and told(found, "tallies", 2, "tally") == [("2-3", None, None)]
    assert told(found, "tallies", 3, "outcome") == [("passed", None, "procedural")] and ("tallies", 4) not in found  # a date is no vote
    assert [found["tallies", m][0][4] for m in (1, 2, 3)] == ["a", "b", "c"]
    for m in (1, 2):
        *_, start, end = found["tallies", m][0]
        assert "otion" in TALLIES[start:end]


def test_lists_before_the_result(found):
    assert told(found, "lists first", 1, "tally") == [("2-0", None, None)] and told(found, "lists first", 1, "vote") == votes("yes", "Ann Ash", "Bo Birch")
    assert told(found, "lists first", 2, "outcome") == [("passed", None, None)] and told(found, "lists first", 2, "tally") == [("2-1", None, None)]
    assert told(found, "lists first", 2, "vote") == sorted(votes("yes", "Ann Ash", "Cy Cedar") + votes("no", "Bo Birch"), key=str)


def test_what_is_held_back(found):
    assert told(found, "faults", 1, "tally") == [("3-1", None, None)] and ("absent", "Nobody Known", "unknown_member") in told(found, "faults", 1, "vote")
    assert told(found, "faults", 2, "tally") == [("4-0", None, "tally_contradicts_lists")] and {v[2] for v in told(found, "faults", 2, "vote")} == {"tally_contradicts_lists"}
    assert told(found, "faults", 2, "mover") == [(None, "Stranger", "unknown_member")] and told(found, "faults", 2, "seconder") == [(None, "Oak", "ambiguous_member")]
    held = {v[1]: v[2] for v in told(found, "faults", 3, "vote")}
    assert held == {"Ann Ash": "count_contradicts_names", "Bo Birch": "count_contradicts_names", "Cy Cedar": "count_contradicts_names", "Ed Elm": None, "Oak": "ambiguous_member"}
    assert told(found, "faults", 3, "tally") == []
    assert told(found, "faults", 4, "outcome") == [(None, None, "renderings_disagree")]
    assert sorted(told(found, "faults", 4, "vote"), key=str) == sorted([("yes", "Ann Ash", "listed_twice"), ("no", "Ann Ash", "listed_twice"), *votes("yes", "Bo Birch"), *votes("no", "Cy Cedar")], key=str)
    assert told(found, "faults", 5, "outcome") == [(None, None, "not_stated")] and told(found, "faults", 5, "tally") == [("0-0", None, "all_zero")]


def test_texts_without_votes_or_items(found):
    assert not [k for k in found if k[0] in ("no text", "no votes")]
    assert told(found, "no item", 1, "outcome") == [("passed", None, "no_item")]


def test_only_telling_lines_are_kept(spark):
    """What is held for claims are results and lists, not the text; a result without a telling word is none."""
    text = "Item A\nThe whole text is read aloud by the clerk and heard by all.\nMotion carried 2-1\nAyes: Doe, Roe\nNoes: Poe\n\n" + "More of the same text follows here, line by line.\n" * 5
    lines = rollcall.numbered_lines(spark.createDataFrame([("m", text)], "meeting_id string, text string"))
    rows = rollcall.telling(rollcall.read_lines(lines, spark.createDataFrame([("m", 0, "a")], "meeting_id string, line_no int, item_id string"))).orderBy("line_no").collect()
    assert [r["line_no"] for r in rows] == [2, 3, 4] and [r["line"] for r in rows] == ["Motion carried 2-1", None, None]
    assert [x["line_no"] for x in rows[0]["around"]] == [0, 1, 2, 3, 4, 5]
    assert all(re.search(rollcall.TELLING, w) for w in [*rollcall.PASSED, *rollcall.FAILED, "Vote"])
