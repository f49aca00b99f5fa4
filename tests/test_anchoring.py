"""Anchors of items in minutes: the heaviest chain against brute force, and labelled texts."""

from itertools import product

from hypothesis import given, settings
from hypothesis import strategies as st

from plenum.operators.anchoring import anchors, heaviest_chain

ITEM = "meeting_id string, item_id string, sequence int, matter_file string, agenda_number string, title string"


def heaviest(groups):
    best = 0
    for pick in product(*[[None, *g] for g in groups]):
        taken = [p for p in pick if p]
        if all(a[0] < b[0] for a, b in zip(taken, taken[1:])):
            best = max(best, sum(w for _, w in taken))
    return best


@settings(max_examples=400, deadline=None)
@given(st.lists(st.lists(st.tuples(st.integers(0, 9), st.integers(1, 9)), max_size=4, unique_by=lambda x: x[0]), max_size=5))
def test_chain_is_the_heaviest(groups):
    chain = heaviest_chain(groups)
    assert all(a[0] < b[0] and a[1] < b[1] for a, b in zip(chain, chain[1:]))
    assert sum(dict(groups[g])[p] for g, p in chain) == heaviest(groups)


def test_chain_grows_with_n_log_n():
    n = 20_000
    assert len(heaviest_chain([[(i, 2), (n - i, 1)] for i in range(n)])) >= n - 1


def found(spark, texts, items):
    rows = anchors(spark.createDataFrame(texts, "meeting_id string, text string"), spark.createDataFrame(items, ITEM))
    return {(r["meeting_id"], r["item_id"]): (r["line_no"], r["kind"]) for r in rows.collect()}


def test_kinds_and_decoys(spark):
    text = "\n".join([
        "MINUTES",  # 0
        "Council will hear the sewer bond refunding ordinance and Bill 24-117 later.",  # 1: mentions of b and a
        "1. Resolution 24-117 on street trees",  # 2: a
        "Moved to hear it with DRB260012 below.",  # 3: mention of c
        "b. Sewer bond refunding ordinance, second",  # 4: b, wraps
        "reading and final passage",  # 5
        "1. first condition of the bond",  # 6: a number inside an item
        "DRB260012 Design review of the mill",  # 7: c
        "The library roof repairs contract was",  # 8: d, title only, one line off in the middle
        "awarded.",  # 9
        "12.5 Acres were sold",  # 10: a measure
    ])
    items = [
        ("m", "a", 1, "Bill 24-117", "1", "Street trees"),
        ("m", "b", 2, None, "b", "Sewer bond refunding ordinance second reading"),
        ("m", "c", 3, None, None, "DRB260012 Design review of the old mill"),
        ("m", "d", 4, None, "12.50", "Library roof repairs contract"),
        ("m", "e", 5, "X 9", None, "Unknown"),
        ("m", "f", None, None, None, None),
    ]
    got = found(spark, [("m", text)], items)
    assert got == {("m", "a"): (2, "file"), ("m", "b"): (4, "title"), ("m", "c"): (7, "code"), ("m", "d"): (8, "title")}


def test_file_numbers_are_whole(spark):
    items = [("m", "a", 1, "24-11", None, None), ("m", "b", 2, r"R.4 (\E)", None, None)]
    assert found(spark, [("m", "Bill 24-117\nBill X24-11\nBill 24-11, read\nnothing")], items) == {("m", "a"): (2, "file")}


def test_order_and_repeats(spark):
    """What stands against the agenda's order for less weight goes; a repeated item counts once."""
    text = "2. Park lights\nRES 24-0001\n3. Pool hours\nRES 24-0004"
    items = [("m", "one", 1, "RES 24-0001", None, None), ("m", "two", 2, None, "2", None), ("m", "three", 3, None, "3", None), ("m", "four", 4, "RES 24-0004", None, None)]
    assert set(found(spark, [("m", text)], items + items[:2])) == {("m", "one"), ("m", "three"), ("m", "four")}


def test_meetings_apart_and_empty(spark):
    texts = [("m", "1. Trees"), ("n", None), ("o", ""), ("p", "x\n1) Trees")]
    items = [(m, "a", 1, "", "1.", "") for m in "mnop"] + [(None, "a", 1, None, "1", None)]
    assert found(spark, texts, items) == {("m", "a"): (0, "number"), ("p", "a"): (1, "number")}
    assert found(spark, texts[:0], items) == {} and found(spark, texts, items[:0]) == {}


def test_a_meeting_is_read_in_one_row(spark):
    """Texts pass one exchange, whatever the kinds of places; nothing else of a line is shuffled."""
    texts = spark.createDataFrame([("m", "Über 24-117\n1. Éclairs für alle Gäste\n½ Éclair")], "meeting_id string, text string")
    items = spark.createDataFrame([("m", "a", 1, None, None, "éclairs für alle gäste")], ITEM)
    rows = anchors(texts, items)
    assert [tuple(r) for r in rows.collect()] == [("m", "a", 1, "title", 4000)]
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and plan.count("Join") == 1
