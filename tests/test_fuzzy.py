"""Fuzzy lookup against difflib over all names."""

import difflib
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from plenum.operators.fuzzy import asked_keys, close_names, close_pairs, known_keys, name_index, suggestions
from plenum.plans.names import close_words, words
from plenum.sources.tables import tables

NAMES = ["Springfield", "Springfield", "Springdale", "Spring Hill", "Palo Alto", "East Palo Alto", "Saint Augustine", "St. Augustine", "San José", "", "A", "Ab", "City of Saint Augustine Beach", "City of Saint Augustine", None]
ASKED = ["springfeild", "Springfield", "sprngdale", "palo allto", "San Jose", "saint agustine", "city of st augustine", "", "a", "ba", "nowhere at all", None, "springfeild"]


@settings(max_examples=400, deadline=None)
@given(st.text("abcd", max_size=18), st.text("abcd", max_size=18), st.sampled_from([0.6, 0.75, 0.8, 0.9, 1.0]))
def test_close_names_share_a_key(known, asked, cutoff):
    if difflib.SequenceMatcher(None, known, asked).ratio() >= cutoff:
        assert known_keys(known, cutoff) & asked_keys(asked, cutoff)


@settings(max_examples=300, deadline=None)
@given(st.text("abcdefgh ", min_size=1, max_size=40), st.lists(st.tuples(st.integers(0, 40), st.sampled_from(["cut", "add", "set"]), st.sampled_from("abxyz")), max_size=9), st.sampled_from([0.6, 0.8, 0.9]))
def test_edited_names_share_a_key(known, edits, cutoff):
    chars = list(known)
    for at, kind, char in edits:
        at = min(at, len(chars))
        chars[at : at + (kind != "add")] = [] if kind == "cut" else [char]
    asked = "".join(chars)
    if difflib.SequenceMatcher(None, known, asked).ratio() >= cutoff:
        assert known_keys(known, cutoff) & asked_keys(asked, cutoff)


def expected(asked, names, n, cutoff):
    out = set()
    for word in {a.lower() for a in asked if a is not None}:
        hits = Counter(difflib.get_close_matches(word, [x.lower() for x in names if x is not None], n=n, cutoff=cutoff))
        out |= {(word, name, taken) for name, taken in hits.items()}
    return out


@pytest.mark.parametrize("n,cutoff", [(5, 0.8), (1, 0.8), (3, 0.6), (5, 1.0)])
def test_same_as_difflib(spark, n, cutoff):
    known = spark.createDataFrame([(x,) for x in NAMES], "name string")
    asked = spark.createDataFrame([(x, 1) for x in ASKED], "name string, copies int")
    got = close_names(asked, name_index(known, cutoff=cutoff), n=n, cutoff=cutoff)
    assert {(r["asked"], r["name"], r["taken"]) for r in got.collect()} == expected(ASKED, NAMES, n, cutoff)


def test_scopes_and_empty_tables(spark):
    known = spark.createDataFrame([("CA", "Salem"), ("OR", "Salem"), (None, "Salen"), ("OR", "Salida")], "state string, name string")
    asked = spark.createDataFrame([("OR", "salm"), (None, "salem")], "state string, name string")
    got = close_names(asked, name_index(known, scope=("state",)), scope=("state",)).collect()
    assert {(r["state"], r["asked"], r["name"]) for r in got} == {("OR", "salm", "salem"), (None, "salem", "salen")}
    assert close_names(asked.limit(0), name_index(known)).count() == 0 and close_names(asked, name_index(known.limit(0))).count() == 0
    with pytest.raises(ValueError):
        name_index(known, cutoff=0.3)


def test_suggestions(spark):
    known = spark.createDataFrame([(1, "Salem"), (2, "SALEM"), (3, "Salen"), (4, "Dover")], "id int, name string")
    got = suggestions(spark.createDataFrame([("salem",), ("salenm",)], "q string"), known, "q").collect()
    assert {(r["asked"], r["id"]) for r in got} == {("salem", 1), ("salem", 2), ("salenm", 1), ("salenm", 2), ("salenm", 3)}


def test_frequent_piece_makes_no_rows(spark):
    """A piece that all names have leaves only pairs within the budget after the join."""
    made = spark.range(300).select(F.concat(F.lit("city of "), F.substring(F.md5(F.col("id").cast("string")), 1, 12)).alias("name"))
    rows = [r["name"] for r in made.collect()]
    got = {(r["asked"], r["name"]) for r in close_pairs(made, name_index(made), "name").collect()}
    assert got == {(a, b) for a in rows for b in rows if difflib.SequenceMatcher(None, b, a).ratio() >= 0.8}


def test_registered_query(spark, sf_dir):
    documents, benchmark = tables(spark, sf_dir, "documents", "benchmark")
    names = [r["word"] for r in words(documents).distinct().collect()]
    asked = sorted({r["word"] for r in words(benchmark).collect()})[::12]
    counts = Counter(r["word"] for r in words(documents).collect())
    got = {}
    for r in close_words(spark, sf_dir).collect():
        got.setdefault(r["asked"], []).append((r["score"], r["name"], r["taken"]))
    for word in asked:
        best, left = [], 5
        for name in difflib.get_close_matches(word, names, n=5):
            if difflib.SequenceMatcher(None, name, word).ratio() >= 0.8 and left:
                best.append((name, min(left, counts[name])))
                left -= best[-1][1]
        assert [(name, taken) for _, name, taken in sorted(got.get(word, []), reverse=True)] == best
