"""Bridges between roster rows that name one member."""

from plenum.operators.identities import bridges, conflicting, resolved

ROW = "city string, member_id string, name string, has_votes boolean"


def table_of(spark, rows):
    return spark.createDataFrame([("c", *r) if len(r) == 3 else r for r in rows], ROW)


def found(spark, rows):
    return {(r["member_id"], r["key"]): (r["canonical_id"], r["basis"]) for r in bridges(table_of(spark, rows), "city").collect()}


def test_equal_names_join_the_only_anchor(spark):
    got = found(spark, [("1", "Ann Lee", True), ("2", "Councilmember ANN LEE", False), ("3", "Bo Díaz", None), ("3", "Bo Díaz", None)])
    assert got == {("1", "ann lee"): ("1", "own"), ("2", "ann lee"): ("1", "equal_name"), ("3", "bo diaz"): ("3", "own")}


def test_shortened_and_middle_names(spark):
    got = found(spark, [("1", "Maria del Carmen Ruiz", True), ("2", "Carmen Ruiz", False), ("3", "Ruiz", False), ("4", "Jo Q. Park", True), ("5", "Jo Quinn Park", False), ("6", "Jo Park", False), ("7", "Jo R. Park", False), ("8", "Al Park", False)])
    assert got[("2", "carmen ruiz")] == got[("3", "ruiz")] == ("1", "unique_anchor_suffix")
    assert got[("5", "jo quinn park")] == got[("6", "jo park")] == ("4", "unique_anchor_middle_name")
    assert got[("7", "jo r park")] == ("7", "own") and got[("8", "al park")] == ("8", "own")


def test_ambiguous_names_stay_apart(spark):
    got = found(spark, [("1", "Ann Lee", True), ("2", "Ann Lee", True), ("3", "Lee", False), ("4", "Cy Fox", False), ("5", "Cy Fox", False), ("6", "Di Fox", True), ("7", "Fox", False), ("8", "Fox", False)])
    assert got[("1", "ann lee")] == got[("2", "ann lee")] == (None, "ambiguous")
    assert got[("3", "lee")] == ("3", "own")  # two anchors have the last name
    assert got[("4", "cy fox")] == got[("5", "cy fox")] == (None, "ambiguous")
    assert got[("7", "fox")] == got[("8", "fox")] == (None, "ambiguous")


def test_scopes_nulls_and_empty(spark):
    rows = [("c", "1", "Ann Lee", True), ("d", "2", "Lee", False), ("c", "3", None, True), ("c", "4", " .", False), (None, "5", "Lee", False)]
    assert {(r["city"], r["member_id"], r["canonical_id"]) for r in bridges(table_of(spark, rows), "city").collect()} == {("c", "1", "1"), ("d", "2", "2")}
    assert bridges(table_of(spark, rows).limit(0), "city").count() == 0


def test_mentions_and_conflicts(spark):
    roster = table_of(spark, [("1", "Ann B. Lee", True), ("2", "Cy Fox", True), ("3", "Lee", False)])
    mentions = spark.createDataFrame([("c", "lee"), ("c", "Mayor Cy Fox"), ("c", "Nobody"), ("d", "Lee")], "city string, name string")
    assert {(r["city"], r["name"]): r["member_id"] for r in resolved(mentions, roster, "city").collect()} == {("c", "lee"): "1", ("c", "Mayor Cy Fox"): "2", ("c", "Nobody"): None, ("d", "Lee"): None}
    pairs = spark.createDataFrame([("c", "Cy Fox", "Ann B. Lee"), ("c", "Ann Beth Lee", "Ann B. Lee"), ("c", "Ann C. Lee", "Ann B. Lee"), ("c", "Ann B. D. Lee", "Ann B. Lee"), ("c", "Lee", "Ann B. Lee"), ("c", None, "Ann B. Lee")], "city string, raw string, chosen string")
    assert [r["raw"] for r in conflicting(pairs, roster, "city").where("conflict").sort("raw").collect()] == ["Ann B. D. Lee", "Ann C. Lee", "Cy Fox"]
