"""Keyed operators, merges, queues, sources and streams."""

import datetime
import json

import pytest
from pyspark.sql import functions as F

from plenum.operators import incremental, keyed, merge, minutes, opinions, rosters, search
from plenum.plans.facade import Records
from plenum.sources import blobs, connectors, readonly
from plenum.streaming import states


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=str)


def at(minute):
    return datetime.datetime(2024, 1, 1, 12, 0) + datetime.timedelta(minutes=minute)


def test_asof_and_preference(spark):
    left = spark.createDataFrame([("k", 5), ("k", 1), ("j", 9)], "key string, t int")
    right = spark.createDataFrame([("k", 1, "a"), ("k", 5, "b"), ("k", None, "old")], "key string, u int, v string")
    plain = keyed.asof_backward(left, right, ["key"], "t", "u", ["v"], "v")
    assert rows(plain, "key", "t", "v") == [("j", 9, None), ("k", 1, "a"), ("k", 5, "b")]
    strict = keyed.asof_backward(left, right, ["key"], "t", "u", ["v"], "v", strict=True, null_times=True)
    assert rows(strict, "key", "t", "v") == [("j", 9, None), ("k", 1, "old"), ("k", 5, "a")]
    votes = spark.createDataFrame([(1, "api"), (1, "minutes"), (2, "api")], "k int, src string")
    assert rows(keyed.preferred(votes, ["k"], "src", "minutes"), "k", "src") == [(1, "minutes"), (2, "api")]
    assert rows(keyed.unique_by_key(spark.createDataFrame([("x", 1), ("y", 1), ("y", 2)], "k string, id int"), ["k"], "id"), "k", "id") == [("x", 1)]


def test_merges(spark):
    old = spark.createDataFrame([(1, "a", "s", 5), (2, "b", None, 5), (4, "d", None, 1)], "id int, title string, summary string, seen int")
    new = spark.createDataFrame([(1, "A", None, 9), (2, None, "n", 3), (3, "c", None, 2)], "id int, title string, summary string, seen int")
    got = merge.upsert(old, new, ["id"], {"seen": merge.largest}, frozen_if=F.col("old.summary").isNotNull(), frozen=["title"])
    assert rows(got, "id", "title", "summary", "seen") == [(1, "a", "s", 9), (2, "b", "n", 5), (3, "c", None, 2), (4, "d", None, 1)]
    changes = merge.revisions(old, got, ["id"], ["title", "summary", "seen"], lengths_only=("summary",))
    assert {r["id"]: {k: tuple(v) for k, v in r["changes"].items()} for r in changes.collect()} == {1: {"seen": ("5", "9")}, 2: {"summary": (None, "1")}}
    gone, fresh = merge.reconcile(old, new, ["id"])
    assert rows(gone, "id") == [(4,)] and rows(fresh, "id") == [(3,)]
    kids = spark.createDataFrame([(1, "x"), (2, "y")], "p int, t string")
    assert rows(merge.replace_children(kids, spark.createDataFrame([(1, "z"), (1, "z")], "p int, t string"), "p"), "p", "t") == [(1, "z"), (2, "y")]
    stay, journal = merge.archive_and_retire(kids.withColumn("k", F.lit(7)), spark.createDataFrame([(1, 8)], "p int, k int"), "p", "k")
    assert rows(stay, "p") == [(2,)] and json.loads(journal.first()["row"])["t"] == "x"
    links = merge.ordered_links(spark.createDataFrame([(1, ["B ", "a", "b", ""])], "m int, names array<string>"), "m", "names")
    assert rows(links, "name", "pos", "is_primary") == [("a", 1, False), ("b", 0, True)]
    ids = merge.stable_ids(spark.createDataFrame([("i", "x"), ("i", "x"), ("i", "y"), ("j", "z")], "base string, what string"), "base", "what")
    assert ids.count() == 3 and {r["item_id"] for r in ids.where("base = 'j'").collect()} == {"j"}
    ok, stale = merge.compare_and_set(spark.createDataFrame([(1, "v1"), (2, "v1")], "id int, want string"), spark.createDataFrame([(1, "v1"), (2, "v2")], "id int, cur string"), "id", "want", "cur")
    assert rows(ok, "id") == [(1,)] and rows(stale, "id") == [(2,)]


@pytest.mark.parametrize("case,plan", [((None, "a", "completed", None), "NONE"), (("a", None, None, None), "ENQUEUE_VERSION"), (("a", "b", "pending", None), "ENQUEUE_VERSION"), (("a", "a", "pending", None), "NONE"), (("a", "a", "failed", None), "REACTIVATE_VERSION"), (("a", "a", "completed", "a"), "NONE")])
def test_reconciliation_plan(spark, case, plan):
    df = spark.createDataFrame([case], "want string, queued string, status string, have string")
    assert df.select(merge.reconciliation_plan(F.col("want"), F.col("queued"), F.col("status"), F.col("have")).alias("r")).first()["r"] == plan


def test_queues(spark):
    log = spark.createDataFrame([("k", 1, "A"), ("k", 2, "B"), ("k", 3, "A"), ("j", 5, "A"), ("j", 6, "A")], "key string, gen int, v string")
    assert rows(incremental.desired_state(log, "key", "gen", "v"), "key", "gen", "v", "reopened") == [("j", 6, "A", False), ("k", 3, "A", True)]
    done = spark.createDataFrame([("k", "A")], "key string, v string")
    assert rows(incremental.unresolved(log, done, "key", "v", "gen"), "key", "gen") == [("j", 6)]
    first = incremental.first_per_aggregate(log, "key", "gen", F.col("v") == "A")
    assert rows(first, "key", "gen") == [("j", 5), ("k", 1)]
    state = spark.createDataFrame([(None, at(0)), (2, at(0))], "n int, t timestamp").select(incremental.after_failure(F.col("n"), F.lit(50), F.col("t")).alias("s")).collect()
    assert [(r["s"]["retry_count"], r["s"]["status"]) for r in state] == [(1, "pending"), (3, "dead_letter")] and state[0]["s"]["ready_at"] == at(0) + datetime.timedelta(seconds=30)
    feed = "<rss><item><guid>1</guid><link>u</link></item><item><guid>2</guid></item></rss>"
    assert spark.createDataFrame([(feed,)], "b string").select(incremental.feed_keys(F.col("b")).alias("k")).first()["k"] == ["1", "2"]
    seen = incremental.retry_ledger(spark.createDataFrame([("u", at(i)) for i in range(5)] + [("w", at(0))], "url string, t timestamp"), "url", "t")
    assert rows(seen, "url", "attempts", "permanent") == [("u", 5, True), ("w", 1, False)]


def test_search(spark):
    docs = spark.createDataFrame([(1, "Zoning hearings for the parks"), (2, "A park and nothing else"), (3, None)], "id int, text string")
    tokens = search.index(docs, "id", "text")
    assert rows(search.match_all(tokens, "id", ["park", "zon"]), "id") == [(1,)]
    assert rows(docs.where(search.contains_all(F.col("text"), ["park"])), "id") == [(2,)]
    alerts = spark.createDataFrame([(9, ["else", "park"])], "alert_id int, keywords array<string>")
    assert rows(search.keyword_alerts(alerts, docs, "id", "text"), "alert_id", "id", "keyword") == [(9, 2, "else")]
    seen = spark.createDataFrame([(9, 2)], "alert_id int, id int")
    assert search.keyword_alerts(alerts, docs, "id", "text", seen).count() == 0
    assert "<mark>park</mark>" in docs.where("id = 2").select(search.headline(["park"])("text").alias("h")).first()["h"]


def test_people_and_votes(spark):
    roster = spark.createDataFrame([("c", "m1", "Ann Lee"), ("c", "m2", "Bo Lee"), ("c", "m3", "Mayor Cy Núñez")], "city string, member_id string, name string")
    asked = spark.createDataFrame([("c", 1, "Nunez"), ("c", 2, "Lee"), ("c", 3, "A. Lee"), ("d", 4, "Nunez")], "city string, mention_id int, name string")
    assert rows(rosters.resolve(asked, roster, "city"), "mention_id", "member_id") == [(1, "m3"), (2, None), (3, "m1"), (4, None)]
    kinds = spark.createDataFrame([("Planning Commission",), ("City Clerk",), ("N/A",), ("Ann Lee",)], "n string").select(rosters.actor_kind(F.col("n")).alias("k"))
    assert [r["k"] for r in kinds.collect()] == ["body", "role", "artifact", "person"]
    title = spark.createDataFrame([("Special Planning Board Meeting - Sep 30, 2026",), ("Regular Meeting",)], "t string").select(rosters.meeting_body(F.col("t")).alias("b"))
    assert [r["b"] for r in title.collect()] == ["Planning Board", None]
    parsed = spark.createDataFrame([("i", "a", "yes"), ("i", "b", "no"), ("j", "a", "yes")], "item string, member string, vote string")
    published = spark.createDataFrame([("i", "a", "yes"), ("i", "b", "yes")], "item string, member string, vote string")
    assert rows(minutes.compare(parsed, published, ["item"]), "item", "verdict") == [("i", "disagreement"), ("j", "not_comparable")]


def test_readonly_sql(spark):
    spark.range(3).createOrReplaceTempView("t3")
    assert readonly.run_query(spark, "SELECT 'drop; it' AS s, count(*) AS n FROM t3 -- comment\n;").first()["n"] == 3
    for bad in ("DROP TABLE t3", "SELECT 1; SELECT 2", "WITH a AS (SELECT 1) INSERT INTO t3 SELECT * FROM a", "SET a = 1", ""):
        with pytest.raises(readonly.NotReadOnly):
            readonly.validated(spark, bad)


def test_blobs_and_connectors(spark, tmp_path):
    files = spark.createDataFrame([("u1", bytearray(b"%PDF-1"), None, at(0)), ("u2", bytearray(b"%PDF-1"), None, at(1)), ("u3", bytearray(b""), None, at(1))], "source_url string, content binary, declared_type string, seen_at timestamp")
    stored, sightings = blobs.originals(files)
    assert rows(stored, "format", "n_bytes") == [("pdf", 6)] and sightings.count() == 2 and blobs.archive(stored, stored).count() == 1
    folder = tmp_path / "legistar"
    folder.mkdir()
    good = {"vendor_id": 7, "title": "Council", "start": "2025-01-02T03:00:00", "items": [{"vendor_item_id": 12, "title": "x", "sequence": -4, "attachments": [{"name": "a", "url": "https://h/a", "pages": [2, 1]}, {"name": "b", "url": "https://h/b"}]}]}
    (folder / "a.json").write_text("\n".join([json.dumps(good), json.dumps({"vendor_id": "8", "start": "2025-01-02"}), "{broken"]))
    ok, bad = connectors.connector("legistar").read(spark, str(tmp_path))
    row = ok.first()
    assert (row["vendor_id"], row["items"][0]["vendor_item_id"], row["items"][0]["sequence"], [a["name"] for a in row["items"][0]["attachments"]]) == ("7", "12", 1, ["b"])
    assert ok.count() == 1 and {tuple(r["failed"]) for r in bad.collect()} >= {("title",)} and bad.count() == 2
    assert len(connectors.PLATFORMS) == 23
    with pytest.raises(KeyError):
        connectors.connector("nobody")
    urls = spark.createDataFrame([("https://a.granicus.com/x", "granicus"), ("https://evil.org/x", "granicus"), ("ftp://x", "granicus"), ("https://any.org", "ross")], "u string, v string")
    assert [r["r"] for r in urls.select(connectors.url_verdict(F.col("u"), F.col("v")).alias("r")).collect()] == ["store", "warn", "reject", "store"]


def test_facade(spark):
    cities = spark.createDataFrame([("paloaltoCA", "Palo Alto", "CA", 60), ("salemOR", "Salem", "OR", 170), ("salemMA", "Salem", "MA", 40)], "banana string, name string, state string, population int")
    meetings = spark.createDataFrame([("m1", "salemOR", "Council", at(0), None), ("m2", "salemOR", "Board", at(9), "Cancelled"), ("m3", "salemOR", "Later", None, "final")], "id string, banana string, title string, date timestamp, status string")
    items = spark.createDataFrame([("i1", "m1", "Park bond", "for the parks", "F-1", "x1", 1), ("i2", "m2", "Sewer", "", "F-2", "x1", 1)], "id string, meeting_id string, title string, summary string, matter_file string, matter_id string, sequence int")
    r = Records(cities, meetings, items)
    assert [x["id"] for x in r.city_meetings("salemOR").collect()] == ["m2", "m1", "m3"]
    assert [x["id"] for x in r.upcoming("salemOR", F.lit(at(-1)), F.lit(at(60))).collect()] == ["m1"]
    assert [x["id"] for x in r.search_items("park bond").collect()] == ["i1"] and [x["id"] for x in r.search_items("F-2").collect()] == ["i2"]
    assert [x["banana"] for x in r.find_city("salem").collect()] == ["salemOR", "salemMA"] and [x["banana"] for x in r.find_city("Palo Alto, CA").collect()] == ["paloaltoCA"]
    assert r.close_cities("palo allto", ["Palo Alto", "Salem"]).first()["name"] == "palo alto"
    assert len(r.city_matters("salemOR").first()["timeline"]) == 2 and r.matter_timeline("x1").count() == 2 and r.meeting("m1").first()["items"][0]["item_id"] == "i1"


def stream_of(spark, folder, batches, schema):
    """A file stream of the batches in order, one file each."""
    for i, batch in enumerate(batches):
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").json(f"{folder}/{i}")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(f"{folder}/*")


def drain(stream, name, spark, folder):
    query = stream.writeStream.format("memory").queryName(name).option("checkpointLocation", f"{folder}/ck").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination(120)
    return spark.table(name)


def test_streamed_desired_states_equal_the_batch(spark, tmp_path):
    batches = [[("k", 1, "A"), ("j", 1, "A")], [("k", 3, "A"), ("k", 2, "B")], [("k", 2, "B"), ("j", 2, "A")]]
    shape = "key string, generation long, version string"
    got = drain(states.desired_states(stream_of(spark, tmp_path / "in", batches, shape)), "desired", spark, tmp_path)
    last = incremental.compact(got, "key", "generation")
    log = spark.createDataFrame(sum(batches, []), shape).distinct()
    assert rows(last, "key", "version") == rows(incremental.desired_state(log, "key", "generation", "version"), "key", "version")
    assert rows(got, "key", "generation", "version") == [("j", 1, "A"), ("k", 1, "A"), ("k", 2, "B"), ("k", 3, "A")]


def test_streamed_windows_and_moves(spark, tmp_path):
    shape = "at timestamp, key string"
    batches = [[(at(1), "a"), (at(2), "a")], [(at(70), "a")], [(at(400), "b")]]
    counts = states.windowed_counts(stream_of(spark, tmp_path / "w", batches, shape), "at", ["key"], "1 hour", "10 minutes")
    got = drain(counts, "windows", spark, tmp_path / "cw")
    assert ("a", 2) in rows(got, "key", "n")
    moved = states.moved_rows(stream_of(spark, tmp_path / "m", [[("k", "1")], [("k", "1")], [("k", "2")]], "key string, fingerprint string"))
    assert rows(drain(moved, "moved", spark, tmp_path / "cm"), "key", "change") == [("k", "moved"), ("k", "new")]


def test_streamed_merge_keeps_the_newest(spark, tmp_path):
    shape = "key string, gen long, v string"
    stream = stream_of(spark, tmp_path / "s", [[("a", 1, "x"), ("b", 1, "x")], [("a", 2, "y")], [("a", 1, "late")]], shape)
    query = states.merge_batches(stream, f"{tmp_path}/out", "key", "gen", f"{tmp_path}/ck").trigger(availableNow=True).start()
    query.awaitTermination(120)
    final = states.merged(spark, f"{tmp_path}/out", shape)
    assert rows(final, "key", "gen", "v") == [("a", 2, "y"), ("b", 1, "x")]
    touched = {p.name: sum(v.is_dir() for v in p.iterdir()) for p in (tmp_path / "out").iterdir()}
    assert sorted(touched.values()) == [1, 3]  # the bucket of b was written once
    assert states.merged(spark, f"{tmp_path}/none", shape).count() == 0


def test_consensus_without_the_full_matrix(spark):
    votes = [(u, c, v) for u, c, v in [(1, 1, 1), (2, 1, 1), (3, 1, -1), (1, 2, 1), (4, 2, 1), (2, 3, -1), (5, 3, -1), (5, 4, 0)]]
    frame = spark.createDataFrame(votes, "user_id long, comment_id long, vote long")
    labels = spark.createDataFrame([(u, u % 2) for u in range(1, 7)], "user_id long, cluster long")
    full = opinions.imputed(frame).join(labels, "user_id").groupBy("cluster", "comment_id").agg(F.count_if(F.col("value") == 1).alias("agree"), F.count_if(F.col("value") == -1).alias("disagree"), F.count("value").alias("seen"))
    columns = ["cluster", "comment_id", "agree", "disagree", "seen"]
    assert rows(opinions.consensus(frame, labels)[0], *columns) == rows(full, *columns)


def test_phrase_alerts_inside_words_and_across_them(spark):
    alerts = spark.createDataFrame([(1, ["zoning map", "map"]), (2, ["new zoning map"]), (3, ["ning"]), (4, ["", "Zoning"])], "alert_id long, keywords array<string>")
    items = spark.createDataFrame([(1, "rezoning maps"), (2, "a new zoning mapping"), (3, "nothing here")], "item long, text string")
    got = rows(search.phrase_alerts(alerts, items, "item", "text"), "alert_id", "item", "keyword")
    assert got == [(1, 1, "zoning map"), (1, 2, "zoning map"), (2, 2, "new zoning map"), (3, 1, "ning"), (3, 2, "ning")]
