"""The stored full-text index, the commit log and the claim queue."""

import datetime as dt
import itertools
import json
import math
import random
import re
import subprocess
import sys
import threading

import pytest
from pyspark.sql import functions as F

from plenum.operators import claims, search, textindex
from plenum.sources.commits import CommitLog

WORDS = "park parks zoning zoned street streets council the of and water waters bridge budget".split()


def corpus(n=120, seed=3):
    rng = random.Random(seed)
    docs = [(i, " ".join(rng.choice(WORDS) + rng.choice(["", "", ",", "."]) for _ in range(rng.randint(0, 60)))) for i in range(n)]
    return [*docs, (500, None), (501, ""), (502, "Park park PARK; zoning"), (503, "zoning " + "the " * 400 + "park")]


def by_hand(docs, query):
    """All covers found by trying every pair of places."""
    wanted = textindex.stems(query)
    out = []
    for name, text in docs:
        words = re.findall(r"[^\W_]+", (text or "").lower())
        terms = [None if w in search.STOP_WORDS else textindex.stem_of(w) for w in words]
        if not wanted or not set(wanted) <= set(terms):
            continue
        holds = lambda a, b, terms=terms: set(wanted) <= set(terms[a : b + 1])
        places = [i for i, t in enumerate(terms) if t in wanted]
        covers = [(a, b) for a, b in itertools.combinations_with_replacement(places, 2) if holds(a, b) and not holds(a + 1, b) and not holds(a, b - 1)]
        score = sum(len(wanted) / (b - a + 1) for a, b in covers) / (1 + math.log(len(words)))
        out.append((name, round(score, 9)))
    return sorted(out, key=lambda x: (-x[1], x[0]))


def ranked(index, query):
    rows = index.ranked(query).orderBy(F.desc(F.round("score", 9)), "id").collect()
    return [(r["id"], round(r["score"], 9)) for r in rows]


def test_rank_equals_brute_force(spark, tmp_path):
    docs = corpus()
    index = textindex.TextIndex(spark, f"file://{tmp_path}/index")
    assert ranked(index, "park") == []
    index.add(spark.createDataFrame(docs, "id long, text string"), "id", "text")
    for query in ["park", "parks zoning", "the street of water", "bridge budget council", "park nothing", "the of", ""]:
        assert ranked(index, query) == by_hand(docs, query), query


def test_segments_replace_remove_and_compact(spark, tmp_path):
    docs = dict(corpus())
    index = textindex.TextIndex(spark, str(tmp_path / "index"))
    index.add(spark.createDataFrame(list(docs.items()), "key long, text string"), "key", "text")
    changed = {i: f"park zoning number {i}" for i in range(0, 120, 7)} | {900: "a park for zoning"}
    index.add(spark.createDataFrame(list(changed.items()), "key long, text string"), "key", "text")
    index.remove(spark.createDataFrame([(1,), (7,), (7,), (4444,)], "key long"), "key")
    docs |= changed
    docs.pop(1), docs.pop(7)
    assert ranked(index, "park zoning") == by_hand(docs.items(), "park zoning")
    index.compact()
    assert ranked(index, "park zoning") == by_hand(docs.items(), "park zoning")
    assert len(index._segments(index.log.entries())) == 1
    index.add(spark.createDataFrame([(1, "zoning park again")], "key long, text string"), "key", "text")
    docs[1] = "zoning park again"
    assert ranked(index, "park zoning") == by_hand(docs.items(), "park zoning")


def test_search_reads_only_its_terms(spark, tmp_path, capsys):
    index = textindex.TextIndex(spark, str(tmp_path / "index"))
    index.add(spark.createDataFrame(corpus(), "id long, text string"), "id", "text")
    index.ranked("zoning").explain("formatted")
    plan = capsys.readouterr().out
    bucket = spark.range(1).select(textindex.bucket_of(F.lit("zon"))).first()[0]
    assert re.search(rf"PartitionFilters: \[.*bucket.*{bucket}", plan) and re.search(r"PushedFilters: \[.*EqualTo\(term,zon\)|PushedFilters: \[.*In\(term", plan)


def test_fragments():
    text = " ".join(["lead"] * 100 + ["park", "x", "zoning"] + ["gap"] * 80 + ["parks"] + ["tail"] * 5)
    got = textindex.fragment(text, ["park", "zon"])
    assert got.startswith("<mark>park</mark> x <mark>zoning</mark> gap") and len(got.split()) == 30
    assert textindex.fragment("park " * 200, ["park"]).count("<mark>") == 60
    assert textindex.fragment("a b (Parks)", ["park"]) == "a b (<mark>Parks</mark>)"
    assert textindex.fragment("no hit " * 40, ["park"]) == " ".join(("no hit " * 40).split()[:30])
    assert textindex.fragment(None, ["park"]) is None and textindex.fragment("", ["park"]) == ""


def test_page_of_results(spark, tmp_path):
    docs = spark.createDataFrame(corpus(), "id long, text string").withColumnRenamed("id", "doc")
    index = textindex.TextIndex(spark, str(tmp_path / "index"))
    index.add(docs, "doc", "text")
    page = textindex.search(index, docs, "doc", "text", "park zoning", limit=5).collect()
    assert [r["doc"] for r in sorted(page, key=lambda r: (-r["score"], r["doc"]))] == [i for i, _ in by_hand(corpus(), "park zoning")[:5]]
    assert all("<mark>" in r["fragment"] for r in page)


def test_a_number_is_taken_once(spark, tmp_path):
    logs = [CommitLog(spark, f"file://{tmp_path}/log") for _ in range(4)]
    won = []

    def run(log, who):
        for v in range(25):
            if log.commit(v, {"who": who}):
                won.append((v, who))

    threads = [threading.Thread(target=run, args=(log, i)) for i, log in enumerate(logs)]
    [t.start() for t in threads], [t.join() for t in threads]
    assert sorted(v for v, _ in won) == list(range(25)) == logs[0].versions()
    assert all(logs[0].read(v) == {"who": who} for v, who in won)
    assert logs[0].latest() == 24 and not list(tmp_path.glob("log/.*tmp"))


T0 = dt.datetime(2024, 5, 1, 12)


def test_claims_in_turn(spark, tmp_path):
    queue = claims.ClaimQueue(spark, str(tmp_path / "q"), most_attempts=2, snapshot_every=3)
    jobs = spark.createDataFrame([(f"j{i}", i % 2) for i in range(6)], "job string, priority int")
    ids = lambda df: sorted(r["job"] for r in df.collect())
    named = lambda *names: spark.createDataFrame([(n,) for n in names], "job string")
    later = lambda s: T0 + dt.timedelta(seconds=s)
    assert ids(queue.claim(jobs, [F.desc("priority")], "a", 2, T0, 60)) == ["j1", "j3"]
    assert ids(queue.claim(jobs, [F.desc("priority")], "b", 2, T0, 60)) == ["j0", "j5"]
    assert ids(queue.finish(named("j1", "j0"), "a")) == ["j1"]  # j0 is b's
    assert ids(queue.fail(named("j5"), "b")) == ["j5"]
    assert ids(queue.claim(jobs, [F.desc("priority")], "c", 9, later(1), 60)) == ["j2", "j4", "j5"]
    assert ids(queue.claim(jobs, [F.desc("priority")], "c", 9, later(2), 60)) == []
    assert ids(queue.renew(named("j0", "j3"), "b", later(30), 60)) == ["j0"]
    assert ids(queue.claim(jobs, [F.desc("priority")], "d", 9, later(61), 60)) == ["j2", "j3", "j4"]  # j5 has had its two attempts
    assert ids(queue.finish(named("j3"), "a")) == []  # its claim ran out
    assert {r["job"]: r["status"] for r in queue.state().collect()} == {"j0": "claimed", "j1": "done", "j2": "claimed", "j3": "claimed", "j4": "claimed", "j5": "dead"}


WORKER = """
import datetime as dt, json, sys
sys.path.insert(0, sys.argv[1])
from pyspark.sql import functions as F
from plenum.session import session
from plenum.operators.claims import ClaimQueue
spark = session("worker", "local[1]", spark__sql__shuffle__partitions="1", spark__ui__enabled="false", spark__driver__memory="700m")
spark.sparkContext.setLogLevel("OFF")
queue = ClaimQueue(spark, sys.argv[2], snapshot_every=5)
jobs = spark.range(24).select(F.concat(F.lit("j"), "id").alias("job"))
mine = []
while True:
    got = queue.claim(jobs, [F.col("job")], sys.argv[3], 2, dt.datetime(2024, 5, 1), 3600)
    names = [r["job"] for r in got.collect()]
    if not names:
        break
    mine += names
    assert queue.finish(got, sys.argv[3]).count() == len(names)
print("MINE", json.dumps(mine))
"""


def test_two_processes_share_a_queue(tmp_path):
    root = __file__.rsplit("/tests/", 1)[0]
    (tmp_path / "worker.py").write_text(WORKER)
    runs = [subprocess.Popen([sys.executable, str(tmp_path / "worker.py"), root, str(tmp_path / "q"), who], stdout=subprocess.PIPE, stderr=subprocess.DEVNULL, text=True) for who in "ab"]
    mine = [json.loads(run.communicate(timeout=300)[0].rsplit("MINE", 1)[1]) for run in runs]
    assert sorted(mine[0] + mine[1]) == sorted(f"j{i}" for i in range(24))  # no job twice, none lost


def test_garbage_titles_in_order(spark):
    from plenum.functions import rules

    want = {
        "Staff Report.pdf": "filename", "Budget.XLSX ": "filename", "- Cover  Page": "cover_page", "Cover page of the plan": None, "— ": "empty_or_tiny",
        "Memorandum": "generic_label", "12/31/2024": "numeric_or_date", "r12345 7": "register_code", "OK": "empty_or_tiny", None: "empty_or_tiny", "Adopt the budget": None, "report.pdf.txt": None,
    }
    rows = spark.createDataFrame([(t,) for t in want], "t string").select("t", rules.garbage_title(F.col("t")).alias("label")).collect()
    assert {r["t"]: r["label"] for r in rows} == want


@pytest.mark.parametrize("word, stem", [("parks", "park"), ("class", "class"), ("zoning", "zon"), ("cities", "city"), ("amendments", "amendment"), ("is", "is"), ("classes", "class")])
def test_stems_on_both_sides(spark, word, stem):
    assert textindex.stem_of(word) == stem == spark.range(1).select(search.stem(F.lit(word))).first()[0]
