"""Operators 4 to 6 against brute force and on odd inputs."""

import collections
import random
import re

import duckdb
import pytest

from plenum.llm import decision_list, mixing, token_counts
from plenum.llm.oracles import MIXING

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LONG = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega".split()


def base(text):
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    runs = collections.Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    inside = {j for i in range(len(words) - 7) if runs[tuple(words[i : i + 8])] > 1 for j in range(i, i + 8)}
    failed = len(words) < 20 or 100 * len(inside) > 30 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(inside), failed


def odd_texts():
    rng = random.Random(5)
    phrase = " ".join(rng.choice(LONG) for _ in range(9))
    return [
        None, "", " \n\t\x0b\f\r ", "one", "a b \x1c c d", "x " * 7, "x " * 8, "x " * 9, "# * $ | < > & %", "same\nsame\n\n \nsame", "é" * 30 + " ß",
        phrase + " " + phrase, " ".join(rng.choice(LONG) for _ in range(400)), "\r\n".join([phrase] * 4), ("y " * 40000), phrase + " z " + phrase[:40] + " " + phrase,
    ]


def test_base_statistics(spark):
    rows = [(i, t, i, True) for i, t in enumerate(odd_texts())]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_words int, kept boolean")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in decision_list.op4(docs, labels).collect()}
    for i, t, *_ in rows:
        r = got[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) == base(t), (i, t and t[:60])
        assert r["kept"] == (not r["base_failed"])
    assert decision_list.op4(docs.limit(0), labels).count() == 0


def corpus(n=400, seed=1):
    rng = random.Random(seed)
    docs, labels = [], []
    for i in range(n):
        words = [rng.choice(LONG) + rng.choice(LONG)[:3] for _ in range(rng.randint(60, 200))]
        bad = i % 5 == 0
        if bad:
            words = [w + rng.choice(["***", "###", "&&&"]) for w in words] if i % 2 else [w.upper() + "!!" for w in words]
        docs.append((i, " ".join(words)))
        if i < 3 * n // 4:
            labels.append((i, int(not bad), 0))
    return docs, labels


def test_rules_learned_and_held_out(spark):
    docs, labels = corpus()
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    marks = spark.createDataFrame([*labels, (None, 1, 0), (3, None, None), (99999, 0, 0)], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r["kept"] for r in decision_list.op4(frame, marks).collect()}
    held = [i for i, _ in docs if i >= 300]
    right = sum(got[i] == (i % 5 != 0) for i in held)
    assert right >= 0.97 * len(held)


def test_covering_prefers_the_plain_rule():
    rng = random.Random(2)
    rows = [{**{f: rng.random() for f in decision_list.FEATURES}, "quality": 1} for _ in range(300)]
    for r in rows[:90]:
        r["symbol_rate"], r["quality"] = 2 + rng.random(), 0
    rules = decision_list.learn(rows)
    assert rules and all(all(c.holds(r) for c in rules[0]) for r in rows[:90]) and not any(all(c.holds(r) for c in rules[0]) for r in rows[90:])
    assert decision_list.learn([]) == [] and decision_list.learn([r for r in rows if r["quality"]]) == []


def test_extra_columns_stay(spark):
    docs, labels = corpus(60)
    frame = spark.createDataFrame([(i, t, "s", 1) for i, t in docs], "doc_id long, text string, source string, quality int")
    out = decision_list.judged(frame, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    assert out.columns[:4] == ["doc_id", "text", "source", "quality"] and out.count() == 60


def mixing_rows(seed=3):
    rng = random.Random(seed)
    rows = [(i, rng.choice(["a", "b", "é", "Z", "z", None, ""]) if i % 3 else "hot", " ".join(["w"] * rng.randint(0, 40)) if i % 17 else None) for i in range(600)]
    return rows + rows[:5] + [(None, "a", "x y z"), (None, None, "x"), (700, "void", None), (701, "tiny", "one two")]


def test_mixing_against_sql_and_budgets(spark, monkeypatch):
    monkeypatch.setattr(mixing, "SLICE_ROWS", 20)
    rows = mixing_rows()
    got = mixing.op5(spark.createDataFrame([(*r, 9, 9) for r in rows], "doc_id long, source string, text string, size int, offset int")).toPandas()
    con = duckdb.connect()
    import pandas as pd

    documents = pd.DataFrame(rows, columns=["doc_id", "source", "text"]).astype({"doc_id": "Int64"})  # noqa: F841  read by DuckDB
    want = con.execute(MIXING).df()
    key = lambda df: sorted((str(a), int(b), int(c), float(d), int(e)) for a, b, c, d, e in df.astype({"doc_id": "Int64"}).itertuples(index=False))
    assert key(got) == key(want)
    assert (got["taken"] <= 2 * got["size"]).all()
    sizes, targets = {}, {}
    for d, s, t in rows:
        sizes[s] = sizes.get(s, 0) + len(WORD.findall(t or ""))
    for s, n in sizes.items():
        targets[s] = got[got["source_size"] == n]["target"].iloc[0]
    assert abs(sum(targets.values()) - 1.5 * sum(sizes.values())) < 1e-6
    taken = {}
    where = {(d, len(WORD.findall(t or ""))): s for d, s, t in rows}
    for r in got.astype({"doc_id": "object"}).itertuples():
        s = where[(None if pd.isna(r.doc_id) else int(r.doc_id), r.size)] if not pd.isna(r.doc_id) else ("a" if r.size == 3 else None)
        taken[s] = taken.get(s, 0) + r.taken
    assert all(abs(taken[s] - targets[s]) <= 1 for s in sizes)


def test_mixing_reruns_agree_and_mix_repeats_rows(spark):
    docs = spark.createDataFrame(mixing_rows(), "doc_id long, source string, text string").repartition(7)
    one, two = (sorted(map(str, mixing.op5(d).collect())) for d in (docs, docs.repartition(3)))
    assert one == two
    mixed = mixing.mixed(docs.where("doc_id is not null").dropDuplicates(["doc_id"]))
    assert mixed.columns == docs.columns
    most = mixed.groupBy("doc_id").count().agg({"count": "max"}).first()[0]
    assert most == 2
    assert mixing.op5(docs.limit(0)).count() == 0


@pytest.fixture(scope="module")
def model():
    path = pytest.importorskip("public_tokenizers").path("piece_bpe_32k.model")
    return path, token_counts.sentencepiece_model(path)


def test_token_counts(spark, model):
    path, sp = model
    texts = [*odd_texts(), "<s> </s> <unk> ▁ \x00 x", "日本語 テキスト", "a  b   c", " lead", "trail ", ("word " * 9000).strip(), "a b" * 20000, "é ü " * 10000]
    rows = [(i, t, 1) for i, t in enumerate(texts)] + [(None, "a b", 1), (0, None, 1)]
    got = token_counts.op6(spark.createDataFrame(rows, "doc_id long, text string, n_tokens int")).collect()
    assert sorted((str(r["doc_id"]), r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in got) == sorted((str(i), len((t or "").encode()), len(sp.encode(t or "")), len(sp.encode(t or "")) > 4096) for i, t, _ in rows)
    assert token_counts.op6(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_parts_are_safe(model):
    path, sp = model
    rng = random.Random(7)
    text = " ".join(rng.choice(LONG) + rng.choice(["", "é", ".", "  ", "7"]) for _ in range(6000))
    parts = token_counts.parts(text, 500)
    assert len(parts) > 20 and sum(len(sp.encode(p)) for p in parts) == len(sp.encode(text))
    assert token_counts.splittable(path)


def test_keep_leaves_clashing_columns_alone(spark):
    text = " ".join(f"word{i}" for i in range(40))
    docs = spark.createDataFrame([(1, text, "mine", 7, 5), (2, "too short", "mine", 7, 5)], "doc_id long, text string, rule string, n_words int, kept int")
    labels = spark.createDataFrame([], "doc_id long, quality int")
    kept = decision_list.keep(docs, labels)
    assert kept.columns == docs.columns and [tuple(r) for r in kept.collect()] == [(1, text, "mine", 7, 5)]


def test_mixed_takes_of_repeated_rows_what_the_mix_says(spark):
    rows = [(1, "a b c d e", "s")] * 8 + [(1, "v w x y z", "s"), (None, "k l m n o", "s"), (None, "k l m n q", None), (2, "", "s"), (3, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    taken = mixing.shares(docs, split_last=False).agg({"taken": "sum"}).first()[0]
    out = mixing.mixed(docs).collect()
    assert sum(len(r["text"].split()) for r in out) == taken > 0
    assert all(sum(r["text"] == t for r in out) <= 2 * sum(x[1] == t for x in rows) for t in {r["text"] for r in out})
