"""Operators 9 and 10 and the pipeline against brute force and on odd inputs."""

import itertools
import random
import zlib

import numpy as np
import pytest

import corpus_pipeline
from plenum.llm import edits, line_dedup, near, packing, sketch


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def test_edit_similarity_of_many_pairs():
    rng = random.Random(1)
    pairs = []
    for k in range(900):
        a = "".join(rng.choice("abcé ") for _ in range(rng.choice([0, 1, 3, 20, 63, 64, 65, 130, 200]) if k < 890 else 1500))
        b = list(a)
        for _ in range(rng.randint(0, max(1, len(a) // 3))):
            if b and rng.random() < 0.5:
                b.pop(rng.randrange(len(b)))
            else:
                b.insert(rng.randint(0, len(b)), rng.choice("abx é"))
        pairs.append((a, "".join(b)))
    got = edits.alike(pairs, 0.8)
    want = [levenshtein(a, b) <= 0.2 * max(len(a), len(b)) + 1e-9 for a, b in pairs]
    assert got.tolist() == want and 200 < sum(want) < 800
    whole = [x for x in (edits.trimmed(a, b) for a, b in pairs) if all(x)]
    whole.sort(key=lambda x: -len(x[1]))
    assert edits.batch_distances(whole, np.full(len(whole), 10**6)).tolist() == [levenshtein(a, b) for a, b in whole]
    for a, b in pairs[:300]:
        assert edits.words_cost(a.split(" "), b.split(" "), 10**6) >= levenshtein(a, b)


def test_letters_and_sizes_rule_out_no_alike_pair():
    """Pairs that are not asked for their lengths or letters are not alike; very long lines go with the others."""
    rng = random.Random(5)
    lines = ["".join(rng.choice("abcé 日\u0141") for _ in range(rng.choice([0, 1, 5, 40, 300]))) for _ in range(60)]
    lines += ["".join(c if rng.random() > 0.15 else rng.choice(" xyz") for c in x)[rng.randint(0, 3) :] for x in lines]
    pairs = list(itertools.combinations(range(len(lines)), 2))
    a, b = np.array(pairs).T
    want = edits.alike([(lines[i], lines[j]) for i, j in pairs], 0.8)
    out = edits.too_unlike(edits.letter_counts(lines), a, b, 0.8)
    sizes = np.array([len(x) for x in lines])
    assert not (out & want).any() and out.mean() > 0.5 and near.sizes_fit(sizes[a], sizes[b], 0.8)[want].all()
    asked = []

    def check(some):
        asked.extend(some)
        return edits.alike([(lines[i], lines[j]) for i, j in some], 0.8)

    marks, bands = np.zeros(len(lines), np.uint64), np.zeros((len(lines), 1), np.uint32)
    found = [near.links_of(marks, bands, [(0, len(lines), 0)], check, *rest) for rest in ((), (sizes, 0.8))]
    labels = [np.arange(len(lines)) for _ in found]
    for label, links in zip(labels, found):
        for i, j in links:
            label[label == max(label[i], label[j])] = min(label[i], label[j])
    assert (labels[0] == labels[1]).all() and len(set(labels[0].tolist())) < len(lines)
    long = [("".join(rng.choice("ab") for _ in range(n)), "".join(rng.choice("ab") for _ in range(2200))) for n in (1, 64, 65, 2100)]
    assert edits.batch_distances(long, np.full(4, 10**6)).tolist() == [edits.one_distance(*x, 10**6) for x in long]


def test_distances_within_limits():
    """Lanes do only the columns that a way within the limit takes; at or under it the distance is exact, else it is over."""
    rng = random.Random(11)
    pairs = []
    for _ in range(600):
        a = [rng.choice("abcdé ") for _ in range(rng.choice([1, 30, 63, 64, 65, 128, 200, 400]))]
        b = list(a)
        for _ in range(rng.randint(0, max(1, len(a) // rng.choice([2, 4, 8])))):
            i, n = rng.randrange(len(b) + 1), rng.choice([1, 1, 1, 25])
            b[i : i + rng.choice([0, n])] = rng.choices("abcdé ", k=rng.choice([0, 1, n]))
        pairs.append(("".join(a), "".join(b) or "x"))
    want = np.array([edits.one_distance(a, b, 10**9) for a, b in pairs])
    for share in (0, 0.05, 0.2, 0.5, 10**6):
        limits = np.array([share * max(len(a), len(b)) + 1e-9 for a, b in pairs])
        got = edits.batch_distances(pairs, limits)
        assert np.where(want <= limits, got == want, got > limits).all(), share


def test_alike_members_are_asked_little():
    """Near copies cost two checks each, not one with each of eight neighbours."""
    rng = random.Random(12)
    marks = np.array([sum(1 << b for b in rng.sample(range(64), 4)) for _ in range(200)], np.uint64)
    asked = []
    links = near.links_of(marks, np.zeros((200, 1), np.uint32), [(0, 200, 0)], lambda pairs: np.array([asked.append(p) is None for p in pairs]))
    assert len(links) == 199 and len(asked) <= 2 * 200


def test_runs_are_packed_as_they_are():
    values = np.arange(9, dtype="<u4")
    assert near.packed_runs(values, np.array([0, 2, 3]), np.array([2, 3, 9])).to_pylist() == [values[a:b].tobytes() for a, b in ((0, 2), (2, 3), (3, 9))]
    assert near.packed_runs(values[:0], np.zeros(0, np.int64), np.zeros(0, np.int64)).to_pylist() == []


def test_spots_lead_to_the_lines(spark):
    texts = ["é one\r\n\n 日本 two \nthree", "a\x0bb", "\n\nA b", "one\na b\nA, b"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = line_dedup.corpus_lines(docs.coalesce(1)).cache()
    places = rows.select("doc_id", "body", "spot", rows.doc_id.alias("name"))
    found = {(r["name"], r["spot"] & (1 << 31) - 1): bytes(r["line"]).decode() for r in line_dedup.lines_at(docs, places).collect()}
    assert found == {(i, k): line for i, text in enumerate(texts) for k, line in enumerate(text.split("\n")) if line.strip()}
    assert rows.where("bands is null").count() == 3  # equal lines of one batch
    assert line_dedup.first_places(rows).where("node is not null").count() == 5


def test_words_and_marks_of_texts():
    texts = [b"A  b,c\n\n x ", b"", b"\n\nq" + b" w" * 700, "é 日本".encode()]
    words = sketch.split_words(texts, line_dedup.FOLD)
    found = [words.data[a:b].tobytes() for a, b in zip(words.start, words.end)]
    assert found == [b"a", b"b", b"c", b"x", b"q", *[b"w"] * 700, "é".encode(), "日本".encode()]
    assert words.line.tolist() == [0, 0, 0, 2, *[6] * 701, 7, 7] and words.first_line.tolist() == [0, 3, 4, 7]
    rng = np.random.default_rng(2)
    counts = rng.choice([1, 5, 9, 255, 256, 700], 60)
    hashes = rng.integers(0, 2**64, counts.sum(), dtype=np.uint64)
    got, at = sketch.marks_of(hashes, counts), 0
    for n, mark in zip(counts.tolist(), got.tolist()):
        mine = hashes[at : at + n].tolist()
        at += n
        assert mark == sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in mine) > n)


def test_parts_of_marks():
    rng = random.Random(3)
    marks = [rng.getrandbits(64) for _ in range(6)]
    marks += [m ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 14))) for m in marks for _ in range(40)]
    label = near.close_parts(np.array(marks, np.uint64), 8)
    root = list(range(len(marks)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, j in itertools.combinations(range(len(marks)), 2):
        if (marks[i] ^ marks[j]).bit_count() <= 8:
            root[max(find(i), find(j))] = min(find(i), find(j))
    pairs = {(i, j) for i, j in itertools.combinations(range(len(marks)), 2) if find(i) == find(j)}
    assert pairs == {(i, j) for i, j in itertools.combinations(range(len(marks)), 2) if label[i] == label[j]}


@pytest.mark.parametrize("size", [2, 30, 700])
def test_exploring_a_set_connects_what_alike_pairs_connect(size):
    """Members are alike by a rule that the marks don't know; the search finds the same groups as all pairs."""
    rng = random.Random(size)
    base = rng.getrandbits(64)
    marks = np.array([base ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 9))) for _ in range(size)], np.uint64)
    kind = [rng.choice("aaaaaabbc" if size > 2 else "a") for _ in range(size)]
    bands = np.array([[rng.choice([1, 2]), 7] for _ in range(size)], np.uint32)
    asked = 0

    def check(pairs):
        nonlocal asked
        asked += len(pairs)
        return np.array([kind[i] == kind[j] for i, j in pairs], bool)

    links = near.links_of(marks, bands, [(0, size, 0)], check)
    label = list(range(size))
    for i, j in links:
        a, b = label[i], label[j]
        label = [min(a, b) if x == max(a, b) else x for x in label]
    assert len(set(label)) == len(set(kind)) and all((label[i] == label[j]) == (kind[i] == kind[j]) for i in range(size) for j in range(i))
    assert asked <= 1 + 20 * size + sum(kind.count(a) * kind.count(b) for a, b in itertools.combinations("abc", 2))
    second = near.links_of(marks, bands, [(0, size, 1)], check)
    assert all(bands[i, 0] != bands[j, 0] or size > near.BLOCK for i, j in second)


def plain_gone(docs):
    """Removed (doc_id, line) pairs by edit similarity of all pairs of distinct normalised lines."""
    nodes = {}
    for name, text in sorted(docs, key=lambda d: (d[0] is None, d[0] or 0)):
        for i, line in enumerate((text or "").split("\n")):
            if key := line_dedup.normal(line):
                nodes.setdefault(key, []).append((name, i))
    keys = list(nodes)
    root = list(range(len(keys)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    pairs = list(itertools.combinations(range(len(keys)), 2))
    for (i, j), same in zip(pairs, edits.alike([(keys[i], keys[j]) for i, j in pairs], 0.8).tolist()):
        if same:
            a, b = find(i), find(j)
            root[max(a, b)] = min(a, b)
    groups = {}
    for i, k in enumerate(keys):
        groups.setdefault(find(i), []).extend(nodes[k])
    order = lambda p: (p[0] is None, p[0] or 0, p[1])
    return {p for places in groups.values() for p in sorted(places, key=order)[1:]}


def line_docs(seed=4):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghijklm") for _ in range(rng.randint(2, 8)))
    shared = [" ".join(word() for _ in range(rng.randint(1, 60))) for _ in range(12)]
    docs = []
    for i in range(60):
        lines = []
        for _ in range(rng.randint(0, 6)):
            line = rng.choice(shared) if rng.random() < 0.5 else " ".join(word() for _ in range(rng.randint(3, 30)))
            if rng.random() < 0.4:
                words = line.split()
                words[rng.randrange(len(words))] += rng.choice("xyz.,!")
                line = " ".join(words).capitalize()
            lines.append(line)
        docs.append((i, "\n".join(lines)))
    return docs


def test_line_dedup_against_all_pairs(spark):
    docs = [*line_docs(), (70, None), (71, ""), (72, "\n\n"), (None, line_docs()[3][1] + "\na line with no other like it anywhere")]
    frame = spark.createDataFrame([(*d, "a", 1, 2) for d in docs], "doc_id long, text string, component string, mark int, n_removed int")
    want = plain_gone(docs)
    got = {r["doc_id"]: r for r in line_dedup.dedup_lines(frame).collect()}
    assert len(got) == len(docs) and len(want) > 40
    for name, text in docs:
        lines = (text or "").split("\n")
        left = [x for i, x in enumerate(lines) if (name, i) not in want]
        assert got[name]["text"] == (None if text is None else "\n".join(left)), name
        counts = got[name]["line_counts"]
        assert counts["n_removed"] == len(lines) - len(left) and counts["n_lines"] == (0 if text is None else len(lines))
        assert (got[name]["component"], got[name]["mark"], got[name]["n_removed"]) == ("a", 1, 2)
    assert line_dedup.op9(frame).columns == ["doc_id", "n_lines", "n_removed", "n_chars_left", "kept_sha256"]
    assert line_dedup.op9(frame.limit(0)).count() == 0
    assert line_dedup.dedup_lines(frame.withColumnRenamed("mark", "line_counts")).columns == ["doc_id", "text", "component", "n_removed", "line_counts"]


def test_line_dedup_of_the_table_against_all_pairs(spark, sf_dir):
    """The lines of the small table, by edit similarity alone: nothing goes that shouldn't, hardly anything stays that should go."""
    docs = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    want = plain_gone(docs)
    left = {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    gone = set()
    for name, text in docs:
        rest = iter(left[name].split("\n") if left[name] or text == "" else [])
        now = next(rest, None)
        for i, line in enumerate(text.split("\n")):
            if now is not None and line == now and (name, i) not in want:
                now = next(rest, None)
            elif now is not None and line == now:
                now = next(rest, None)  # should have gone
            else:
                gone.add((name, i))
    assert gone <= want and len(gone) >= 0.98 * len(want)


def test_alike_lines_become_candidates():
    """Recall on planted copies that edit similarity alone calls alike: buckets and radius must not lose them."""
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 9)))
    pairs = {"one": [], "fifth": []}
    for _ in range(1500):
        words = [word() for _ in range(rng.randint(5, 80))]
        for kind, n in (("one", 1), ("fifth", max(1, len(words) // 5))):
            other = list(words)
            for i in rng.sample(range(len(words)), n):
                other[i] = word()
            pairs[kind].append((" ".join(words), " ".join(other)))
    for kind, least in (("one", 0.97), ("fifth", 0.9)):
        chosen = [p for p, same in zip(pairs[kind], edits.alike(pairs[kind], 0.8)) if same]
        hashes, weights, counts, _ = sketch.word_features(sketch.split_words([x.encode() for pair in chosen for x in pair], line_dedup.FOLD))
        bands, marks = sketch.bands_of(hashes, weights, counts), sketch.marks_of(hashes, counts)
        met = (bands[::2] == bands[1::2]).any(axis=1) & (np.bitwise_count(marks[::2] ^ marks[1::2]) <= sketch.RADIUS)
        assert len(met) > 800 and met.mean() >= least, (kind, met.mean())


def test_lines_with_one_word_replaced_go(spark):
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(3, 7)))
    rows = []
    for i in range(200):
        words = [word() for _ in range(rng.randint(8, 40))]
        rows.append((i, " ".join(words)))
        words[rng.randrange(len(words))] = word()
        rows.append((1000 + i, " ".join(words)))
    done = line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).where("line_counts.n_removed = 1").collect()
    assert len(done) >= 190 and all(r["doc_id"] >= 1000 for r in done)


def test_short_and_unspaced_lines_go(spark):
    unspaced = "日本語の長い段落は空白を含まないのでひとつの語とされるが文字の並びで比べられる" * 4
    rows = [(1, f"Read more\n{unspaced}\n--\nOk"), (2, f"read  more!\n{unspaced.replace('空白', '余白', 1)}\n--\nonly here"), (3, "Something else\n\n"), (4, "\u001c x\n\u001c x")]
    got = {r["doc_id"]: r for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [got[i]["text"] for i in (1, 2, 3, 4)] == [rows[0][1], "--\nonly here", "Something else\n\n", "\u001c x"]
    assert [tuple(got[i]["line_counts"])[1:] for i in (1, 2, 3, 4)] == [(0, 3), (2, 1), (0, 1), (1, 1)]


def test_rows_that_share_an_id_are_different_documents(spark):
    line = "the same line stands in several documents of the table"
    rows = [(1, line), (None, line + "\nsecond of its kind"), (None, "first words of a text without an id\nlast words of it"), (7, line + "\nx y z"), (7, "unlike the other one\nof this id"), (7, line + "\nx y z")]
    got = line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    texts = sorted((str(r["doc_id"]), r["text"]) for r in got)
    assert texts == sorted([("1", line), ("None", "second of its kind"), ("None", rows[2][1]), ("7", "x y z"), ("7", "x y z"), ("7", rows[4][1])])


@pytest.mark.parametrize("seed", range(6))
def test_bins_hold_everything(seed):
    rng = random.Random(seed)
    counts = {}
    for _ in range(rng.choice([0, 1, 50, 3000])):
        n = min(2048, max(1, int(rng.lognormvariate(5, 1.3))))
        counts[n] = counts.get(n, 0) + 1
    bins = packing.best_two_fit(counts)
    used = {}
    for lengths, times in bins:
        assert sum(lengths) <= 2048 and times > 0
        for n in lengths:
            used[n] = used.get(n, 0) + times
    assert used == counts
    total = sum(n * c for n, c in counts.items())
    assert sum(t for _, t in bins) <= 1.02 * -(-total // 2048) + 1


def test_the_smallest_gives_way_to_a_tighter_pair():
    bins = packing.best_two_fit({60: 1, 30: 1, 21: 1, 19: 1}, 100)
    assert (60, 21, 19) in [tuple(b) for b, _ in bins]
    assert packing.Stock({5: 2, 3: 1}).tightest_pair(10) == (5, 5)
    assert packing.Stock({5: 1, 3: 1}).tightest_pair(7) == (0, 0)
    assert packing.Stock({}).tightest_pair(7) == (0, 0)


def test_tightest_pair_by_brute_force():
    rng = random.Random(8)
    for _ in range(300):
        counts = {}
        for _ in range(rng.randint(0, 9)):
            n = rng.randint(1, 20)
            counts[n] = counts.get(n, 0) + 1
        gap = rng.randint(0, 40)
        pieces = [n for n, c in counts.items() for _ in range(c)]
        best = max((a + b for a, b in itertools.combinations(pieces, 2) if a + b <= gap), default=0)
        assert sum(packing.Stock(counts).tightest_pair(gap)) == best


def test_packing(spark, monkeypatch):
    tokenizers = pytest.importorskip("tokenizers")
    import public_tokenizers

    monkeypatch.setattr(packing, "BUCKET_ROWS", 7)
    path = public_tokenizers.path("word_bpe_49k.json")
    plain = tokenizers.Tokenizer.from_file(path)
    texts = [None, "", " \n", "A <|endoftext|> b", "it's one two\x1cthree  don't\tÉCOLE Σίσυφος ΟΔΟΣ", "é ́x", "naïve " * 3000, "x" * 9000, "日本 語", "\r\nline\r\n", "tail "] + ["some words here %d" % i for i in range(40)]
    rows = [(i, t, 0, 0) for i, t in enumerate(texts)] + [(3, texts[3], 0, 0), (None, "no id", 0, 0)]
    got = packing.op10(spark.createDataFrame(rows, "doc_id long, text string, length int, rank int")).collect()
    pieces = []
    for i, t, *_ in rows:
        ids = [*plain.encode(t or "", add_special_tokens=False).ids, 0]
        for n, at in enumerate(range(0, len(ids), 2048)):
            part = ids[at : at + 2048]
            pieces.append((str(i), n, at, len(part), zlib.crc32(np.array(part, "<u4").tobytes())))
    assert sorted((str(r["doc_id"]), r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == sorted(pieces)
    sequences = {}
    for r in got:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in sequences.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= 2048
    assert packing.op10(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_stages_on_their_own_inputs(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, before = docs.columns, docs
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, before, sf_dir)
        out.write.parquet(f"{tmp_path}/{name}")
        after = spark.read.parquet(f"{tmp_path}/{name}")
        if name != "sequences":
            assert after.columns == columns and 0 < after.count()
        if name in ("quality", "near_duplicates"):
            assert after.exceptAll(before).count() == 0  # rows as they were
        if name == "quality":
            assert after.count() < before.count()
        if name == "quality":
            clean = spark.read.parquet(f"{sf_dir}/labels.parquet").where("quality = 1").join(before, "doc_id")
            assert clean.join(after, "doc_id", "left_anti").count() <= 0.05 * clean.count()
        if name == "mix":
            times = after.groupBy("doc_id").count().agg({"count": "max"}).first()[0]
            assert times <= 2
        if name == "sequences":
            assert {r["doc_id"] for r in after.select("doc_id").collect()} == {r["doc_id"] for r in before.select("doc_id").collect()}
        before = after
    assert corpus_pipeline.ORACLE_SQL is None
    whole = corpus_pipeline.run(spark, sf_dir)
    key = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert sorted(map(str, whole.select(*key).collect())) == sorted(map(str, before.select(*key).collect()))


def test_lines_stage_keeps_documents_with_text_left(spark, sf_dir):
    shape = spark.read.parquet(f"{sf_dir}/documents.parquet").schema
    license = "All rights reserved by the city of nowhere"
    texts = [f"{license}\nfirst of its kind", f"short\n{license}\nlines only", f"{license}\n--", "日本語の段落\n" + license]
    docs = spark.createDataFrame([(i, x, "en", "s", len(x)) for i, x in enumerate(texts)], shape)
    left = {r["doc_id"]: (r["text"], r["n_chars"]) for r in dict(corpus_pipeline.STAGES)["lines"](spark, docs, sf_dir).collect()}
    assert left == {0: (texts[0], len(texts[0])), 1: ("short\nlines only", 16), 3: ("日本語の段落", 6)}


def test_near_duplicate_stage_on_raw_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    near = dict(corpus_pipeline.STAGES)["near_duplicates"]
    left = {r["doc_id"]: r["text"] for r in near(spark, docs, sf_dir).collect()}
    first = {}
    for r in docs.orderBy("doc_id").collect():
        first.setdefault(r["text"], r["doc_id"])
    assert len(set(left.values())) == len(left) and set(left) <= set(first.values())
    assert len(first) - len(left) <= 0.05 * len(first)


def test_stages_on_empty_and_null_rows(spark, sf_dir):
    shape = spark.read.parquet(f"{sf_dir}/documents.parquet").schema
    for rows in ([], [(None, None, None, None, None), (1, "", "en", "s", 0)]):
        docs = spark.createDataFrame(rows, shape)
        for _, stage in corpus_pipeline.STAGES:
            assert stage(spark, docs, sf_dir).count() <= max(1, len(rows))
