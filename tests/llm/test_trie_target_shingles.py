"""Operators 11 to 13 against brute force and on odd inputs."""

import hashlib
import math
import random
import re
import zlib

import duckdb
import numpy as np
import pytest

from plenum.llm import prefix_trie, shingle_join, target_sampling
from plenum.llm.oracles import RESAMPLING, SHINGLES, TRIE

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LETTERS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega".split()
TURNS = "conv_id long, turn long, role string, text string, depth string"


def key(row):
    return tuple((x is None, x) for x in row)


def by_duckdb(sql, **tables):
    con = duckdb.connect()
    for name, (rows, columns) in tables.items():
        con.execute(f"CREATE TABLE {name} ({columns})")
        if rows:
            con.executemany(f"INSERT INTO {name} VALUES ({', '.join('?' * len(rows[0]))})", rows)
    return sorted(con.execute(sql).fetchall(), key=key)


def trie_by_hand(rows):
    """Nodes of the rebuilt conversations, one by one."""
    convs = {}
    for c, turn, role, text in sorted(((c, turn, r or "", t or "") for c, turn, r, t, *_ in rows if c is not None), key=lambda x: (x[0], x[1] is not None, x[1] or 0, x[2].encode(), x[3].encode())):
        convs.setdefault(c, []).append((role, text))
    built = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 4
        built[c] = convs.get(c - int(math.fmod(c, 20)), [])[:h] + own[h:]
    members = {}
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    children = {}
    for node in members:
        if node:
            children.setdefault(node[:-1], []).append(node)

    def below(node):
        found = [node]
        for x in found:
            found += children.get(x, [])
        return found

    out = []
    for node, who in members.items():
        under = below(node)
        ends = ",".join(map(str, sorted(c for c in who if len(built[c]) == len(node))))
        saved = sum((len(members[x]) - 1) * len(WORD.findall(x[-1][1])) for x in under if x)
        leaves = sum(x not in children for x in under)
        parent = min(members[node[:-1]]) if node else None
        out.append((min(who), len(node), parent, len(who), len(children.get(node, [])), leaves, saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=key)


def odd_conversations():
    rng = random.Random(3)
    rows = []
    for c in [*range(-3, 90), 100, 119, 400, 415]:
        opening = rng.choice(["hello there", "Hello there", "good day  to you"])
        for turn in range(rng.randint(1, 5)):
            text = opening if turn == 0 else rng.choice(["yes", "no", "tell me more about it", ""])
            rows.append((c, turn if rng.random() < 0.8 else None, "user" if turn % 2 == 0 else "assistant", text, "extra"))
    rows += [(77, 1, None, None, None), (77, 1, "", "", None), (None, 0, "user", "lost", None), (None, None, None, None, None)]
    rows += [(300 + i, 0, "system", "the same\nfor all", None) for i in range(60)]  # a hot first turn
    rows += [(801, i // 3, "user", f"deep {i} " + "word " * (i % 7), None) for i in range(900)]  # a long conversation, turns in ties
    rows += [(802, i // 3, "user", f"deep {i} " + "word " * (i % 7), None) for i in range(880)]
    rows += [rows[5]] * 3 + [(900, 0, "user", "x" * 300_000, None)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("rows", [odd_conversations(), [(None, 1, "user", "x", None)], []], ids=["odd", "no id", "empty"])
def test_trie_equals_brute_force(spark, rows):
    got = prefix_trie.op11(spark.createDataFrame(rows, TURNS).repartition(5))
    assert got.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    assert sorted(map(tuple, got.collect()), key=key) == trie_by_hand(rows)


def test_trie_sql_and_given_table(spark, sf_dir):
    table = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    rows = [(r["conv_id"], r["turn"], r["role"], r["text"]) for r in table.collect()]
    got = sorted(map(tuple, prefix_trie.op11(table).collect()), key=key)
    assert got == trie_by_hand(rows) == by_duckdb(TRIE, conversations=(rows, "conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR"))


def test_hash_of_ends_in_slices(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "SLICE_IDS", 7)  # in the driver only; the workers' slices are those of their Arrow batches
    ids = list(range(5000))
    random.Random(1).shuffle(ids)
    got = prefix_trie.end_digests(spark.createDataFrame([(1, 2, i) for i in ids] + [(1, 3, -5), (1, 3, 10), (1, 3, 9)], "node_a long, node_b long, conv_id long").repartition(6))
    want = {(1, 2): ",".join(map(str, range(5000))), (1, 3): "-5,9,10"}
    assert {(r["node_a"], r["node_b"]): r["ends_sha256"] for r in got.collect()} == {k: hashlib.sha256(v.encode()).hexdigest() for k, v in want.items()}


def test_own_trie_without_shared_openings(spark):
    rows = [(1, 0, "u", "a b", None), (1, 1, "a", "c", None), (2, 0, "u", "a b", None), (2, 1, "a", "d", None), (3, 0, "u", "z", None)]
    got = {(r["depth"], r["conv_id"]): r for r in prefix_trie.conversation_trie(spark.createDataFrame(rows, TURNS)).collect()}
    assert set(got) == {(0, 1), (1, 1), (1, 3), (2, 1), (2, 2)}
    assert got[0, 1]["saved_tokens"] == 2 and got[0, 1]["n_leaves"] == 3 and got[1, 1]["n_children"] == 2


def sampled_by_hand(docs, target, percent=25):
    def features(text):
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
        return len(words), [zlib.crc32(x.encode()) % 10000 for x in [*words, *(f"{a} {b}" for a, b in zip(words, words[1:]))]]

    s, t = np.zeros(10000, int), np.zeros(10000, int)
    for text in target:
        for b in features(text)[1]:
            t[b] += 1
    made = [(i, *features(text)) for i, text, *_ in docs]
    for *_, found in made:
        for b in found:
            s[b] += 1
    big_s, big_t = int(s.sum()), int(t.sum())
    gain = [math.floor(1000 * math.log((int(t[b]) + 1) * (big_s + 10000) / ((int(s[b]) + 1) * (big_t + 10000)))) for b in range(10000)]
    rows = []
    for i, words, found in made:
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in found) // len(found) if found else 0
        rows.append((i, words, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    fit = sorted((r for r in rows if r[1] >= 20), key=lambda r: (-r[4], r[0] is None, r[0] or 0, r[3], r[2]))
    drawn = fit[: percent * len(fit) // 100]
    out = [(r[0], r[2], r[3], r[4], k + 1) for k, r in enumerate(drawn)]
    return sorted(out + [(r[0], r[2], r[3], r[4], None) for r in fit[len(drawn) :]] + [(r[0], r[2], r[3], r[4], None) for r in rows if r[1] < 20], key=key)


def odd_documents():
    rng = random.Random(9)
    text = lambda n: " ".join(rng.choice(LETTERS) + rng.choice(["", ",", "'s", "É", "42"]) for _ in range(n))
    docs = [(i, text(rng.choice([0, 1, 2, 19, 20, 21, 60])), rng.random()) for i in range(150)]
    docs += [(200, None, 0.0), (201, "", 0.0), (202, "~ ~ [ ] \x7f", 0.0), (203, "ÉÀ ß 日本語 Æ" * 30, 0.0), (None, text(30), 0.0), (None, text(40), 0.0), (None, None, 0.0)]
    docs += [docs[3]] * 4 + [(210, text(50), 0.0), (210, text(50), 0.0)]
    return docs


def test_resampling_equals_brute_force(spark):
    docs, target = odd_documents(), ["alpha beta gamma " * 9, None, "", "Delta's É alpha"]
    docs_df = spark.createDataFrame(docs, "doc_id long, text string, weight double").repartition(4)
    got = target_sampling.op12(docs_df, spark.createDataFrame([(t, 1) for t in target], "text string, doc_id long"))
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"] and {t for _, t in got.dtypes} == {"bigint"}
    got = sorted(map(tuple, got.collect()), key=key)
    assert got == sampled_by_hand(docs, target)
    sql = by_duckdb(RESAMPLING, documents=([d[:2] for d in docs], "doc_id BIGINT, text VARCHAR"), benchmark=([(i, t) for i, t in enumerate(target)], "item_id BIGINT, text VARCHAR"))
    assert got == sql


def test_resampling_of_empty_tables(spark):
    docs = spark.createDataFrame(odd_documents(), "doc_id long, text string, weight double")
    target = spark.createDataFrame([("alpha beta",)], "text string")
    assert target_sampling.op12(docs.limit(0), target).count() == 0
    got = sorted(map(tuple, target_sampling.op12(docs, target.limit(0)).collect()), key=key)
    assert got == sampled_by_hand(odd_documents(), [])


def test_features_of_a_long_text_in_pieces(monkeypatch):
    words = [random.Random(i).choice(LETTERS) for i in range(1001)]
    whole = target_sampling.bucket_counts(" ".join(words))
    monkeypatch.setattr(target_sampling, "PIECE", 10)
    pieces = target_sampling.bucket_counts(" ".join(words))
    assert whole[0] == pieces[0] == 1001 and whole[1].tolist() == pieces[1].tolist() and whole[2].tolist() == pieces[2].tolist()
    assert whole[2].sum() == 2001


def shingles_of(text):
    words = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(words[i : i + 3]) for i in range(max(1, len(words) - 2))} if words else set()


def groups_by_hand(docs):
    sets = [shingles_of(d[1]) for d in docs]
    parent = list(range(len(docs)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if a and sets[j] and 100 * both >= 90 * (len(a) + len(sets[j]) - both):
                parent[find(i)] = find(j)
    least = {}
    for i, d in enumerate(docs):
        if d[0] is not None:
            least[find(i)] = min(least.get(find(i), d[0]), d[0])
    return sorted(((d[0], len(s), least.get(find(i)) if s else d[0]) for i, (d, s) in enumerate(zip(docs, sets))), key=key)


def edited(words, rng, times):
    words = list(words)
    for _ in range(times):
        at = rng.randrange(len(words))
        words[at : at + rng.choice([0, 1, 1])] = [rng.choice(LETTERS) + str(rng.randrange(99))]
    return " ".join(words)


def near_copies(seed=4, bases=25, copies=8):
    """Copies whose similarity lies on both sides of 0.9, some linked through others only."""
    rng = random.Random(seed)
    docs = []
    for _ in range(bases):
        words = [rng.choice(LETTERS) + str(rng.randrange(30)) for _ in range(rng.choice([9, 11, 12, 14, 20, 30, 60, 100, 300]))]
        docs += [(rng.randrange(10**6), edited(words, rng, rng.choice([0, 1, 1, 2, 3, len(words) // 40]))) for _ in range(copies)]
    docs += [(10**7 + i, t) for i, t in enumerate([None, "", " \n", "one", "ONE", "one two", "one  TWO", "a b c", "a b c a b c", "a b c a b c a b c", "É a b", "é a b"])]
    return [*docs, (None, docs[0][1]), (None, "only here " * 9), docs[1], docs[1], (docs[2][0], docs[40][1])]


def test_shingle_groups_equal_brute_force(spark):
    for seed in (4, 5):
        docs = near_copies(seed)
        df = spark.createDataFrame([(*d, 0) for d in docs], "doc_id long, text string, node int").repartition(5)
        got = shingle_join.op13(df)
        assert got.columns == ["doc_id", "n_shingles", "component_id"]
        assert sorted(map(tuple, got.collect()), key=key) == groups_by_hand(docs)
    named = [d for d in docs if d[0] is not None]
    sql = by_duckdb(SHINGLES, documents=(named, "doc_id BIGINT, text VARCHAR"))
    assert sql == groups_by_hand(named)


def test_blocks_of_many_indexes(spark):
    """With indexes of 300 shingles nearly every block takes leaders' rounds and the last pass over all members."""
    rng = random.Random(8)
    words = [rng.choice(LETTERS) + str(rng.randrange(30)) for _ in range(60)]
    docs = [(i, edited(words, rng, rng.choice([0, 1, 1, 2, 3]))) for i in range(150)]
    docs += [(1000 + i, t) for i, (_, t) in enumerate(near_copies(6, 6, 10)[:60])]
    got = shingle_join.alike_groups(spark.createDataFrame(docs, "doc_id long, text string"), most=300)
    assert sorted(map(tuple, got.collect()), key=key) == groups_by_hand(docs)


def test_shingle_join_of_no_rows_and_long_text(spark):
    docs = spark.createDataFrame([(1, "x")], "doc_id long, text string")
    assert shingle_join.op13(docs.limit(0)).count() == 0
    long = " ".join(str(i) for i in range(60_000))
    got = shingle_join.op13(spark.createDataFrame([(5, long), (3, long + " tail"), (4, "head " + long), (9, "x")], "doc_id long, text string"))
    assert sorted(map(tuple, got.collect())) == [(3, 59_999, 3), (4, 59_999, 3), (5, 59_998, 3), (9, 1, 9)]


def test_alike_sets_share_a_signature():
    """The pigeonhole bound, over sizes on both sides of every class border and the largest difference allowed."""
    rng = np.random.default_rng(2)
    for n in [9, 10, 11, 12, 17, 18, 19, 20, 27, 28, 57, 99, 100, 333]:
        for _ in range(40):
            a = rng.integers(0, 2**64, n, dtype=np.uint64)
            smaller = rng.random() < 0.5
            drop = int(rng.integers(0, n // 10 + 1)) if smaller else n // 19
            b = np.concatenate([a[drop:], rng.integers(0, 2**64, 0 if smaller else drop, dtype=np.uint64)])
            both = n - drop
            assert 100 * both >= 90 * (n + len(b) - both)
            sets = [np.sort(a), np.sort(b)]
            names, many = shingle_join.signatures(np.concatenate(sets), np.array([len(a), len(b)]))
            assert set(names[: many[0]].tolist()) & set(names[many[0] :].tolist())


def test_divide_skip_finds_all(spark):
    rng = np.random.default_rng(5)
    pool = rng.integers(0, 2**64, 90, dtype=np.uint64)
    sets = [np.sort(rng.choice(pool[: rng.integers(20, 60)], rng.integers(9, 19), replace=False)) for _ in range(300)]
    sets += [np.sort(np.delete(s, 0)) for s in sets[:200]]
    sizes, hashes = np.array([len(s) for s in sets]), np.concatenate(sets)
    index = shingle_join.Index(hashes, sizes)
    label = np.arange(len(sets))
    for place, i in enumerate(index.order.tolist()):
        low, high = (int(np.searchsorted(index.sizes, x)) for x in (-(-9 * sizes[i] // 10), 10 * sizes[i] // 9 + 1))
        want = {k for k, j in enumerate(index.order.tolist()) if k != place and 19 * len(np.intersect1d(sets[i], sets[j])) >= 9 * (sizes[i] + sizes[j])}
        assert set(shingle_join.divide_skip(index, sets[i], low, high, label, place)) == want
