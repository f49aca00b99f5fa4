"""Operators 7 and 8 against brute force, exact round trips and odd inputs."""

import base64
import hashlib
import random
import zlib

import numpy as np
import pytest

from plenum.llm import repeats, warc


def plain_removed(texts, length=100):
    """Covered bytes of each (doc_id, bytes), in order of doc_id."""
    seen, out = set(), {}
    for name, data in sorted(texts):
        covered = np.zeros(len(data), bool)
        for i in range(len(data) - length + 1):
            part = data[i : i + length]
            if part in seen:
                covered[i : i + length] = True
            seen.add(part)
        out[name] = covered
    return out


def tree_groups(text, least):
    """Maximal repeats by definition: substrings that occur twice and can't be longer on either side."""
    found = {}
    for n in range(least, len(text)):
        places = {}
        for i in range(len(text) - n + 1):
            places.setdefault(text[i : i + n], []).append(i)
        for s, at in places.items():
            if len(at) > 1:
                left = {text[i - 1] if i else -1 - i for i in at}
                right = {text[i + n] if i + n < len(text) else -1 - i for i in at}
                if len(left) > 1 and len(right) > 1:
                    found[s] = at
    return found


@pytest.mark.parametrize("seed", range(8))
def test_maximal_repeats_by_definition(seed):
    rng = random.Random(seed)
    text = bytes(rng.choice(b"ab") for _ in range(70)) + b"abababababababababababab" * (seed % 2)
    got = {text[at[0] : at[0] + n]: sorted(at) for n, at, _ in repeats.maximal_repeats([text], [0], 16)}
    assert got == tree_groups(text, 16)


@pytest.mark.parametrize("seed", range(6))
def test_spans_of_many_segments(seed):
    rng = random.Random(seed)
    phrases = [bytes(rng.choice(b"abcdefgh ") for _ in range(rng.randint(60, 300))) for _ in range(4)]
    segments = [b"".join(rng.choice([*phrases, bytes(rng.choice(b"xyz") for _ in range(rng.randint(0, 80)))]) for _ in range(rng.randint(0, 6))) for _ in range(15)] + [b"", b"q" * 400, b"ab" * 150]
    spans, fresh = repeats.later_spans(segments, [0] * len(segments))
    want = plain_removed(list(enumerate(segments)))
    got = {k: np.zeros(len(s), bool) for k, s in enumerate(segments)}
    for k, a, b in spans:
        got[k][a:b] = True
    assert all((got[k] == want[k]).all() for k in want)
    kept = {k: [segments[k][a:b] for j, a, b in fresh if j == k] for k in got}
    everything = {s[i : i + 100] for s in segments for i in range(len(s) - 99)}
    assert {p[i : i + 100] for parts in kept.values() for p in parts for i in range(len(p) - 99)} == everything


def test_groups_do_not_meet():
    segments = [b"z" * 150, b"z" * 150]
    assert {k for k, _, _ in repeats.later_spans(segments, [0, 1])[0]} == {0, 1}
    rng = random.Random(1)
    text = bytes(rng.choice(b"abc") for _ in range(300))
    assert repeats.later_spans([text, text], [0, 1])[0] == []
    assert repeats.later_spans([text, text], [0, 0])[0] == [(1, 0, 300)]


def test_anchors_depend_on_content_only():
    rng = random.Random(3)
    inner = bytes(rng.randrange(256) for _ in range(500))
    a, b = (bytes(rng.randrange(256) for _ in range(n)) + inner + bytes(rng.randrange(256) for _ in range(77)) for n in (13, 210))
    pick = lambda text, at: {(p - at, h) for p, h in zip(*map(np.ndarray.tolist, repeats.anchors(text))) if at + 76 <= p <= at + 500 - 100}
    assert pick(a, 13) == pick(b, 210) and pick(a, 13)
    places, _ = repeats.anchors(a)
    assert all(any(i <= p <= i + 100 - repeats.GRAM for p in places) for i in range(len(a) - 99))
    assert len(repeats.anchors(b"x" * 99)[0]) == 0 and len(repeats.anchors(b"")[0]) == 0


def test_large_classes_are_compared_in_place(monkeypatch):
    monkeypatch.setattr(repeats, "SORT_BYTES", 100)
    text = b"orre " * 300
    got = repeats.later_spans([text, b"x" + text[:400]], [0, 0])[0]
    want = plain_removed([(0, text), (1, b"x" + text[:400])])
    assert got == [(0, 5, 1500), (1, 1, 401)] and want[0].sum() == 1495 and want[1].sum() == 400


def corpus(seed=11):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeéß") for _ in range(rng.randint(2, 9)))
    passage = " ".join(word() for _ in range(60))
    texts = [" ".join(word() for _ in range(rng.randint(5, 200))) for _ in range(40)]
    for i in range(0, 40, 4):
        texts[i] = texts[i][:50] + passage + texts[i][50:]
    near = texts[7].split()
    for i in (20, 21, 22):
        near[len(near) // 2] = word()
        texts[i] = " ".join(near)
    texts[30] = texts[31] = texts[5]
    texts[33] = "z" * 900
    texts[34] = "phrase again " * 60
    return texts


def removed_of(rows):
    return sorted((str(r["doc_id"]), r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in rows)


def expected(texts):
    out = []
    by_doc = plain_removed([(i, (t or "").encode()) for i, t in texts])
    for i, t in texts:
        data, covered = (t or "").encode(), by_doc[i]
        kept = np.frombuffer(data, np.uint8)[~covered].tobytes()
        out.append((str(i), len(data), int(covered.sum()), int((np.diff(np.concatenate([[0], covered.view(np.int8)])) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("batch", [1 << 20, 600])
def test_whole_corpus(spark, monkeypatch, batch):
    monkeypatch.setattr(repeats, "BATCH_BYTES", batch)
    texts = [*enumerate(corpus()), (90, None), (91, ""), (92, "short"), (93, "short")]
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in texts], "doc_id long, text string, start int, segments string")
    full = repeats.remove_repeats(docs).collect()
    assert removed_of(full) == expected(texts) and removed_of(repeats.op7(docs).collect()) == expected(texts)
    assert all(r["kept"] is None or hashlib.sha256(r["kept"]).hexdigest() == r["kept_sha256"] for r in full)


def test_repeated_rows_and_null_ids(spark):
    texts = corpus()[:8]
    rows = [(i, t) for i, t in enumerate(texts)]
    docs = spark.createDataFrame([*rows, rows[0], rows[3], (None, texts[2])], "doc_id long, text string")
    got = repeats.op7(docs).collect()
    assert len(got) == len(rows) + 3
    plain = dict((int(a), tuple(r)) for a, *r in expected(rows))
    for r in got:
        if r["doc_id"] is None:
            assert r["n_removed"] == r["n_bytes"]
        else:
            assert (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) == plain[r["doc_id"]]
    assert repeats.op7(docs.limit(0)).count() == 0


def pages(spark):
    rng = random.Random(9)
    rows = [(i, f"http://h/{i}%\n", "".join(rng.choice("abc<>é\n\x00") for _ in range(rng.randint(0, 3000)))) for i in range(60)]
    rows += [(100 + i, None, "same payload") for i in range(5)] + [(200, "u", None), (201, "u", ""), (202, "u", "\x1f\x8b\x08 WARC/1.0\r\n\r\n"), (203, "big", "x" * 3_000_000)]
    rows += [(100, None, "same payload"), (None, "n", "same payload"), (None, "n", "alone")]
    return rows, spark.createDataFrame([(*r, 1, "y") for r in rows], "page_id long, url string, html string, payload int, digest string")


def test_round_trip(spark, tmp_path):
    rows, frame = pages(spark)
    warc.write_archives(frame.repartition(3), f"file://{tmp_path}/a")
    for split in (700, 1 << 23):
        got = warc.read_archives(spark, f"file://{tmp_path}/a", split_bytes=split).collect()
        assert len(got) == len(rows)
        first = {}
        for p, u, h in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
            first.setdefault((h or "").encode(), p)
        want = []
        for p, u, h in rows:
            data = (h or "").encode()
            to = None if first[data] == p else first[data]
            want.append((str(p), str(u), len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "response" if to is None else "revisit", str(to), None if to is not None else data))
        have = [(str(r["page_id"]), str(r["url"]), r["payload_bytes"], r["payload_digest"], r["warc_type"], str(r["refers_to"]), None if r["payload"] is None else bytes(r["payload"])) for r in got]
        assert sorted(have, key=str) == sorted(want, key=str)


def test_archives_are_plain_gzip(spark, tmp_path):
    _, frame = pages(spark)
    warc.write_archives(frame.coalesce(1), f"file://{tmp_path}/b")
    data = b"".join(p.read_bytes() for p in (tmp_path / "b").glob("part-*"))
    members, out = 0, []
    while data:
        d = zlib.decompressobj(31)
        out.append(d.decompress(data))
        assert d.eof
        data, members = d.unused_data, members + 1
    assert sum(x.startswith(b"WARC/1.0\r\n") for x in out) == members // 2 == frame.count()


def test_lengths_limit_and_empty(spark, tmp_path):
    rows = [(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abcdef"), (4, "u", "abcdef")]
    warc.write_archives(spark.createDataFrame(rows, "page_id long, url string, html string"), f"file://{tmp_path}/c", min_bytes=5)
    got = {r["page_id"]: r["warc_type"] for r in warc.read_archives(spark, f"file://{tmp_path}/c").collect()}
    assert got == {1: "response", 2: "response", 3: "response", 4: "revisit"}
    assert warc.op8(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_range_ownership(tmp_path):
    file = tmp_path / "x.warc.gz"
    parts = [warc.member(i, "u", bytes([i]) * (i * 37), None) for i in range(20)]
    file.write_bytes(b"noise" + b"".join(parts[:10]) + warc.MAGIC + b"junk" + b"".join(parts[10:]))
    size = file.stat().st_size
    for step in (50, 333, 1 << 20):
        ids = [int(f["x-page-id"]) for a in range(0, size, step) for f, _ in warc.records(str(file), a, min(a + step, size))]
        assert ids == list(range(20))


def test_headers_longer_than_the_probe(tmp_path):
    import gzip
    import random

    url = "data:" + random.Random(3).randbytes(150_000).hex()
    file = tmp_path / "long.warc.gz"
    head = b"WARC-Type: response\r\nWARC-Target-URI: " + url.encode() + b"\r\nContent-Length: 4\r\n\r\nbody\r\n\r\n"
    file.write_bytes(gzip.compress(warc.VERSION + head) + gzip.compress(warc.VERSION + b"no blank line" * 20_000))
    found = list(warc.records(str(file), 0, file.stat().st_size))
    assert [(f["warc-target-uri"], body) for f, body in found] == [(url, b"body")]


def test_rows_that_share_an_id_are_different_documents(spark):
    rng = random.Random(9)
    a, b, c = ("".join(rng.choice("abcdefgh ") for _ in range(150)) for _ in range(3))
    rows = [(1, a), (None, a), (None, b), (7, a + "!"), (7, c), (7, c)]
    got = repeats.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((str(r["doc_id"]), r["n_removed"], r["kept"] or b"") for r in got if r["n_removed"]) == sorted([("None", 150, b""), ("7", 150, b"!")])
