"""Operators 1 to 3 against brute force and on odd inputs."""

import random
import time
import re

import numpy as np
import pytest
import xxhash

from plenum.llm import additive_search, html_text, simhash
from plenum.llm.components import connected_components

ODD_DOCS = "doc_id long, text string, component_id string, fp string, node int"


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(marks, radius):
    root = {k: k for k in marks}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    keys = sorted(marks)
    for i, a in enumerate(keys):
        for b in keys[:i]:
            if (marks[a] ^ marks[b]).bit_count() <= radius:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {k: find(k) for k in keys}


def test_fingerprint_edges():
    for text in (None, "", " \t\n", "a", "A b", "Ünï Ä b c\x1cd", "a b c a b c a b c", "ß" * 50, "x " * 5000):
        assert simhash.fingerprint(text) == plain_fingerprint(text)


def test_bk_tree_finds_all_within_the_radius():
    rng = np.random.default_rng(1)
    base = [int(x) for x in rng.integers(0, 2**63, 40)]
    values = list({b ^ (1 << int(rng.integers(64))) ^ (1 << int(rng.integers(64))) for b in base for _ in range(6)} | set(base))
    tree = simhash.BKTree()
    for v in values:
        tree.add(v)
    for v in values:
        assert sorted(tree.within(v, 2)) == [i for i, w in enumerate(values) if (v ^ w).bit_count() <= 2]


def test_links_across_shards(spark):
    rng = np.random.default_rng(2)
    marks, at = {}, 0
    for _ in range(30):
        value = int(rng.integers(0, 2**63))
        for _ in range(int(rng.integers(1, 6))):
            marks[at] = value
            at += 1
            value ^= (1 << int(rng.integers(63))) | (1 << int(rng.integers(63)))
    first = {}
    for k, v in marks.items():
        first.setdefault(v, k)
    rows = [(k, v) for v, k in first.items()]
    found = connected_components(simhash.near_links(spark.createDataFrame(rows, "node long, fp long")))
    got = {r["node"]: r["component"] for r in found.collect()}
    want = plain_components({k: v for v, k in first.items()}, 2)
    assert {k: got.get(k, k) for k in want} == want


def test_simhash_odd_rows(spark):
    rows = [(3, None, "x", "y", 1), (1, "", "x", "y", 1), (2, " \n", None, None, None), (5, "the same text here", "x", "y", 1), (4, "the same text here", "x", "y", 1), (4, "the same text here", "x", "y", 1), (None, "the same text here", "x", "y", 1), (None, "quite another thing", "x", "y", 1), (9, "long " * 30000, "x", "y", 1)]
    got = simhash.op1(spark.createDataFrame(rows, ODD_DOCS)).collect()
    assert len(got) == len(rows)
    by_id = {r["doc_id"]: r for r in got if r["doc_id"] is not None}
    assert by_id[3]["fingerprint"] == "0" * 16 and by_id[3]["component_id"] == 1 and by_id[2]["component_id"] == 1
    assert by_id[5]["component_id"] == 4
    assert sorted((r["component_id"] for r in got if r["doc_id"] is None), key=str) == [4, None]
    assert simhash.op1(spark.createDataFrame([], ODD_DOCS)).count() == 0
    kept = simhash.near_dedup(spark.createDataFrame(rows, ODD_DOCS))
    assert kept.columns == ["doc_id", "text", "component_id", "fp", "node"]
    assert sorted(r["doc_id"] for r in kept.collect() if r["doc_id"] is not None) == [1, 4, 4, 9]


def test_components_of_chains_and_hubs(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 60)] + [(7, 7), (None, 3)]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {got[i] for i in range(41)} == {0} and {got[i] for i in range(100, 160)} == {100}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


PAGE = """<!DOCTYPE html><html><head><title>T &amp; U</title><style>p{color:red}</style><script>var a = "</p><p>no</p>";</script></head>
<body><header><a href="/">Site</a> tagline</header><nav><ul><li><a href="/a">A</a></li></ul></nav><div class="cookie-notice">We use cookies, please accept them all now.</div>
<div id="sidebar"><p>Related stories that go on for quite some length here.</p></div>
<article><h1>Head  line &amp; more</h1><p>First <b>para</b>graph with <a href="x">a link</a> inside&nbsp;and enough words to count.<p>Second one<br>goes on &#8212; and on, for a while, until it ends.</p>
<form><input name="q"><label>Mail</label></form><aside>Advert text that is not ours.</aside><p>Ok.</p><ul><li>one item</li><li>another</li></ul></article>
<section class="comments"><p>Reader comment: I disagree with every word of this.</p></section><footer>&copy; 2024 Someone</footer></body></html>"""


def test_article_text():
    want = "Head line & more First paragraph with a link inside and enough words to count. Second one goes on — and on, for a while, until it ends. Ok. one item another"
    assert html_text.main_text(PAGE) == want


def test_page_without_container():
    page = "<body><div class=nav><a href=1>Home</a> <a href=2>News</a></div><h2>Title here</h2>" + "".join(f"<p>Paragraph {i} has a number of words that make it content, more or less.</p>" for i in range(5)) + "<div class='footer'>Imprint</div></body>"
    got = html_text.main_text(page)
    assert got.startswith("Title here Paragraph 0") and got.endswith("more or less.") and "Home" not in got and "Imprint" not in got


LONG = "This is a long paragraph of the story that goes on and on with words enough to count as content on any page. "


def box_page(closing, long=3):
    """A page of plain boxes: nothing but the text-to-tag ratio tells the story from what surrounds it."""
    menu = "".join(f"<div>Item {i}</div>" for i in range(8))
    story = "".join(f"<div><p>{LONG * long}</p></div>" for _ in range(4))
    return f"<body>{menu}{story}<div><p>{closing}</p></div>" + "".join(f"<div>Legal {i}</div>" for i in range(4))


def test_scores_select_the_regions_of_a_page_without_names(monkeypatch):
    closing = "These are the closing words of the story."
    page = box_page(closing)
    story = " ".join([(LONG * 3).strip()] * 4)
    assert html_text.main_text(page) == f"{story} {closing}"
    assert html_text.main_text(page, sigma=0.01) == story  # without smoothing the last paragraph is lost
    monkeypatch.setattr(html_text, "threshold", lambda values: 0.0)
    assert html_text.main_text(page) != f"{story} {closing}"  # without the threshold the menu comes along


@pytest.mark.parametrize("seed", range(4))
def test_labelled_pages(seed):
    """Pages made of marked pieces: the marked text is exactly what comes out."""
    rng = random.Random(seed)
    sentence = lambda lo, hi: " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 9))) for _ in range(rng.randint(lo, hi))).capitalize() + "."
    for _ in range(40):
        blocks = [("h1", sentence(3, 8))] + [(rng.choice(["p", "p", "p", "h2", "blockquote", "li"]), sentence(1, 60)) for _ in range(rng.randint(2, 12))] + [("p", sentence(30, 60))]
        want = " ".join(t for _, t in blocks)
        inner = "".join(f"<{k}{rng.choice(['', ' class=lead', ' class=notice-board'])}>{t}</{k}>" + rng.choice(["", "", f"<div class='ad-slot'>{sentence(5, 40)}</div>", f"<aside><p>{sentence(5, 60)}</p></aside>", "<script>x</script>"]) for k, t in blocks)
        shell = rng.choice(["<article>%s</article>", "<main><article>%s</article></main>", "<div class='post-content'>%s</div>", "<div id=content>%s</div>", "<div>%s</div>", "<form><div>%s</div></form>"])
        page = (
            f"<html><head><title>{sentence(2, 9)}</title></head><body><header><p>{sentence(2, 30)}</p></header><nav>{sentence(2, 30)}</nav>"
            f"<div class='breadcrumbs'>{sentence(2, 9)}</div>{shell % inner}<div class='related-posts'><p>{sentence(9, 60)}</p></div>"
            f"<section id='comments'><article class='comment'><p>{sentence(9, 90)}</p></article></section><footer>{sentence(5, 60)}</footer></body></html>"
        )
        assert html_text.main_text(page) == want, page


def test_deep_pages_take_linear_time():
    for page in ("<b>" * 100_000 + "x" * 50, "<p><div>" + "<b>" * 50_000 + "<p>x" * 20_000, "<div>" * 60_000 + "<p>hello there</p>", "<a>" * 50_000 + "<p>y" * 50_000):
        began = time.perf_counter()
        html_text.main_text(page)
        assert time.perf_counter() - began < 8  # well over 100 if each event searched the open elements


def test_broken_pages():
    for page in (None, "", "<", "<p", "<!-- open", "<script>never closed", "plain text only", "<p>cut &am", "<b>" * 3000, "<p>x</p>" * 5000):
        assert isinstance(html_text.main_text(page), str)
    assert html_text.main_text("plain text only") == "plain text only"
    assert html_text.main_text("<article><p>kept</p><a hre") == "kept"


def test_pages_odd_rows(spark):
    shape = "page_id long, url string, html string, text int"
    rows = [(1, "u", PAGE, 5), (1, "u", PAGE, 5), (2, None, None, None), (None, "v", "", 0)]
    got = html_text.op2(spark.createDataFrame(rows, shape)).collect()
    assert sorted(r["n_chars"] for r in got)[:2] == [0, 0] and len(got) == 4 and got[0]["n_chars"] == len(html_text.main_text(PAGE))
    assert html_text.op2(spark.createDataFrame([], shape)).count() == 0


def exact(rows, k=20):
    out = {}
    for q, v in rows:
        if q % 20 == 0:
            scored = sorted(((-float(np.dot(np.float64(v), np.float64(w))), i) for i, w in rows if i != q))
            out[q] = [i for _, i in scored[:k]]
    return out


def test_search_recall_on_clusters(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(12, 32))
    rows = [(i, (centres[i % 12] + 0.5 * rng.normal(size=32)).astype(np.float32).tolist()) for i in range(3000)]
    got = additive_search.op3(spark.createDataFrame(rows, "vec_id long, embedding array<float>"))
    want, found = exact(rows), {}
    for r in got.collect():
        found.setdefault(r["query_id"], {})[r["rank"]] = (r["vec_id"], r["score"])
    assert found.keys() == want.keys()
    hits = sum(len({x for x, _ in found[q].values()} & set(want[q])) for q in want)
    assert hits >= 0.9 * 20 * len(want)
    for q, by_rank in found.items():
        ordered = [by_rank[i] for i in range(1, 21)]
        assert ordered == sorted(ordered, key=lambda x: (-x[1], x[0]))


def test_encoding_beats_zero_and_beam_helps():
    rng = np.random.default_rng(4)
    rows = rng.normal(size=(600, 16)).astype(np.float32)
    books = additive_search.train(rows, codebooks=4, codewords=16)
    errors = [((rows - additive_search.encode(rows, books, beam)[1]) ** 2).sum() for beam in (1, 4)]
    assert errors[1] <= errors[0] < 0.8 * (rows**2).sum()
    codes, decoded = additive_search.encode(rows, books)
    assert np.allclose(decoded, sum(books[m][codes[:, m]] for m in range(4)), atol=1e-4)


def test_search_odd_rows(spark):
    shape = "vec_id long, embedding array<float>, label int, score int, rank string"
    same = [1.0, 0.0]
    rows = [(i, same, 0, 0, "") for i in range(0, 45)] + [(100, [0.0, 0.0], 0, 0, ""), (120, None, 0, 0, ""), (140, [float("nan"), 1.0], 0, 0, ""), (160, [None, 1.0], 0, 0, ""), (180, [float("inf"), 1.0], 0, 0, ""), (None, same, 0, 0, ""), (0, same, 0, 0, "")]
    got = additive_search.op3(spark.createDataFrame(rows, shape)).collect()
    by = {}
    for r in sorted(got, key=lambda r: (r["query_id"], r["rank"])):
        by.setdefault(r["query_id"], []).append(r["vec_id"])
    assert by == {0: list(range(1, 21)), 20: list(range(20)), 40: list(range(20))}
    assert additive_search.op3(spark.createDataFrame([], shape)).count() == 0
    few = additive_search.op3(spark.createDataFrame([(0, same, 0, 0, ""), (1, [0.5, 2.0], 0, 0, "")], shape)).collect()
    assert [(r["vec_id"], r["rank"], r["score"]) for r in few] == [(1, 1, 0.5)]


@pytest.mark.parametrize("length", [48, 160])
def test_search_recall_on_long_vectors(spark, length):
    """Gaussian vectors, a fiftieth of which is reranked at first: codebooks follow the length, error bounds bring the rest."""
    rng = np.random.default_rng(9)
    rows = rng.standard_normal((5000, length)).astype(np.float32)
    frame = spark.createDataFrame([(i, v) for i, v in enumerate(rows.tolist())], "vec_id long, embedding array<float>")
    got = {}
    for r in additive_search.nearest(frame, frame.where("vec_id % 200 = 0"), rerank=100).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    hits = 0
    for q in range(0, 5000, 200):
        scores = rows.astype(np.float64) @ rows[q].astype(np.float64)
        scores[q] = -np.inf
        hits += len(got[q] & set(np.argsort(-scores)[:20].tolist()))
    assert hits >= 0.9 * 20 * 25


@pytest.mark.parametrize("spread", [0.0, 1.0])
def test_search_recall_on_sixteen_thousand_vectors(spark, spread):
    """One full block, so only a twenty-fifth of the classes is reranked; with and without clusters."""
    rng = np.random.default_rng(3)
    centres = rng.standard_normal((200, 64)) * spread
    rows = (rng.standard_normal((16000, 64)) * (1 - 0.6 * spread) + centres[rng.integers(0, 200, 16000)]).astype(np.float32)
    frame = spark.createDataFrame([(i, v) for i, v in enumerate(rows.tolist())], "vec_id long, embedding array<float>")
    got = {}
    for r in additive_search.nearest(frame, frame.where("vec_id % 400 = 0")).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    hits = 0
    for q in range(0, 16000, 400):
        scores = rows.astype(np.float64) @ rows[q].astype(np.float64)
        scores[q] = -np.inf
        hits += len(set(np.argsort(-scores)[:20].tolist()) & got[q])
    assert len(got) == 40 and hits / (40 * 20) >= 0.9


def test_search_within_each_length_and_in_double_precision(spark):
    rows = [(i, [float(i), 1.0]) for i in range(0, 30)] + [(100 + i, [1.0, float(i), 2.0]) for i in range(30)] + [(200, [1e-9 + 1.0, 1.0])]
    got = {}
    for r in additive_search.op3(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert sorted(got) == [0, 20, 100, 120, 200]
    by_id = dict(rows)
    for q, found in got.items():
        others = [(-sum(x * y for x, y in zip(v, by_id[q])), i) for i, v in rows if i != q and len(v) == len(by_id[q])]
        assert [(i, s) for _, i, s in sorted(found)] == [(i, -s) for s, i in sorted(others)[:20]]


def test_search_against_sql(spark):
    import duckdb

    from plenum.llm.oracles import NEAREST

    sf = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{sf}/embeddings.parquet'")
    assert {tuple(r) for r in additive_search.op3(spark.read.parquet(f"{sf}/embeddings.parquet")).collect()} == set(con.execute(NEAREST).fetchall())


def test_blocks_of_queries_and_vectors(spark, monkeypatch):
    monkeypatch.setattr(additive_search, "BLOCK_ROWS", 50)
    monkeypatch.setattr(additive_search, "QUERY_ROWS", 3)
    rng = np.random.default_rng(5)
    rows = [(i, rng.normal(size=8).astype(np.float32).tolist()) for i in range(200)]
    got = {}
    for r in additive_search.op3(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    assert got == {q: set(ids) for q, ids in exact(rows).items()}


def test_columns_are_those_of_the_contract(spark):
    docs = spark.createDataFrame([(1, "a b c d")], "doc_id int, text string")
    assert simhash.op1(docs).dtypes == [("doc_id", "bigint"), ("fingerprint", "string"), ("component_id", "bigint")]


def test_near_dedup_at_the_stated_similarity(spark):
    """Planted copies at Jaccard 0.8 to 0.95 go; those below 0.8 stay."""
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(6))

    def shingles(words):
        return {tuple(words[i : i + 5]) for i in range(len(words) - 4)}

    rows, near, far = [], set(), set()
    for i in range(240):
        words = [word() for _ in range(rng.randint(150, 400))]
        other = list(words)
        for at in rng.sample(range(len(words)), max(1, int(len(words) * rng.uniform(0.005, 0.035)))):
            other[at] = word()
        a, b = shingles(words), shingles(other)
        similarity = len(a & b) / len(a | b)
        rows += [(i, " ".join(words)), (1000 + i, " ".join(other))]
        if similarity >= 0.8:
            near.add(1000 + i)
        else:
            far.add(1000 + i)
    assert len(near) > 40 and len(far) > 40
    left = {r["doc_id"] for r in simhash.near_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert set(range(240)) | far <= left
    assert len(near & left) <= 0.01 * len(near)


def test_near_duplicate_shards_are_searched_through_a_bk_tree():
    """Parts from the tree are those of all pairs, near copies cost no pairs, and two bits keep a shard of whole blocks."""
    rng = random.Random(13)
    marks = [rng.getrandbits(64) for _ in range(30)]
    marks += [m ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 12))) for m in marks for _ in range(12)] + marks[:5]
    for radius in (0, 2, 8, 20):
        got = simhash.tree_parts(np.array(marks, np.uint64), radius).tolist()
        want = list(plain_components(dict(enumerate(marks)), radius).values())
        assert len(set(zip(got, want))) == len(set(got)) == len(set(want))
    near = np.array([marks[0] ^ (1 << i) ^ (1 << j) ^ (1 << k) for i in range(64) for j in range(i) for k in range(j)], np.uint64)
    begin = time.time()
    assert len(set(simhash.tree_parts(near, 20).tolist())) == 1 and time.time() - begin < 5  # 41,664 of them
    names = [simhash.block_names(np.array([a, a ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64))], np.uint64)) for a in marks]
    assert all((a[0] == a[1]).any() and a.shape == (2, simhash.SHARDS - simhash.BANDS) for a in names)


def test_near_dedup_tells_rows_by_id_and_text(spark):
    a, b = (" ".join(f"{x}{i}" for i in range(40)) for x in "ab")
    rows = [(1, a), (5, a), (5, b), (None, b + " more"), (None, "of its own kind and no other"), (None, None)]
    left = simhash.near_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((str(r["doc_id"]), str(r["text"])) for r in left) == sorted([("1", a), ("5", b), ("None", rows[4][1]), ("None", "None")])
