"""Similarity join of documents on word shingles by T-occurrence search (operator 13).

Two sets are alike at 90 % if they share at least 9/19 of the sum of their sizes. Sets
that may be alike meet in a block; there an inverted index is searched with every
set: its short lists are merged, candidates that occur often enough in them are probed
in the long lists, and those that reach the required overlap are links.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plenum.llm.components import connected_components
from plenum.llm.grouped import bounds
from plenum.llm.line_dedup import chunks
from plenum.llm.sketch import mixed, shingle_features, split_words
from plenum.llm.storage import cut, shuffle_width, written

LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
WORDS = 3  # of a shingle
ENTRIES = 4_000_000  # signatures that one task sorts, 16 bytes each
INDEXED = 1 << 20  # shingles that one inverted index holds, or those of one document
FEW = 64  # postings that a heap merges faster than a sort


# Sizes fall in classes so wide that sets which are alike are of one class or of
# neighbouring ones. Group g holds classes g and g + 1, so such a pair meets in a group.
def size_classes(upto: int) -> list[int]:
    """Smallest size of each class, until one is over ``upto``, and two more."""
    least = [1]
    while least[-1] <= upto:
        least.append(10 * least[-1] // 9 + 1)
    for _ in range(2):
        least.append(10 * least[-1] // 9 + 1)
    return least


def parts_of(least: list[int], group: np.ndarray) -> np.ndarray:
    """Number of parts for a group: one more than its alike sets can differ by, so that they agree on a whole part."""
    top = np.array(least, np.int64)[np.minimum(group + 2, len(least) - 1)] - 1
    return 2 * top // 19 + 1


def distinct_shingles(texts: list[bytes], n: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text, one text after another, and how many a text (none without words)."""
    words = split_words(texts, LOWER)
    hashes, counts = shingle_features(words, n)
    text = np.repeat(np.arange(len(texts)), counts)
    worded = np.zeros(len(texts), bool)
    worded[np.searchsorted(words.first_line, words.line, side="right") - 1] = True
    order = np.lexsort((hashes, text))
    hashes, text = hashes[order], text[order]
    once = worded[text]
    once[1:] &= (hashes[1:] != hashes[:-1]) | (text[1:] != text[:-1])
    return hashes[once], np.bincount(text[once], minlength=len(texts))


def signatures(hashes: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Signatures of sets (laid out as by :func:`distinct_shingles`) and how many a set.

    In each of a set's two groups its hashes are cut by range into the group's parts; a
    part's signature is a sum over its hashes. Alike sets of a group differ in fewer
    hashes than there are parts, so some part holds the same hashes in both. Where
    there is one part, only equal sets are alike, and no signature is needed.
    """
    if not len(sizes):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    least = size_classes(int(sizes.max()))
    own = np.searchsorted(least, sizes, side="right") - 1
    running = np.concatenate(([np.uint64(0)], np.cumsum(mixed(hashes))))  # wraps around
    high, owner = hashes >> np.uint64(32), np.repeat(np.arange(len(sizes)), sizes)
    found, of = [], []
    for group in (own - 1, own):
        parts = np.where((sizes > 0) & (group >= 0), parts_of(least, np.maximum(group, 0)), 0)
        parts[parts == 1] = 0
        base = np.cumsum(parts) - parts
        part = (high * parts[owner].astype(np.uint64)) >> np.uint64(32)
        used = parts[owner] > 0
        inside = np.bincount(base[owner][used] + part[used].astype(np.int64), minlength=int(parts.sum()))
        holder = np.repeat(np.arange(len(sizes)), parts)
        starts = np.cumsum(inside) - inside
        # Sets that take no part here shift the places of those after them.
        shift = np.cumsum(np.where(parts > 0, 0, sizes))[holder]
        sums = running[starts + shift + inside] - running[starts + shift]
        place = np.arange(len(holder)) - base[holder]
        name = mixed(mixed(group[holder].astype(np.uint64)) + place.astype(np.uint64))
        found.append(mixed(sums ^ name))
        of.append(holder)
    order = np.argsort(np.concatenate(of), kind="stable")
    return np.concatenate(found)[order], np.bincount(np.concatenate(of), minlength=len(sizes))


def set_rows(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``body`` (hash of the text), ``n_shingles``, ``high`` and ``low`` (MD5 of the set) and ``signatures`` of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(2).cast(pa.binary()).to_pylist()
            for at, some in chunks(texts):
                hashes, sizes = distinct_shingles(some)
                names, many = signatures(hashes, sizes)
                ends, name_ends = np.cumsum(sizes).tolist(), np.cumsum(many).tolist()
                keys = b"".join(hashlib.md5(hashes[a:b].tobytes()).digest() for a, b in zip([0, *ends], ends))
                both = np.frombuffer(keys, "<i8").reshape(-1, 2)
                packed = pa.array([names[a:b].tobytes() for a, b in zip([0, *name_ends], name_ends)], pa.binary())
                plain = [batch.column(i).slice(at, len(some)) for i in (0, 1)]
                yield pa.RecordBatch.from_arrays([*plain, pa.array(sizes.astype(np.int64)), pa.array(both[:, 0]), pa.array(both[:, 1]), packed], ["doc_id", "body", "n_shingles", "high", "low", "signatures"])

    return keyed(docs).mapInArrow(run, "doc_id long, body long, n_shingles long, high long, low long, signatures binary")


def keyed(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``body`` (hash of the text) and ``text`` of each row; a null text is empty."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("body"), text.alias("text"))


def stars(node: np.ndarray, name: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """First node of each name with the name, and links from it to the name's other nodes."""
    order = np.lexsort((node, name))
    node, name = node[order], name[order]
    begin, end = bounds(name)
    first = np.repeat(node[begin], end - begin)
    other = first != node
    links = np.unique(np.stack([first[other], node[other]]), axis=1)
    return name[begin], node[begin], *links


def meetings(rows: DataFrame, count: int) -> DataFrame:
    """Links ``a``, ``b`` that connect all sets (named by ``low``) with a signature in common.

    A signature that many sets have leaves each Arrow batch once; the others are linked to its first set there.
    Entries travel packed, as many rows as there are batches and partitions, and a
    task sorts about ``ENTRIES`` of them at most, whatever the corpus.
    """
    width = shuffle_width(rows.sparkSession, count, ENTRIES)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            packed = batch.column(1).to_pylist()
            names = np.frombuffer(b"".join(packed), np.uint64)
            node = np.repeat(batch.column(0).to_numpy(), [len(x) // 8 for x in packed])
            names, first, a, b = stars(node, names)
            if len(a):
                yield frame(np.array([-1]), [b""], [b""], a, b)
            place = (names % np.uint64(width)).astype(np.int64)
            order = np.argsort(place, kind="stable")
            begin, end = (x.tolist() for x in bounds(place[order]))
            names, first = ([x[order][lo:hi].tobytes() for lo, hi in zip(begin, end)] for x in (names, first))
            yield frame(place[order][begin], names, first, a[:0], b[:0])

    def frame(place: np.ndarray, names: list[bytes], nodes: list[bytes], a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
        links = pa.array([np.stack([a, b]).astype(np.int64).tobytes()] * len(place), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(place), pa.array(names, pa.binary()), pa.array(nodes, pa.binary()), links], ["place", "names", "nodes", "links"])

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, nodes = [], []
        for batch in batches:
            for links in batch.column("links").to_pylist():
                if links:
                    yield pairs(*np.frombuffer(links, np.int64).reshape(2, -1))
            names += batch.column("names").to_pylist()
            nodes += batch.column("nodes").to_pylist()
        _, _, a, b = stars(np.frombuffer(b"".join(nodes), np.int64), np.frombuffer(b"".join(names), np.uint64))
        for lo in range(0, len(a), 100_000):
            yield pairs(a[lo : lo + 100_000], b[lo : lo + 100_000])

    def pairs(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    dealt = rows.where("octet_length(signatures) > 0").select("low", "signatures").mapInArrow(deal, "place long, names binary, nodes binary, links binary")
    # Links already found (place -1) may go anywhere; a row of their own number keeps them from one task.
    target = F.when(F.col("place") < 0, F.xxhash64("links")).otherwise(F.col("place"))
    return dealt.repartition(width, target).select("names", "nodes", "links").mapInArrow(find, "a long, b long").distinct()


def split_sets(hashes: np.ndarray, sizes: np.ndarray) -> list[np.ndarray]:
    return np.split(hashes, np.cumsum(sizes)[:-1]) if len(sizes) else []


class Index:
    """Inverted lists over sets: for each shingle the places of the sets that have it, by size of set."""

    def __init__(self, hashes: np.ndarray, sizes: np.ndarray) -> None:
        self.order = np.argsort(sizes, kind="stable")
        place = np.empty(len(sizes), np.int64)
        place[self.order] = np.arange(len(sizes))
        self.sizes = sizes[self.order]
        holder = np.repeat(place, sizes)
        order = np.lexsort((holder, hashes))
        hashes, self.postings = hashes[order], holder[order]
        self.begin, self.end = bounds(hashes)
        self.tokens = hashes[self.begin]

    def lists(self, items: np.ndarray, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
        """Begin and end in ``postings`` of the items' lists, shortest first, cut to places ``low`` to ``high``; empty ones left out."""
        at = np.searchsorted(self.tokens, items)
        at = at[(at < len(self.tokens)) & (self.tokens[np.minimum(at, len(self.tokens) - 1)] == items)]
        begin, end = self.begin[at], self.end[at]
        many = end - begin > 1
        if low > 0 or high < len(self.sizes):
            for k in np.flatnonzero(many).tolist():
                cut_ = self.postings[begin[k] : end[k]]
                begin[k], end[k] = begin[k] + np.searchsorted(cut_, low), begin[k] + np.searchsorted(cut_, high)
            one = self.postings[begin[~many]]
            end[~many] -= (one < low) | (one >= high)
        size = end - begin
        order = np.argsort(size, kind="stable")
        order = order[size[order] > 0]
        return begin[order], end[order]


def required(a: int, b: np.ndarray) -> np.ndarray:
    """Shingles that sets of these sizes share if they are alike: 100 * intersection >= 90 * union."""
    return -(-9 * (a + b) // 19)


def merged(lists: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Places in the lists and in how many lists each is: by a heap, or by one sort of many postings."""
    if sum(map(len, lists)) > FEW:
        return np.unique(np.concatenate(lists), return_counts=True)
    places: list[int] = []
    counts: list[int] = []
    for x in heapq.merge(*(x.tolist() for x in lists)):
        if places and places[-1] == x:
            counts[-1] += 1
        else:
            places.append(x)
            counts.append(1)
    return np.array(places, np.int64), np.array(counts, np.int64)


def divide_skip(index: Index, items: np.ndarray, low: int, high: int, label: np.ndarray, own: int) -> Iterator[int]:
    """Places from ``low`` to ``high`` of sets alike to ``items``, one or more for each label but ``own`` among them.

    DivideSkip: a set that shares ``least`` items lies in that many lists. With the
    ``long`` longest set aside it still lies in ``least - long`` of the others, so only those are
    merged. Candidates are probed in the long lists by binary search, the longest last,
    while they can still reach what their size asks for. Those with many hits are
    probed first, a few at a time; once one is found, others of its label (sets known to be
    connected) need no probe. The caller changes no label meanwhile.
    """
    begin, end = index.lists(items, low, high)
    if not len(begin):
        return
    least = int(required(len(items), index.sizes[low]))
    if len(begin) < least:
        return
    long = min(least - 1, len(begin))
    short = len(begin) - long
    places, hits = merged([index.postings[a:b] for a, b in zip(begin[:short].tolist(), end[:short].tolist())])
    wanted = required(len(items), index.sizes[places])
    keep = (hits >= max(1, least - long)) & (hits + long >= wanted) & (label[places] != own)
    order = np.argsort(-hits[keep], kind="stable")
    places, hits, wanted = places[keep][order], hits[keep][order], wanted[keep][order]
    met: set[int] = set()
    take = 2
    while len(places):
        some, count, need = places[:take], hits[:take].copy(), wanted[:take]
        for k in range(short, len(begin)):
            held = index.postings[begin[k] : end[k]]
            at = np.searchsorted(held, some)
            count += held[np.minimum(at, len(held) - 1)] == some
            if k % 16 == 15:
                live = count + (len(begin) - 1 - k) >= need
                if not live.all():
                    some, count, need = some[live], count[live], need[live]
                    if not len(some):
                        break
        for place, enough in zip(some.tolist(), (count >= need).tolist()):
            if enough and int(label[place]) not in met:
                met.add(int(label[place]))
                yield place
        places, hits, wanted = places[take:], hits[take:], wanted[take:]
        if met and len(places):
            other = ~np.isin(label[places], list(met))
            places, hits, wanted = places[other], hits[other], wanted[other]
        take = min(2 * take, 256)


def links_inside(hashes: np.ndarray, sizes: np.ndarray, labels: np.ndarray) -> list[tuple[int, int]]:
    """Links among sets of one index that connect all that are alike; equal ``labels`` are connected already."""
    index = Index(hashes, sizes)
    sets = split_sets(hashes, sizes)
    label = np.unique(labels[index.order], return_inverse=True)[1].astype(np.int64)
    out = []
    for place, i in enumerate(index.order.tolist()):
        low = int(np.searchsorted(index.sizes, -(-9 * int(sizes[i]) // 10)))
        if low >= place:
            continue
        for found in list(divide_skip(index, sets[i], low, place, label, int(label[place]))):
            out.append((i, int(index.order[found])))
            label[label == label[found]] = label[place]
    return out


def links_to(index: Index, index_labels: np.ndarray, hashes: np.ndarray, sizes: np.ndarray, labels: np.ndarray) -> list[tuple[int, int]]:
    """Links from sets to the sets of ``index``, one at least for each label that a set is linked to."""
    out, at_place = [], index_labels[index.order]
    for i, items in enumerate(split_sets(hashes, sizes)):
        low = int(np.searchsorted(index.sizes, -(-9 * len(items) // 10)))
        high = int(np.searchsorted(index.sizes, 10 * len(items) // 9, side="right"))
        if low < high:
            out += [(i, int(index.order[k])) for k in divide_skip(index, items, low, high, at_place, int(labels[i]))]
    return out


def sets_from(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    parts = [distinct_shingles(some) for _, some in chunks(texts)] or [(np.zeros(0, np.uint64), np.zeros(0, np.int64))]
    return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])


def searched(members: DataFrame) -> DataFrame:
    """Links ``a``, ``b`` of ``members``: ``block``, ``part``, ``indexed``, ``node``, ``label`` and ``text``.

    Rows of a block and part meet in one task. Those with ``indexed`` come first and
    are searched among themselves; the others are searched in their index as they
    stream by. A part has so few indexed rows that its index holds about ``INDEXED`` shingles.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, rows, index, kept, last = None, [], None, None, None
        for batch in batches:
            block, part, indexed, node, label = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(5))
            begin, end = bounds(np.stack([block, part, indexed.astype(np.int64)])) if len(block) else ([], [])
            for lo, hi in zip(begin, end):
                if key != (block[lo], part[lo]):
                    if key is not None and index is None:
                        yield from inside(rows)
                    key, rows, index, last = (block[lo], part[lo]), [], None, None
                some = list(zip(node[lo:hi].tolist(), label[lo:hi].tolist(), batch.column(5).slice(lo, hi - lo).cast(pa.binary()).to_pylist()))
                some = [x for x, before in zip(some, [last, *some]) if before is None or x[0] != before[0]]  # a repeated row
                last = some[-1] if some else last
                if indexed[lo]:
                    rows += some
                    continue
                if index is None:
                    yield from inside(rows)
                    hashes, sizes = sets_from([x[2] for x in rows])
                    index, kept = Index(hashes, sizes), [x[0] for x in rows]
                    index_labels = np.array([x[1] for x in rows], np.int64)
                if some:
                    hashes, sizes = sets_from([x[2] for x in some])
                    found = links_to(index, index_labels, hashes, sizes, np.array([x[1] for x in some], np.int64))
                    yield pairs([some[i][0] for i, _ in found], [kept[j] for _, j in found])
        if key is not None and index is None:
            yield from inside(rows)

    def inside(rows: list) -> Iterator[pa.RecordBatch]:
        if len(rows) > 1:
            found = links_inside(*sets_from([x[2] for x in rows]), np.array([x[1] for x in rows], np.int64))
            yield pairs([rows[i][0] for i, _ in found], [rows[j][0] for _, j in found])

    def pairs(a: list[int], b: list[int]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    dealt = members.select("block", "part", "indexed", "node", "label", "text").repartition("block", "part")
    return dealt.sortWithinPartitions("block", "part", F.col("indexed").desc(), "node").mapInArrow(run, "a long, b long")


def dealt_parts(members: DataFrame, most: int) -> DataFrame:
    """``members`` with ``parts``, how many indexes of about ``most`` shingles their block needs, and ``part``, one of them by a hash of the node."""
    total = members.groupBy("block").agg(F.sum("n_shingles").alias("__all"))
    parts = F.ceil(F.col("__all") / most).cast("long")
    joined = members.join(total, "block").withColumn("parts", parts).drop("__all")
    return joined.withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")))


def labelled(members: DataFrame, links: DataFrame) -> DataFrame:
    """``members`` with ``label``: the component over ``links``, or the node itself."""
    found = connected_components(links).withColumnRenamed("node", "__node")
    joined = members.drop("label").join(found, F.col("node") == F.col("__node"), "left")
    return joined.withColumn("label", F.coalesce("component", "node")).drop("__node", "component")


def block_links(members: DataFrame, most: int = INDEXED) -> DataFrame:
    """Links that connect all alike members of each block (``block``, ``node``, ``n_shingles``, ``text``).

    A block that fits in one index is searched as it is. A larger one is dealt into parts
    that are searched by themselves; then one member of each component found goes on
    to the next round, as long as rounds find links: of near copies, however many, a few members are left.
    What is not in the block's largest component then is indexed, part by part, and
    all members stream by, so every pair that is not known to be connected is covered.
    """
    texts = members.select("node", "text")
    dealt = dealt_parts(members.withColumn("label", F.col("node")), most)
    links = cut(searched(dealt.withColumn("indexed", F.lit(True))))
    large = cut(dealt.where("parts > 1").select("block", "node", "n_shingles"))
    if large.isEmpty():
        return links
    while True:
        known = cut(labelled(large, links))
        leaders = known.where("node = label")
        several = leaders.groupBy("block").agg(F.count(F.lit(1)).alias("labels")).where("labels > 1").select("block")
        pool = dealt_parts(leaders.join(several, "block", "left_semi"), most).join(texts, "node")
        found = cut(searched(pool.withColumn("indexed", F.lit(True))))
        if found.isEmpty():
            break
        links = links.unionByName(found)
    sizes = known.groupBy("block", "label").agg(F.count(F.lit(1)).alias("n"))
    main = sizes.groupBy("block").agg(F.max_by("label", F.struct("n", "label")).alias("main"), F.count(F.lit(1)).alias("labels")).where("labels > 1").select("block", "main")
    apart = cut(known.join(main, "block"))
    rest = cut(dealt_parts(apart.where("label <> main").drop("main"), most))
    parts = rest.groupBy("block").agg(F.max("parts").alias("parts"))
    every = apart.join(parts, "block").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    columns = ["block", "part", "indexed", "node", "label"]
    both = rest.withColumn("indexed", F.lit(True)).select(*columns).unionByName(every.withColumn("indexed", F.lit(False)).select(*columns))
    return links.unionByName(cut(searched(both.join(texts, "node"))))


def alike_groups(docs: DataFrame, most: int = INDEXED) -> DataFrame:
    """Groups of ``docs`` (``doc_id``, ``text``) linked by sets of distinct three-word shingles alike at 90 %.

    Returns ``doc_id``, ``n_shingles`` and ``component_id`` (smallest doc_id reachable), one
    row per input row. A-Z are lower-cased; a text of fewer than three words is one
    shingle, a null or blank one has none and is linked with nothing. Equal sets are
    one node. A null doc_id gets its group's id but names no group (null if it is alone); repeated
    rows keep their rows; other columns are ignored; an empty table gives an empty result.
    Shingles are compared by 64-bit hashes: two different ones in a pair of documents of
    a thousand words are taken for one once in 10^13 pairs. No link is lost otherwise.
    """
    rows = written(set_rows(docs), "shingle-sets")
    count = rows.agg(F.coalesce(F.sum(F.octet_length("signatures") / 8), F.lit(0)).cast("long")).first()[0]
    blocks = connected_components(meetings(rows, count)).select(F.col("node").alias("low"), F.col("component").alias("block"))
    classes = rows.where("n_shingles > 0").groupBy("high", "low").agg(F.min("doc_id").alias("least"), F.min(F.struct("doc_id", "body")).alias("place"), F.first("n_shingles").alias("n_shingles"))
    numbered = classes.join(blocks, "low", "left").withColumn("node", F.monotonically_increasing_id())
    nodes = written(numbered.select("node", "block", "high", "low", "least", "place", "n_shingles"), "shingle-classes")
    met = nodes.where("block is not null").select("block", "node", "n_shingles", F.col("place.doc_id").alias("__id"), F.col("place.body").alias("__body"))
    texts = keyed(docs).join(met, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("body") == F.col("__body")))
    members = written(once_a_batch(texts.select("block", "node", "n_shingles", "text")), "shingle-members")
    linked = connected_components(block_links(members, most))
    named = nodes.join(linked, "node", "left").withColumn("component", F.coalesce("component", "node"))
    named = cut(named.select("high", "low", "least", "component"))
    names = named.groupBy("component").agg(F.min("least").alias("component_id"))
    known = named.join(names, "component").select("high", "low", "component_id")
    joined = rows.select("doc_id", "n_shingles", "high", "low").join(known, ["high", "low"], "left")
    return joined.select("doc_id", "n_shingles", F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def once_a_batch(members: DataFrame) -> DataFrame:
    """``members`` without rows whose node came before in the same Arrow batch: repeated rows of one document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            first = np.sort(np.unique(batch.column("node").to_numpy(), return_index=True)[1])
            yield batch if len(first) == batch.num_rows else batch.take(pa.array(first))

    return members.mapInArrow(run, members.schema)


def op13(docs: DataFrame) -> DataFrame:
    """Digest of :func:`alike_groups`, its own columns."""
    return alike_groups(docs)
