"""SimHash near-duplicate groups, linked through BK-trees (operator 1)."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plenum.llm.components import connected_components
from plenum.llm.grouped import bounds, slabs
from plenum.llm.line_dedup import chunks, id_and_body, keyed
from plenum.llm.near import Check, first_places, suspects, verified_links
from plenum.llm.sketch import BANDS, BASE, Words, bands_of, marks_of, mixed, shingle_features, split_words
from plenum.llm.storage import cut, drop_shuffles, written

LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
BLOCK_RADIUS, BLOCKS_EQUAL = 2, 3  # differing bits that shards of whole bit blocks never miss, and the blocks of such a shard


def majority_bits(hashes: np.ndarray) -> int:
    """64-bit majority of unsigned hashes: a bit is 1 if set in over half of them."""
    ones = np.unpackbits(hashes.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big")


def fingerprint(text: str | None, words_per_shingle: int = 3, seed: int = 42) -> int:
    """SimHash of a whole text over word shingles; zero for a text without words.

    A-Z are lower-cased and words are runs of anything but the six ASCII blanks:
    ``bytes.lower`` and ``bytes.split`` do exactly that on UTF-8.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    if len(words) < words_per_shingle:
        shingles = [b" ".join(words)]
    else:
        shingles = map(b" ".join, zip(*(words[i:] for i in range(words_per_shingle))))
    digest = xxhash.xxh64_intdigest
    return majority_bits(np.array([digest(s, seed) for s in shingles], dtype=np.uint64))


class BKTree:
    """BK-tree over 64-bit fingerprints: a child hangs on its integer Hamming distance to the parent."""

    __slots__ = ("children", "values")

    def __init__(self) -> None:
        self.values: list[int] = []
        self.children: list[dict[int, int]] = []

    def add(self, value: int) -> int:
        """Insert ``value`` and return its slot."""
        slot = len(self.values)
        if slot:
            at = 0
            while True:
                distance = (self.values[at] ^ value).bit_count()
                below = self.children[at].get(distance)
                if below is None:
                    self.children[at][distance] = slot
                    break
                at = below
        self.values.append(value)
        self.children.append({})
        return slot

    def within(self, value: int, radius: int) -> Iterator[int]:
        """Slots at most ``radius`` away, following only edges whose label can lead there."""
        stack = [0] if self.values else []
        while stack:
            at = stack.pop()
            distance = (self.values[at] ^ value).bit_count()
            if distance <= radius:
                yield at
            low, high = distance - radius, distance + radius
            stack.extend(slot for label, slot in self.children[at].items() if low <= label <= high)


def forest(values: list[int], radius: int) -> list[tuple[int, int]]:
    """Spanning forest (pairs of indexes) of the links among ``values`` within ``radius``."""
    tree, parent, out = BKTree(), list(range(len(values))), []

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for i, value in enumerate(values):
        for j in tree.within(value, radius):
            a, b = find(i), find(j)
            if a != b:
                parent[max(a, b)] = min(a, b)
                out.append((max(a, b), min(a, b)))
        tree.add(value)
    return out


def tree_parts(values: np.ndarray, radius: int) -> np.ndarray:
    """Label of each fingerprint's part, parts being connected by edges of at most ``radius`` bits, found in a BK-tree.

    The tree is that of :class:`BKTree` over the distinct fingerprints, split from the
    root down by distance, and all of them search it at once: a search follows only edges
    whose label can lead within the radius. One whose part a whole subtree belongs to does not
    enter it, so near copies of one text cost a comparison or two each, however many they are.
    """
    distinct, where = np.unique(values, return_inverse=True)
    label = np.arange(len(distinct))
    stack = [(label.copy(), label.copy())]  # a subtree, its root first, and those that search it
    while stack:
        tree, seekers = stack.pop()
        root, below = tree[0], tree[1:]
        if (label[below] == label[root]).all():
            seekers = seekers[label[seekers] != label[root]]
        if not len(seekers):
            continue
        apart = np.bitwise_count(distinct[seekers] ^ distinct[root]).astype(np.int64)
        joined = np.unique(np.append(label[seekers[apart <= radius]], label[root]))
        if len(joined) > 1:
            label[np.isin(label, joined)] = joined[0]
        edge = np.bitwise_count(distinct[below] ^ distinct[root]).astype(np.int64)
        stack.extend((below[edge == name], seekers[np.abs(apart - name) <= radius]) for name in np.unique(edge).tolist())
    return label[where]


def block_masks(radius: int, extra: int) -> list[int]:
    """Masks of every choice of ``extra`` out of ``radius + extra`` bit blocks.

    Two fingerprints within ``radius`` differ in at most ``radius`` blocks, so
    they agree on the ``extra`` whole blocks of a choice.
    """
    n = radius + extra
    edges = [round(64 * i / n) for i in range(n + 1)]
    masks = [((1 << (hi - lo)) - 1) << lo for lo, hi in zip(edges, edges[1:])]
    return [sum(chosen) for chosen in combinations(masks, extra)]


def block_names(fps: np.ndarray, radius: int = BLOCK_RADIUS, extra: int = BLOCKS_EQUAL) -> np.ndarray:
    """Shard names (32 bits, a column a choice of :func:`block_masks`) of fingerprints."""
    names = [mixed(mixed(fps & np.uint64(mask)) * np.uint64(BASE) + np.uint64(i)) for i, mask in enumerate(block_masks(radius, extra))]
    return (np.stack(names, axis=1) >> np.uint64(32)).astype("<u4")


def block_keys(fp: Column, radius: int, extra: int = BLOCKS_EQUAL) -> Column:
    """Shard keys of a fingerprint, one for each choice of :func:`block_masks`."""
    keys = []
    for number, mask in enumerate(block_masks(radius, extra)):
        signed = mask - (1 << 64) if mask >> 63 else mask
        keys.append(F.xxhash64(F.lit(number), fp.bitwiseAND(F.lit(signed))))
    return F.array(*keys)


def near_links(nodes: DataFrame, radius: int = 2) -> DataFrame:
    """Spanning links between nodes whose fingerprints are within ``radius``.

    ``nodes`` has ``node`` (long) and ``fp`` (long), fingerprints distinct. The
    links of each shard come from one BK-tree and form a forest: chains of links
    hold together exactly what all pairs would, without emitting the pairs.
    """

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in slabs(batches, lambda t: t.column("shard").to_numpy()):
            shard = table.column("shard").to_numpy()
            node, fp = table.column("node").to_numpy(), table.column("fp").to_numpy().view(np.uint64)
            begin, end = bounds(shard)
            a, b = [], []
            for lo, hi in zip(begin[end - begin > 1], end[end - begin > 1]):
                for i, j in forest(fp[lo:hi].tolist(), radius):
                    a.append(node[lo + i])
                    b.append(node[lo + j])
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    sharded = nodes.select(F.explode(block_keys(F.col("fp"), radius)).alias("shard"), "node", "fp")
    sharded = sharded.repartition("shard").sortWithinPartitions("shard", "node")
    return sharded.mapInArrow(link, "a long, b long").distinct()


def simhash_groups(docs: DataFrame, radius: int = 2, words_per_shingle: int = 3) -> DataFrame:
    """Near-duplicate groups of ``docs`` (needs ``doc_id`` long and ``text``; other columns are ignored).

    Returns ``doc_id``, ``fp`` (long) and ``component_id``, the smallest doc_id
    reachable over links of at most ``radius`` differing bits, one row per input
    row. Null and blank texts have fingerprint zero and link like any other;
    repeated rows keep their rows; a null doc_id gets its group's id but names
    no group (null if it is alone). An empty table gives an empty result. Only
    distinct fingerprints enter the search, so exact copies cost one node.
    """

    def marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = [fingerprint(x.as_py(), words_per_shingle) for x in batch.column(1)]
            fp = pa.array(np.array(values, dtype=np.uint64).view(np.int64), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), fp], ["doc_id", "fp"])

    source = docs.select(F.col("doc_id").cast("long"), F.col("text"))
    fps = cut(source.mapInArrow(marks, "doc_id long, fp long"))
    reps = fps.groupBy("fp").agg(F.min("doc_id").alias("node"))
    links = near_links(reps.where("node is not null"), radius)
    found = connected_components(links)
    groups = reps.join(found, "node", "left").select("fp", F.coalesce("component", "node").alias("component_id"))
    return fps.join(groups, "fp").select("doc_id", "fp", "component_id")


def shingle_set(text: bytes, words_per_shingle: int) -> np.ndarray:
    """Sorted hashes of the distinct word shingles of a text; shorter texts are one shingle as a whole."""
    return np.unique(shingle_features(split_words([text], LOWER), words_per_shingle)[0])


def jaccard_at_least(least: float, a: np.ndarray, b: np.ndarray) -> bool:
    if min(len(a), len(b)) < least * max(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both >= least * (len(a) + len(b) - both) - 1e-9


SHARDS = BANDS + len(block_masks(BLOCK_RADIUS, BLOCKS_EQUAL))


def marked_texts(docs: DataFrame, words_per_shingle: int) -> DataFrame:
    """Each row's place, MD5 of its words (``high``, ``low``), SimHash ``mark`` of its shingles, and ``bands``: the names of the ``SHARDS`` shards it goes to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, columns = batch.column(2).cast(pa.binary()).to_pylist(), []
            for _, some in chunks(texts):
                words = split_words(some, LOWER)
                hashes, counts = shingle_features(words, words_per_shingle)
                edge = np.searchsorted(words.line, words.first_line).tolist() + [len(words.start)]
                data = words.data.tobytes()
                ends = [b" ".join(some_words(data, words, lo, hi)) for lo, hi in zip(edge, edge[1:])]
                keys = np.frombuffer(b"".join(hashlib.md5(x).digest() for x in ends), "<i8").reshape(-1, 2)
                mark = marks_of(hashes, counts)
                shards = np.concatenate([bands_of(hashes, np.ones(len(hashes), np.float32), counts), block_names(mark)], axis=1)
                columns.append((keys[:, 0], keys[:, 1], mark.view(np.int64), shards))
            if not columns:
                continue
            high, low, mark, bands = (np.concatenate(x) for x in zip(*columns))
            packed = pa.FixedSizeBinaryArray.from_buffers(pa.binary(4 * SHARDS), len(high), [None, pa.py_buffer(bands.tobytes())]).cast(pa.binary())
            rest = [pa.array(np.zeros(len(high), np.int64)), *(pa.array(x) for x in (high, low, mark)), packed]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *rest], ["doc_id", "body", "spot", "high", "low", "mark", "bands"])

    name, body = id_and_body(docs)
    source = docs.select(name.alias("doc_id"), body.alias("body"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return source.mapInArrow(run, "doc_id long, body long, spot long, high long, low long, mark long, bands binary")


def some_words(data: bytes, words: Words, lo: int, hi: int) -> list[bytes]:
    """The words of places ``lo`` to ``hi``, lines run together."""
    return [data[words.start[lo] : words.end[hi - 1]]] if hi > lo and words.line[lo] == words.line[hi - 1] else [data[a:b] for a, b in zip(words.start[lo:hi].tolist(), words.end[lo:hi].tolist())]


def near_dedup(docs: DataFrame, similarity: float = 0.8, words_per_shingle: int = 5) -> DataFrame:
    """``docs`` without near-duplicates: of each group the row with the smallest doc_id stays.

    The steps are those of :func:`simhash_groups`: SimHash fingerprints of the word shingles,
    shards, in each shard a BK-tree over the distinct fingerprints and its edges, components.
    Edges reach 20 bits, since texts of similarity 0.8 differ in ten bits or so, and fingerprints
    meet in the shards of whole bit blocks, which miss none within two bits, and in
    shards named by four min-hashes (14 of them: 0.999 of the pairs at 0.8), for bit blocks
    would be too short at 20. What a tree connects is a candidate set; inside it rows link if the
    Jaccard similarity of their sets of five-word shingles is ``similarity`` or more, which is
    checked on the texts (by 64-bit hashes of the shingles). All columns are kept as they are. Texts
    without words are alike. Documents are told apart by doc_id and text, a null
    id being the largest: rows that share both stay or go together.
    """
    rows = written(marked_texts(docs, words_per_shingle), "near-marks")
    placed = written(first_places(rows), "near-places")
    nodes = placed.where("node is not null")
    near = suspects(nodes, nodes.count(), SHARDS, tree_parts)
    drop_shuffles(docs.sparkSession)
    texts = keyed(docs).select("__id", "__body", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("item")).dropDuplicates(["__id", "__body"])
    members = near.join(texts, (F.col("doc_id") == F.col("__id")) & (F.col("body") == F.col("__body")))

    def checks(items: pa.ChunkedArray) -> tuple[Check, np.ndarray, float]:
        known: dict[int, np.ndarray] = {}

        def shingles(i: int) -> np.ndarray:
            if i not in known:
                known[i] = shingle_set(items[i].as_py().encode("utf-8", "surrogatepass"), words_per_shingle)
            return known[i]

        return lambda pairs: np.array([jaccard_at_least(similarity, shingles(i), shingles(j)) for i, j in pairs], bool), np.ones(len(items)), 0

    grouped = cut(connected_components(verified_links(members, checks)).join(nodes.drop("mark", "bands"), "node"))
    place = F.struct("doc_id", "body")
    keep = grouped.groupBy("component").agg(F.min(place).alias("keep"))
    linked = grouped.join(keep, "component").where(place != F.col("keep")).select("doc_id", "body")
    copies = rows.select("doc_id", "body").distinct().join(nodes.select("doc_id", "body"), ["doc_id", "body"], "left_anti")
    gone = copies.unionByName(linked).select(F.col("doc_id").alias("__id"), F.col("body").alias("__body"))
    return keyed(docs).join(gone, ["__id", "__body"], "left_anti").select(*docs.columns)


def op1(docs: DataFrame) -> DataFrame:
    """Digest of :func:`simhash_groups`: ``doc_id``, 16-digit hexadecimal ``fingerprint``, ``component_id``."""
    hexed = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return simhash_groups(docs).select("doc_id", hexed.alias("fingerprint"), "component_id")
