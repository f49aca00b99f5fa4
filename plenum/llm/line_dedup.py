"""Fuzzy line deduplication over a corpus (operator 9)."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  (pa.compute)
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plenum.llm.components import connected_components
from plenum.llm.edits import alike, letter_counts, too_unlike
from plenum.llm.near import Check, first_places, suspects, verified_links
from plenum.llm.sketch import BANDS, CHUNK_BYTES, bands_of, marks_of, split_words, word_features
from plenum.llm.storage import cut, discard, drop_shuffles, written

SIMILARITY = 0.8  # of a link's edit distance at least
LAST = (1 << 63) - 1  # place of a null doc_id in the order
PUNCTUATION = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
NOT_BLANK = r"[^\x09-\x0D\x20-\x2F\x3A-\x40\x5B-\x60\x7B-\x7E]"  # what stays of a line with a word
FOLD = bytes.maketrans(bytes(range(65, 91)) + PUNCTUATION, bytes(range(97, 123)) + b" " * len(PUNCTUATION))
ODD = np.int64(0x1E3779B97F4A7C15)
LINE_COLUMNS = ["doc_id", "body", "spot", "high", "low", "mark", "bands"]


def normal(line: str) -> str:
    """A line for comparison: A-Z in lower case, ASCII punctuation as spaces, words one space apart."""
    return normal_bytes(line.encode("utf-8", "surrogatepass"))


def normal_bytes(line: bytes) -> str:
    """:func:`normal` of a line in UTF-8."""
    return b" ".join(line.translate(FOLD).split()).decode("utf-8", "surrogatepass")


def id_and_body(docs: DataFrame) -> tuple[Column, Column]:
    """What tells documents apart: the id (a null is the largest) and a hash of the text."""
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)), F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))


def chunks(texts: list[bytes], most: int = CHUNK_BYTES) -> Iterator[tuple[int, list[bytes]]]:
    """Runs of texts of about ``most`` bytes with the place of their first."""
    at = size = 0
    for i, text in enumerate(texts):
        size += len(text)
        if size >= most:
            yield at, texts[at : i + 1]
            at, size = i + 1, 0
    if at < len(texts):
        yield at, texts[at:]


def lines_of(texts: list[bytes]) -> tuple[np.ndarray, ...]:
    """Lines with a word: text, spot (line number, and above it the line's first byte in the text), two halves of the MD5 of the normalised line, mark and bands."""
    words = split_words(texts, FOLD)
    hashes, weights, counts, line = word_features(words)
    text = np.searchsorted(words.first_line, line, side="right") - 1
    head = np.flatnonzero(np.diff(words.line, prepend=-1))
    last = np.append(head[1:], len(words.line)) - 1
    data = words.data.tobytes()
    keys = b"".join([hashlib.md5(data[a:b]).digest() for a, b in zip(words.start[head].tolist(), words.end[last].tolist())] if len(head) else [])
    both = np.frombuffer(keys, "<i8").reshape(-1, 2)
    first = words.first_line[text]
    return text, words.line_start[line] - words.line_start[first] << 32 | line - first, both[:, 0], both[:, 1], marks_of(hashes, counts).view(np.int64), bands_of(hashes, weights, counts)


def corpus_lines(docs: DataFrame) -> DataFrame:
    """Lines of ``docs`` that have a word, one row each; ``spot`` orders the lines of a text and holds line number and place.

    ``high`` and ``low`` are the MD5 of the normalised line. Lines that are equal to an
    earlier one of the same Arrow batch have no ``bands``: these go whatever the rest
    of the corpus holds, so a very common line leaves each batch once. Their
    ``high`` and ``low`` tell their place only, so they are dealt evenly.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc, body = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            texts = batch.column(2).cast(pa.binary()).to_pylist()
            parts = []
            for at, some in chunks(texts):
                text, *rest = lines_of(some)
                if len(text):
                    parts.append((text + at, *rest))
            if not parts:
                continue
            text, spot, high, low, mark, bands = (np.concatenate(x) for x in zip(*parts))
            doc, body = doc[text], body[text]
            order = np.lexsort((spot, body, doc, low, high))
            same = lambda *columns: np.logical_and.reduce([x[order[1:]] == x[order[:-1]] for x in columns])
            again = np.zeros(len(text), bool)
            again[order[1:]] = same(high, low)
            once = np.ones(len(text), bool)
            once[order[1:]] = ~same(high, low, spot, body, doc)  # else the line of a repeated row
            packed = pa.FixedSizeBinaryArray.from_buffers(pa.binary(4 * BANDS), len(text), [None, pa.py_buffer(bands.tobytes())]).cast(pa.binary())
            hidden = pa.array(again)
            high, low = np.where(again, doc, high), np.where(again, body ^ spot * ODD, low)
            columns = [pa.array(x) for x in (doc, body, spot, high, low, mark)]
            out = pa.RecordBatch.from_arrays([*columns, pa.compute.if_else(hidden, pa.scalar(None, pa.binary()), packed)], LINE_COLUMNS)
            yield out if once.all() else out.filter(pa.array(once))

    name, body = id_and_body(docs)
    source = docs.select(name.alias("doc_id"), body.alias("body"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return source.mapInArrow(run, "doc_id long, body long, spot long, high long, low long, mark long, bands binary")


def keyed(docs: DataFrame) -> DataFrame:
    """``docs`` with ``__id`` and ``__body``: both joins of texts use them, so they share one shuffle."""
    name, body = id_and_body(docs)
    return docs.withColumn("__id", name).withColumn("__body", body)


def lines_at(docs: DataFrame, places: DataFrame) -> DataFrame:
    """``places`` (``doc_id``, ``body``, ``spot``, ...) with the ``line`` of the text there, in UTF-8."""
    rest = [c for c in places.columns if c not in ("doc_id", "body")]
    listed = places.groupBy(F.col("doc_id").alias("__doc"), F.col("body").alias("__hash")).agg(F.collect_list(F.struct(*rest)).alias("places"))
    found = keyed(docs).join(listed.hint("shuffle_hash"), (F.col("__id") == F.col("__doc")) & (F.col("__body") == F.col("__hash")))

    def with_line(place: Column) -> Column:
        onwards = F.substring(F.col("text").cast("string").cast("binary"), F.shiftright(place["spot"], 32).cast("int") + 1, F.lit((1 << 31) - 1))
        return F.struct(*[place[c].alias(c) for c in rest], F.substring_index(onwards.cast("string"), "\n", 1).cast("binary").alias("line"))

    return found.select(F.inline(F.transform("places", with_line)))


def same_lines(items: pa.ChunkedArray) -> tuple[Check, np.ndarray, float]:
    """A check of pairs by edit similarity of the normalised lines, with their lengths; a pair of one line (a repeated document) is alike."""
    lines = [normal_bytes(x) for x in items.to_pylist()]
    counts = letter_counts(lines)

    def check(pairs: list[tuple[int, int]]) -> np.ndarray:
        a, b = np.array(pairs, np.int64).T
        open_ = np.flatnonzero(~too_unlike(counts, a, b, SIMILARITY))
        out = np.zeros(len(pairs), bool)
        out[open_] = alike([(lines[i], lines[j]) for i, j in zip(a[open_].tolist(), b[open_].tolist())], SIMILARITY)
        return out

    return check, counts.sum(axis=1), SIMILARITY


def duplicate_lines(docs: DataFrame) -> DataFrame:
    """Lines to remove: ``doc_id``, ``body`` and ``spot`` of all but the first of each connected group.

    Lines that are equal once normalised form one node. Nodes link if their edit
    similarity (one minus distance over the longer length) is ``SIMILARITY`` or more.
    They are compared if they share a bucket (:func:`plenum.llm.sketch.bands_of`) and
    their SimHash marks are at most 20 bits apart, so a pair is found with a
    probability that falls with the share of its words that differ. First means
    smallest doc_id (null counts as largest), then hash of the text, then line number.
    """
    placed = written(first_places(corpus_lines(docs)), "places")
    drop_shuffles(docs.sparkSession)
    nodes = placed.where("node is not null")
    grouped = line_groups(docs, nodes)
    drop_shuffles(docs.sparkSession)
    place = F.struct("doc_id", "body", "spot")
    keep = grouped.groupBy("component").agg(F.min(place).alias("keep"))
    linked = grouped.join(keep, "component").where(place != F.col("keep"))
    again = placed.where("node is null").select("doc_id", "body", "spot")
    return again.unionByName(linked.select("doc_id", "body", "spot"))


def line_groups(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """``component`` and place of every node that has a link."""
    near = written(suspects(nodes, nodes.count()), "suspects")  # so that its shuffles can go before the texts are dealt
    drop_shuffles(docs.sparkSession)
    links = verified_links(lines_at(docs, near).withColumnRenamed("line", "item"), same_lines)
    grouped = cut(connected_components(links).join(nodes.drop("mark", "bands"), "node"))
    discard(near)
    return grouped


def dedup_lines(docs: DataFrame, counts: str = "line_counts") -> DataFrame:
    """``docs`` with repeated lines cut out of ``text``, and a struct column ``counts`` (``n_lines``, ``n_removed``, ``n_left``).

    ``n_left`` counts the lines with a word that stay. Lines keep their order and are
    joined by line feeds; other columns are as they were, but for one named like
    ``counts``, which is replaced. A null text stays null with no lines. Rows with
    equal doc_id and equal text count as one document: what goes from one goes
    from the other; rows that share an id, or have none, and differ in text are
    different documents. An empty table gives an empty result.
    """
    number = F.col("spot").bitwiseAND(F.lit((1 << 31) - 1)).cast("int")
    gone = duplicate_lines(docs).groupBy(F.col("doc_id").alias("__doc"), F.col("body").alias("__hash")).agg(F.array_sort(F.collect_set(number)).alias("__gone"))
    joined = keyed(docs).join(gone.hint("shuffle_hash"), (F.col("__id") == F.col("__doc")) & (F.col("__body") == F.col("__hash")), "left")
    joined = joined.withColumn("__lines", F.split(F.coalesce(F.col("text"), F.lit("")), "\n", -1))
    stays = F.when(F.col("__gone").isNull(), F.col("__lines")).otherwise(F.filter("__lines", lambda x, i: ~F.array_contains("__gone", i)))
    joined = joined.withColumn("__stays", stays)
    text = F.when(F.col("__gone").isNull(), F.col("text")).otherwise(F.array_join("__stays", "\n"))
    numbers = F.struct(
        F.when(F.col("text").isNull(), F.lit(0)).otherwise(F.size("__lines")).cast("long").alias("n_lines"),
        F.coalesce(F.size("__gone"), F.lit(0)).cast("long").alias("n_removed"),
        F.size(F.filter("__stays", lambda x: x.rlike(NOT_BLANK))).cast("long").alias("n_left"),
    )
    plain = [c for c in docs.columns if c.lower() != counts.lower()]
    return joined.select(*[text.alias(c) if c == "text" else F.col(c) for c in plain], numbers.alias(counts))


def op9(docs: DataFrame) -> DataFrame:
    """Digest of :func:`dedup_lines`: counts, and the SHA-256 of the text that is left."""
    done = dedup_lines(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    left = F.coalesce(F.col("text"), F.lit(""))
    return done.select("doc_id", "line_counts.n_lines", "line_counts.n_removed", F.length(left).cast("long").alias("n_chars_left"), F.sha2(left, 256).alias("kept_sha256"))
