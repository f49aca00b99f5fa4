"""A stored full-text index: positions of stemmed words on disk, searched by term.

Layout under the index's folder: ``log`` (a :class:`CommitLog` of segments), and for each
segment ``postings`` (blocks of a ``term``'s ``ids``, with the ``sizes`` of the documents and the
``places`` of the term in each; partitioned by ``bucket``, a hash of the term, and
sorted by term) and ``docs`` (``id``, ``gone``). A search reads the buckets of its
terms only, and of those the row groups that may hold them.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plenum.operators.search import STOP_WORDS, SUFFIXES, query_terms
from plenum.sources.commits import CommitLog

BUCKETS = 64
BLOCK_WORDS = 1 << 22  # words of text that a task groups by term at a time


def stem_of(word: str) -> str:
    """:func:`plenum.operators.search.stem` for one word on the driver."""
    for suffix, put in SUFFIXES:
        ends = word.endswith(suffix) and not (suffix == "s" and word.endswith("ss"))
        if ends and len(word) >= len(suffix) + 3:
            return word[: len(word) - len(suffix)] + put
    return word


def stems(query: str) -> list[str]:
    """Distinct stems that a document must have to match ``query``."""
    return sorted({stem_of(w) for w in query_terms(query)})


def bucket_of(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int")


def posting_blocks(docs: DataFrame, id_column: str, *texts: str) -> DataFrame:
    """Postings of ``docs``: ``term``, ``ids``, ``sizes`` (words of each document) and ``places`` (of the term in it, ascending).

    A term has a block for each ``BLOCK_WORDS`` words of text that a task reads, so postings are
    grouped before they are shuffled. Stop words hold a place but are no terms.
    """
    stops = frozenset(STOP_WORDS)
    rows = docs.select(F.col(id_column).alias("id"), F.concat_ws(" ", *texts).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number_of: dict[str, int] = {}  # of a word's term in ``terms``, -1 for stop words
        terms: list[str] = []
        known: dict[str, int] = {}
        ids: list[pa.Array] = []
        numbers: list[np.ndarray] = []

        def number(word: str) -> int:
            found = -1
            if word not in stops:
                term = stem_of(word)
                found = known.setdefault(term, len(terms))
                if found == len(terms):
                    terms.append(term)
            number_of[word] = found
            return found

        words = 0
        for batch in batches:
            at = 0
            for i, text in enumerate(batch.column(1)):
                tokens = re.findall(r"[^\W_]+", (text.as_py() or "").lower())
                get = number_of.get
                numbers.append(np.array([n if (n := get(w)) is not None else number(w) for w in tokens], np.int32))
                words += len(tokens)
                if words >= BLOCK_WORDS:
                    ids.append(batch.column(0).slice(at, i + 1 - at))
                    yield from blocks(terms, ids, numbers)
                    number_of.clear(), terms.clear(), known.clear()
                    ids, numbers, words, at = [], [], 0, i + 1
            if at < batch.num_rows:
                ids.append(batch.column(0).slice(at))
        yield from blocks(terms, ids, numbers)

    def blocks(terms: list[str], ids: list[pa.Array], numbers: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        if not terms:
            return
        sizes = np.array([len(n) for n in numbers], np.int32)
        doc = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
        place = np.arange(len(doc), dtype=np.int32) - np.repeat(np.cumsum(sizes) - sizes, sizes).astype(np.int32)
        term = np.concatenate(numbers)
        order = np.argsort(term, kind="stable")[np.count_nonzero(term < 0) :]  # by term, then document, then place
        term, doc, place = term[order], doc[order], place[order]
        first = np.flatnonzero(np.concatenate(([True], (term[1:] != term[:-1]) | (doc[1:] != doc[:-1]))))  # of each document in a term
        spots = np.append(first, len(term)).astype(np.int32)
        docs_of = np.append(np.flatnonzero(np.concatenate(([True], term[first][1:] != term[first][:-1]))), len(first)).astype(np.int32)
        names, size = pa.concat_arrays(ids), pa.array(sizes)
        for lo in range(0, len(docs_of) - 1, 4096):
            edge = docs_of[lo : lo + 4097]
            inner = doc[first[edge[0] : edge[-1]]]
            outer = pa.array(edge - edge[0])
            spot = spots[edge[0] : edge[-1] + 1]
            listed = pa.ListArray.from_arrays(pa.array(spot - spot[0]), pa.array(place[spot[0] : spot[-1]]))
            columns = [pa.array([terms[t] for t in term[first[edge[:-1]]]]), *(pa.ListArray.from_arrays(outer, x) for x in (names.take(pa.array(inner)), size.take(pa.array(inner)), listed))]
            yield pa.RecordBatch.from_arrays(columns, ["term", "ids", "sizes", "places"])

    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"term string, ids array<{kind}>, sizes array<int>, places array<array<int>>").withColumn("bucket", bucket_of(F.col("term")))


def write_blocks(blocks: DataFrame, path: str) -> None:
    """Blocks by bucket, sorted by term in each file; Spark splits a bucket that a very common term makes large."""
    blocks.hint("rebalance", "bucket").sortWithinPartitions("bucket", "term").write.option("compression", "zstd").partitionBy("bucket").parquet(path)


class TextIndex:
    """The index under ``path``; created by the first :meth:`add`."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        self.log = CommitLog(spark, f"{self.path}/log")

    def add(self, docs: DataFrame, id_column: str, *texts: str) -> None:
        """Index ``docs`` as a new segment; a document of an earlier segment with the same id is replaced.

        ``id_column`` is unique in ``docs`` and not null. Null texts are empty: such a document matches nothing. Readers see the
        segment once it is whole; writers at the same time get segments one after another.
        """
        name = f"segment-{uuid.uuid4().hex}"
        write_blocks(posting_blocks(docs, id_column, *texts), f"{self.path}/{name}/postings")
        docs.select(F.col(id_column).alias("id"), F.lit(False).alias("gone")).write.parquet(f"{self.path}/{name}/docs")
        self.log.transact(lambda _: {"add": name})

    def remove(self, ids: DataFrame, id_column: str) -> None:
        """Take documents out: a segment that has their ids and no text."""
        name = f"segment-{uuid.uuid4().hex}"
        ids.select(F.col(id_column).alias("id"), F.lit(True).alias("gone")).distinct().write.parquet(f"{self.path}/{name}/docs")
        self.log.transact(lambda _: {"remove": name})

    def compact(self) -> None:
        """Rewrite the live rows as one segment. If segments come meanwhile, it is left for the next time."""
        entries = self.log.entries()
        if not entries:
            return
        name = f"segment-{uuid.uuid4().hex}"
        segments = self._segments(entries)
        live = self._live(segments)
        docs = live.count()
        rows = self._read(segments, None).join(live, ["id", "segment"], "left_semi")
        # Blocks of some 4,096 documents, however common a term is.
        block = F.pmod(F.xxhash64("id"), F.lit(max(1, docs // 4096)))
        listed = F.array_sort(F.collect_list(F.struct("id", "n_terms", "positions")))
        blocks = rows.groupBy("bucket", "term", block.alias("block")).agg(listed.alias("x"))
        blocks = blocks.select("bucket", "term", F.col("x.id").alias("ids"), F.col("x.n_terms").alias("sizes"), F.col("x.positions").alias("places"))
        write_blocks(blocks, f"{self.path}/{name}/postings")
        live.select("id", F.lit(False).alias("gone")).write.parquet(f"{self.path}/{name}/docs")
        self.log.transact(lambda now: {"compact": name} if len(now) == len(entries) else None)

    def _segments(self, entries: list[dict]) -> list[tuple[str, bool]]:
        """Folder names in order with whether they hold postings; a compaction stands for all before it."""
        out: list[tuple[str, bool]] = []
        for entry in entries:
            (kind, name), *_ = entry.items()
            out = [(name, True)] if kind == "compact" else [*out, (name, kind == "add")]
        return out

    def _live(self, segments: list[tuple[str, bool]]) -> DataFrame:
        """``id`` and ``segment`` (its number) of every document's newest version that is not a removal."""
        docs = None
        for number, (name, _) in enumerate(segments):
            rows = self.spark.read.parquet(f"{self.path}/{name}/docs").withColumn("segment", F.lit(number))
            docs = rows if docs is None else docs.unionByName(rows)
        newest = docs.groupBy("id").agg(F.max("segment").alias("segment"), F.max_by("gone", "segment").alias("gone"))
        return newest.where("not gone").drop("gone")

    def _read(self, segments: list[tuple[str, bool]], terms: list[str] | None) -> DataFrame:
        """``bucket``, ``term``, ``id``, ``n_terms``, ``positions`` and ``segment``, of ``terms`` only if given: filters on bucket and term reach the scan."""
        out = None
        for number, (name, has) in enumerate(segments):
            if not has:
                continue
            rows = self.spark.read.parquet(f"{self.path}/{name}/postings")
            if terms is not None:
                buckets = [r[0] for r in self.spark.createDataFrame([(t,) for t in terms], "term string").select(bucket_of(F.col("term"))).collect()]
                rows = rows.where(F.col("bucket").isin(buckets) & F.col("term").isin(terms))
            each = rows.select("bucket", "term", F.inline(F.arrays_zip("ids", "sizes", "places")))
            each = each.select("bucket", "term", F.col("ids").alias("id"), F.col("sizes").alias("n_terms"), F.col("places").alias("positions"), F.lit(number).alias("segment"))
            out = each if out is None else out.unionByName(each)
        return out

    def ranked(self, query: str) -> DataFrame:
        """``id`` and ``score`` of all documents with every term of ``query``; see :func:`cover_density`. A query of stop words matches nothing."""
        wanted = stems(query)
        segments = self._segments(self.log.entries())
        if not wanted or not any(has for _, has in segments):
            id_type = dict(self.spark.read.parquet(f"{self.path}/{segments[0][0]}/docs").dtypes)["id"] if segments else "long"
            return self.spark.createDataFrame([], f"id {id_type}, score double")
        hits = self._read(segments, wanted).drop("bucket")
        if len(wanted) > 1:
            full = hits.groupBy("id", "segment").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") == len(wanted))
            hits = hits.join(full.drop("n"), ["id", "segment"], "left_semi")
        if len(segments) > 1:
            hits = hits.join(self._live(segments), ["id", "segment"], "left_semi")
        return cover_density(hits, wanted)


def cover_density(hits: DataFrame, wanted: list[str]) -> DataFrame:
    """Rank documents by how often and how closely their terms stand together.

    ``hits`` has ``id``, ``n_terms``, ``term`` and ``positions``. A cover is a shortest run of
    words that holds all wanted terms; it counts the number of terms over its
    length, and the sum is divided by 1 + ln(words of the document). Positions of a document
    are read in order in one window, which needs no more than the last place of each term.
    """
    spots = hits.select("id", "n_terms", "term", F.explode("positions").alias("pos"))
    so_far = Window.partitionBy("id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    last = [F.last(F.when(F.col("term") == t, F.col("pos")), ignorenulls=True).over(so_far) for t in wanted]
    start = F.when(F.forall(F.array(*last), lambda x: x.isNotNull()), F.least(*last) if len(last) > 1 else last[0])
    placed = spots.select("id", "n_terms", "pos", start.alias("start"))
    before = F.lag("start").over(Window.partitionBy("id").orderBy("pos"))
    covers = placed.withColumn("before", before).where("start is not null and (before is null or start > before)")
    sums = covers.groupBy("id").agg(F.sum(len(wanted) / (F.col("pos") - F.col("start") + 1)).alias("sum"), F.first("n_terms").alias("n_terms"))
    return sums.select("id", (F.col("sum") / (1 + F.log(F.col("n_terms").cast("double")))).alias("score"))


def fragment(text: str | None, wanted: list[str], least: int = 30, most: int = 60) -> str | None:
    """The densest passage of ``least`` to ``most`` words, with every hit marked.

    Words are runs without blanks. Of all windows of ``most`` words that start at a
    hit, the one with the most different terms wins, then the most hits, then the
    first; it is cut after its last hit, filled up to ``least`` words (to the right, then to the left), and hits in it are marked.
    Without a hit it is the text's beginning; a null text gives null.
    """
    if text is None:
        return None
    words, targets = text.split(), set(wanted)
    terms = [[stem_of(m.lower()) for m in re.findall(r"[^\W_]+", w)] for w in words]
    hits = [(i, targets.intersection(t)) for i, t in enumerate(terms) if targets.intersection(t)]
    start, end = 0, 0
    best = (0, 0)
    left = 0
    for right in range(len(hits)):  # the window ends at this hit and starts at the first hit that still fits
        while hits[right][0] - hits[left][0] >= most:
            left += 1
        inside = hits[left : right + 1]
        value = (len(set().union(*(t for _, t in inside))), len(inside))
        if value > best:
            best, start, end = value, inside[0][0], inside[-1][0] + 1
    end = min(len(words), max(end, start + least))
    start = max(0, min(start, end - least))

    def mark(word: str) -> str:
        return re.sub(r"[^\W_]+", lambda m: f"<mark>{m[0]}</mark>" if stem_of(m[0].lower()) in targets else m[0], word)

    return " ".join(mark(w) for w in words[start:end])


def fragments(wanted: list[str], least: int = 30, most: int = 60):
    """:func:`fragment` as a column function, for the rows of a page of results."""

    @F.pandas_udf("string")
    def run(text: pd.Series) -> pd.Series:
        return text.map(lambda t: fragment(t, wanted, least, most))

    return run


def search(index: TextIndex, docs: DataFrame, id_column: str, text: str, query: str, limit: int = 20) -> DataFrame:
    """The best ``limit`` documents for ``query``: ``docs`` with ``score`` and ``fragment``, ties by id."""
    page = index.ranked(query).orderBy(F.desc("score"), "id").limit(limit)
    found = docs.join(F.broadcast(page), F.col(id_column) == F.col("id")).drop("id")
    return found.withColumn("fragment", fragments(stems(query))(F.col(text)))
