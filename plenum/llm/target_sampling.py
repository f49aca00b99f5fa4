"""Importance resampling towards a target distribution over hashed n-grams (operator 12).

The count matrix of documents by buckets is written once as CSR blocks. Its column
sums give the source's distribution, the same sums over the target texts the target's;
gains of the buckets follow, and a sparse matrix-vector product of the blocks with the
gains weighs every document.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plenum.llm.storage import cut, written

BUCKETS = 10_000
BLOCK_ENTRIES = 1 << 12  # from which a block of the matrix ends: it has so many and one document's entries at most, so that tasks read small rows
PIECE = 1 << 18  # words of a long text that are counted at a time
LEAST_WORDS = 20  # of a document that may be drawn
PERCENT = 25
BAND = 8  # scores that are ranked together; see ranked()
BLOCK = "doc_id array<long>, n_words array<long>, indptr array<long>, indices binary, counts binary"

NOT_WORD = bytes([*range(0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)])
FOLD = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
FOLD = bytes(32 if i in NOT_WORD and not 65 <= i <= 90 else FOLD[i] for i in range(256))


def hashed_features(words: list[bytes]) -> Iterator[np.ndarray]:
    """CRC-32 of all runs of one and two words, a piece of the text at a time."""
    for lo in range(0, len(words), PIECE):
        some = words[lo : lo + PIECE + 1]  # and the first word of the next piece, for the run across
        single = list(map(crc32, some))
        pairs = list(map(crc32, [b" " + w for w in some[1:]], single))
        yield np.array(single[:PIECE] + pairs, np.uint32)


def bucket_counts(text: str | None, buckets: int = BUCKETS) -> tuple[int, np.ndarray, np.ndarray]:
    """Number of words, and the buckets of the text's features with their counts."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(FOLD).split()
    total: np.ndarray | None = None
    for hashes in hashed_features(words):
        if len(words) <= PIECE:
            return len(words), *np.unique((hashes % buckets).astype(np.int32), return_counts=True)
        more = np.bincount((hashes % buckets).astype(np.int64), minlength=buckets)
        total = more if total is None else total + more
    if total is None:
        return 0, np.zeros(0, np.int32), np.zeros(0, np.int64)
    return len(words), np.flatnonzero(total).astype(np.int32), total[total > 0]


def csr_blocks(docs: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """``docs`` (``doc_id``, ``text``) as rows of CSR blocks: ids, words, row pointers, buckets and counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list[int | None] = []
        rows: list[tuple[int, np.ndarray, np.ndarray]] = []
        size = 0
        for batch in batches:
            for doc, text in zip(*batch.columns):
                text = text.as_py()
                ids.append(doc.as_py())
                rows.append(bucket_counts(text, buckets))
                size += len(rows[-1][1]) + 1
                if size >= BLOCK_ENTRIES:
                    yield block(ids, rows)
                    ids, rows, size = [], [], 0
        if ids:
            yield block(ids, rows)

    def block(ids: list, rows: list) -> pa.RecordBatch:
        n_words, indices, counts = zip(*rows)
        one = lambda values, kind: pa.array([values], pa.list_(kind))
        indptr = np.cumsum([0, *map(len, indices)])
        columns = [one(ids, pa.int64()), one(n_words, pa.int64()), one(indptr, pa.int64()), *(pa.array([np.concatenate(x).astype("<i4").tobytes()], pa.binary()) for x in (indices, counts))]
        return pa.RecordBatch.from_arrays(columns, ["doc_id", "n_words", "indptr", "indices", "counts"])

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return source.mapInArrow(run, BLOCK)


def entries(batch: pa.RecordBatch, name: str) -> list[np.ndarray]:
    """Buckets or counts of each block of a batch."""
    return [np.frombuffer(x.as_py(), "<i4") for x in batch.column(name)]


def column_sums(blocks: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """Count of each bucket over all blocks, exactly; a vector of ``buckets`` numbers is all that reaches the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(buckets, np.int64)
        for batch in batches:
            for indices, counts in zip(entries(batch, "indices"), entries(batch, "counts")):
                sums += np.bincount(indices, counts, buckets).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(np.flatnonzero(sums)), pa.array(sums[sums > 0])], ["bucket", "n"])

    total = np.zeros(buckets, np.int64)
    for bucket, n in blocks.select("indices", "counts").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n")).collect():
        total[bucket] = n
    return total


def bucket_gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """``floor(1000 ln((t + 1)(S + B) / ((s + 1)(T + B))))`` of each of B buckets."""
    # Python's exact integers up to the one division, so that no product overflows.
    big_s, big_t = int(source.sum()) + len(source), int(target.sum()) + len(target)
    ratios = [(t + 1) * big_s / ((s + 1) * big_t) for s, t in zip(source.tolist(), target.tolist())]
    return np.array([math.floor(1000 * math.log(r)) for r in ratios], np.int64)


def weighed(blocks: DataFrame, gains: np.ndarray) -> DataFrame:
    """``doc_id``, ``n_words``, ``n_features`` and ``weight`` (floored mean gain) of each row: blocks times gains."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            parts = []
            for indptr, indices, counts in zip(batch.column("indptr"), entries(batch, "indices"), entries(batch, "counts")):
                ends = indptr.values.to_numpy()
                sums = np.concatenate(([0], np.cumsum(counts * gains[indices])))[ends]
                features = np.concatenate(([0], np.cumsum(counts, dtype=np.int64)))[ends]
                parts.append((np.diff(sums), np.diff(features)))
            sums, features = (np.concatenate(x) for x in zip(*parts))
            weight = np.where(features > 0, sums // np.maximum(features, 1), 0)
            columns = [batch.column("doc_id").flatten(), batch.column("n_words").flatten(), pa.array(features), pa.array(weight)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_words", "n_features", "weight"])

    return blocks.mapInArrow(run, "doc_id long, n_words long, n_features long, weight long")


def ranked(scored: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS) -> DataFrame:
    """``scored`` with the ``rank`` of the ``percent`` highest scores of rows with ``least_words`` words, null for the rest.

    Scores are whole numbers between about -40,000 and 60,000, whatever the
    corpus, so there are at most some 12,000 bands of ``BAND`` neighbouring scores. Their
    counts go to the driver, which finds where each band's ranks begin; rows are
    ordered inside bands only, and bands past the last rank not at all.
    """
    spark = scored.sparkSession
    fit = F.col("n_words") >= least_words
    bands = scored.where(fit).groupBy(F.floor(F.col("score") / BAND).alias("band")).agg(F.count(F.lit(1)).alias("n")).collect()
    budget = percent * sum(r["n"] for r in bands) // 100
    begins, at = [], 0
    for r in sorted(bands, key=lambda r: -r["band"]):
        if at >= budget:
            break
        begins.append((r["band"], at))
        at += r["n"]
    starts = spark.createDataFrame(begins, "band long, begin long")
    rows = scored.withColumn("band", F.when(fit, F.floor(F.col("score") / BAND)))
    drawn = rows.join(F.broadcast(starts), "band", "left")
    order = Window.partitionBy("band").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last(), "weight", "n_features")
    rank = F.col("begin") + F.row_number().over(order)
    placed = drawn.where("begin is not null").withColumn("rank", F.when(rank <= budget, rank).cast("long"))
    return placed.unionByName(drawn.where("begin is null").withColumn("rank", F.lit(None).cast("long"))).drop("band", "begin")


def resampled(docs: DataFrame, target: DataFrame, percent: int = PERCENT, seed: str = "7") -> DataFrame:
    """Rows of ``docs`` (``doc_id``, ``text``) weighed by likeness to ``target`` (``text``), and a draw without replacement.

    Features are all runs of one or two words (:data:`FOLD` has the characters). ``weight`` is the
    floored mean of the features' gains (none: 0); ``score`` adds Gumbel noise that only
    the id decides, so the highest scores are a draw in proportion to the exponentials of the weights. Returns ``doc_id``,
    ``n_words``, ``n_features``, ``weight``, ``score`` and ``rank``, one row per input row.
    Null and empty texts have no features and are never drawn. A null doc_id has the noise of an empty
    id and comes last in a tie; equal ids tie by weight and number of features. An empty table gives an empty result; other columns are ignored.
    """
    blocks = written(csr_blocks(docs), "csr")
    wanted = csr_blocks(target.select(F.lit(0).alias("doc_id"), "text"))
    gains = bucket_gains(column_sums(blocks), column_sums(wanted))
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))
    scored = weighed(blocks, gains).withColumn("score", (F.col("weight") + noise).cast("long"))
    return ranked(cut(scored), percent)


def op12(docs: DataFrame, target: DataFrame) -> DataFrame:
    """Digest of :func:`resampled`, its own columns without ``n_words``."""
    return resampled(docs, target).select("doc_id", "n_features", "weight", "score", "rank")
