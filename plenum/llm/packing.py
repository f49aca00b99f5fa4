"""Best-two-fit packing of documents in fixed-length sequences (operator 10)."""

from __future__ import annotations

import re
import zlib
from bisect import bisect_right
from collections.abc import Iterator
from functools import cache
from unicodedata import normalize

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plenum.llm.storage import cut

CAPACITY = 2048
END_ID = 0
CACHE_WORDS = 400_000  # words whose ids a worker keeps
BUCKET_ROWS = 50_000  # pieces of one length that one task numbers


@cache
def tokenizer(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def byte_letters() -> dict[int, str]:
    """Characters that a byte-level vocabulary writes for bytes: printable ones stand for themselves, the others follow from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


BYTE_LETTERS = byte_letters()
TAIL = ".,;:!?*#$%&"  # marks that are often written after a word
CONTROLS = re.compile("[\x1c-\x1f]")  # white space to Python, not to the tokenizer


class WordIds(dict):
    """Ids of words without white space as bytes of unsigned 32-bit integers, worked out once a word.

    The tokenizer drops white space first and then splits letters from marks, so
    a word followed by marks is encoded as both in a row. A word of letters alone
    is one pre-token: it goes straight to the tokenizer's own BPE model, after its
    own normalizer if it is not ASCII. Everything else goes through the whole tokenizer.
    The cache forgets all when it is full.
    """

    def __init__(self, path: str) -> None:
        super().__init__()
        self.whole = tokenizer(path)
        self.model, self.normal = self.whole.model, self.whole.normalizer
        self.cores: dict[str, bytes] = {}
        self.special = [t.content for t in self.whole.get_added_tokens_decoder().values()]  # found by exact case, before the normalizer

    def __missing__(self, word: str) -> bytes:
        if len(self) >= CACHE_WORDS:
            self.clear()
            self.cores.clear()
        core = word.rstrip(TAIL)
        if not core or core == word or not normalize("NFC", core[-1]).lower().isalnum():  # else its marks run on into the tail
            value = self.core(word)
        else:
            value = self.core(core) + self[word[len(core) :]]
        self[word] = value
        return value

    def core(self, word: str) -> bytes:
        key = word.lower() if word.isascii() else word
        if key != word and any(x in key or x in word for x in self.special):
            key = word
        if key not in self.cores:
            self.cores[key] = np.array(self.ids(key), "<u4").tobytes()
        return self.cores[key]

    def ids(self, word: str) -> list[int]:
        if word.isalpha():
            text = word if word.isascii() else self.normal.normalize_str(word)
            if text.isalpha():
                return [t.id for t in self.model.tokenize(text if text.isascii() else text.encode().decode("latin-1").translate(BYTE_LETTERS))]
        return self.whole.encode(word, add_special_tokens=False).ids


word_ids = cache(WordIds)


def token_ids(texts: list[str], path: str) -> list[np.ndarray]:
    """Ids of each text without special tokens, as unsigned 32-bit integers."""
    known = word_ids(path)
    split = (re.split("[ \t\n\r\f\v]+", t) if CONTROLS.search(t) else t.split() for t in texts)
    return [np.frombuffer(b"".join(map(known.__getitem__, words)), "<u4") for words in split]


def cut_pieces(docs: DataFrame, path: str, capacity: int = CAPACITY) -> DataFrame:
    """Pieces of every document: at most ``capacity`` ids, only longer documents are cut.

    Null texts count as empty and give one piece with the end id alone.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        end = np.array([END_ID], "<u4")
        for batch in batches:
            doc, piece, start, length, crc = [], [], [], [], []
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                ids = token_ids([x.as_py() or "" for x in part.column(1)], path)
                for name, row in zip(part.column(0).to_pylist(), ids):
                    row = np.concatenate([row, end])
                    for n, lo in enumerate(range(0, len(row), capacity)):
                        chunk = row[lo : lo + capacity]
                        doc.append(name)
                        piece.append(n)
                        start.append(lo)
                        length.append(len(chunk))
                        crc.append(zlib.crc32(chunk.tobytes()))
            columns = [pa.array(doc, pa.int64()), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "piece", "start", "length", "ids_crc32"])

    source = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return source.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


class Stock:
    """Unpacked pieces by length, with the largest length up to a bound found by bisection."""

    def __init__(self, counts: dict[int, int]) -> None:
        self.left = {n: c for n, c in counts.items() if c}
        self.sizes = sorted(self.left)

    def largest(self, most: int) -> int:
        at = bisect_right(self.sizes, most)
        return self.sizes[at - 1] if at else 0

    def take(self, size: int, times: int = 1) -> None:
        self.left[size] -= times
        if not self.left[size]:
            del self.left[size]
            self.sizes.remove(size)

    def give(self, size: int, times: int = 1) -> None:
        if size not in self.left:
            self.left[size] = 0
            self.sizes.insert(bisect_right(self.sizes, size), size)
        self.left[size] += times

    def tightest_pair(self, gap: int) -> tuple[int, int]:
        """Two stocked pieces with the largest sum up to ``gap``; (0, 0) if no two fit."""
        best, low, high = (0, 0), 0, bisect_right(self.sizes, gap) - 1
        while low <= high:
            a, b = self.sizes[low], self.sizes[high]
            if a + b > gap:
                high -= 1
                continue
            if a + b > sum(best) and (a != b or self.left[a] > 1):
                best = (b, a)
                if a + b == gap:
                    break
            low += 1
        if high >= 0:  # the meeting point alone may hold two of one size
            for size in self.sizes[max(0, low - 2) : low + 1]:
                if 2 * size <= gap and self.left[size] > 1 and 2 * size > sum(best):
                    best = (size, size)
        return best


def best_two_fit(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """Bins as (lengths, number of bins alike) for so many pieces of each length.

    A bin is filled greedily with the largest piece that fits. If a gap is left,
    its smallest piece is taken out when two unpacked pieces fill the widened gap
    more tightly. A bin that the stock allows several times is made as often as
    it allows, so the work follows the number of distinct lengths, not of pieces.
    """
    stock, out = Stock(counts), []
    while stock.sizes:
        bin_, gap = [], capacity
        while (size := stock.largest(gap)) > 0:
            stock.take(size)
            bin_.append(size)
            gap -= size
        if gap and len(bin_) > 1:
            smallest = bin_[-1]
            pair = stock.tightest_pair(gap + smallest)
            if sum(pair) > smallest:
                bin_.pop()
                stock.give(smallest)
                for size in pair:
                    stock.take(size)
                    bin_.append(size)
        need: dict[int, int] = {}
        for size in bin_:
            need[size] = need.get(size, 0) + 1
        more = min(stock.left.get(size, 0) // n for size, n in need.items())
        for size, n in need.items():
            if more:
                stock.take(size, more * n)
        out.append((tuple(bin_), more + 1))
    return out


def placements(bins: list[tuple[tuple[int, ...], int]]) -> dict[int, np.ndarray]:
    """For each length rows (first rank, first sequence, offset): ranks count the pieces of the length."""
    used: dict[int, int] = {}
    rows: dict[int, list[tuple[int, int, int]]] = {}
    sequence = 0
    for lengths, times in bins:
        offset = 0
        for n in lengths:
            rank = used.get(n, 0)
            rows.setdefault(n, []).append((rank, sequence, offset))
            used[n] = rank + times
            offset += n
        sequence += times
    return {n: np.array(r, np.int64) for n, r in rows.items()}


def pack(docs: DataFrame, path: str, capacity: int = CAPACITY) -> DataFrame:
    """Sequences for every document of ``docs`` (``doc_id``, ``text``), packed by best-two-fit.

    Only the counts of pieces by length (at most ``capacity`` numbers) decide the
    bins, so the driver plans them on that table, however many rows there are.
    Pieces of a length are numbered in hash buckets with prefix sums of the
    bucket counts; a worker then looks up each number's place. Repeated rows are
    packed each. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    pieces = cut(cut_pieces(docs, path, capacity))
    per_length = pieces.groupBy("length").count().collect()  # at most `capacity` rows
    bins = best_two_fit({r["length"]: r["count"] for r in per_length}, capacity)
    shared = spark.sparkContext.broadcast(placements(bins))  # at most a few intervals a distinct length and bin kind
    total = sum(r["count"] for r in per_length)
    buckets = -(-total // BUCKET_ROWS)
    keyed = pieces.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(max(1, buckets))))
    counts = keyed.groupBy("length", "bucket").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("length", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("length", "bucket").orderBy("doc_id", "piece")
    ranked = keyed.withColumn("place", F.row_number().over(inside) - 1).join(base, ["length", "bucket"])
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("base") + F.col("place")).alias("rank"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        for batch in batches:
            length, rank = batch.column(3).to_numpy(), batch.column(5).to_numpy()
            sequence, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            for n in np.unique(length):
                mine = length == n
                rows = table[int(n)]
                at = np.searchsorted(rows[:, 0], rank[mine], side="right") - 1
                sequence[mine] = rows[at, 1] + rank[mine] - rows[at, 0]
                offset[mine] = rows[at, 2]
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sequence), pa.array(offset)], [*batch.schema.names[:5], "sequence_id", "offset"])

    return ranked.mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def op10(docs: DataFrame) -> DataFrame:
    """Sequences of at most 2048 ids of word_bpe_49k.json."""
    import public_tokenizers

    return pack(docs, public_tokenizers.path("word_bpe_49k.json"))
