"""Words and sketches of many texts at once: byte arrays in, hashes, SimHash marks and min-hash buckets out."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import xxhash

BANDS, ROWS = 14, 4  # buckets of a node, and weighted minima that name a bucket
RADIUS = 20  # differing bits of two marks that are compared at most
GRAM = 4  # bytes of the pieces that stand for words where there are few or very long ones
FEW_WORDS, LONG_WORD = 5, 24
CHUNK_BYTES = 1 << 17
DRAWN = 2_000  # features whose draws are held at a time

_rng = np.random.default_rng(20240301)
BYTE_HASH = _rng.integers(1, 2**63, 256, dtype=np.uint64)
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
MIX = np.uint64(0xD6E8FEB86659FD93)

_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """The first ``n`` powers of ``base`` modulo 2^64; the table is kept and grows with the longest chunk met."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        have = np.full(max(n, 1 << 20), base, np.uint64)
        have[0] = 1
        have = _powers[base] = np.multiply.accumulate(have)
    return have[:n]


def mixed(h: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over the 64."""
    h = (h ^ (h >> np.uint64(32))) * MIX
    h = (h ^ (h >> np.uint64(29))) * MIX
    return h ^ (h >> np.uint64(32))


def odd_numbers(n: int, seed: int) -> np.ndarray:
    return np.array([xxhash.xxh64_intdigest(str(i), seed) | 1 for i in range(n)], np.uint64)


TIMES = odd_numbers(BANDS * ROWS, 1).astype(np.uint32)


@dataclass
class Words:
    """Words of a few texts in one buffer in which words of a line stand one space apart.

    ``start`` and ``end`` of each word in ``data``; ``line``, the number of its line, counted over all texts;
    ``first_line``, the number of each text's first line; ``line_start``, where each line starts in the texts
    as they were, one byte apart.
    """

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    line: np.ndarray
    first_line: np.ndarray
    line_start: np.ndarray


BLANK = bytes(x in (9, 10, 11, 12, 13, 32) for x in range(256))  # for bytes.translate
WEIGHT = np.arange(1 << 10).astype(np.float32) ** np.float32(1.5)  # of words by size


def split_words(texts: list[bytes], fold: bytes) -> Words:
    """Words of ``texts`` once ``fold`` (a table for ``bytes.translate``) is applied; lines end at line feeds."""
    folded = b"\n".join(texts).translate(fold)
    raw = np.frombuffer(folded, np.uint8)
    sizes = np.array([len(t) + 1 for t in texts], np.int64)
    blank = np.ones(len(raw) + 2, bool)
    blank[1:-1] = np.frombuffer(folded.translate(BLANK), bool)
    edges = np.flatnonzero(blank[1:] != blank[:-1])
    start, end = edges[::2], edges[1::2]
    feeds = np.flatnonzero(raw == 10)
    before = np.searchsorted(start, feeds)
    line = np.repeat(np.arange(len(feeds) + 1), np.diff(before, prepend=0, append=len(start)))
    first_line = np.searchsorted(feeds, np.cumsum(sizes) - sizes)
    keep = ~blank[1:-1]
    joined = line[1:] == line[:-1]
    inner = start[1:][joined] - 1
    keep[inner] = True
    data = raw.copy()
    data[inner] = 32
    size = end - start
    begin = np.zeros(len(start), np.int64)
    np.cumsum(size[:-1] + joined, out=begin[1:])
    return Words(data[keep], begin, begin + size, line, first_line, np.append(0, feeds + 1))


def prefix_sums(data: np.ndarray) -> np.ndarray:
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(BYTE_HASH.take(data) * powers(BASE, len(data)), out=sums[1:])
    return sums


def span_hashes(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of the bytes of each span, whatever its place (``sums`` from :func:`prefix_sums`)."""
    return mixed((sums[end] - sums[start]) * powers(INVERSE, len(sums))[start] + (end - start).astype(np.uint64))


def word_features(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Features of each line with a word: hashes, weights, how many a line, and the lines' numbers.

    A line's features are its words, weighing their length to the power 1.5: long
    words are more of the edit distance, and rarer. Words of over ``LONG_WORD`` bytes
    and lines of fewer than ``FEW_WORDS`` words are taken as ``GRAM``-byte pieces
    instead, so scripts without spaces and short lines have features enough.
    """
    head = np.flatnonzero(np.diff(words.line, prepend=-1))
    n_words = np.diff(head, append=len(words.line))
    sums = prefix_sums(words.data)
    size = words.end - words.start
    weight = WEIGHT.take(size, mode="clip")
    large = np.flatnonzero(size >= len(WEIGHT))
    weight[large] = size[large].astype(np.float32) ** np.float32(1.5)
    row = np.repeat(np.arange(len(head)), n_words)
    line_start, line_end = words.start[head], words.end[np.append(head[1:], len(words.line)) - 1] if len(head) else words.end
    short = (n_words < FEW_WORDS) & (line_end - line_start >= GRAM)
    odd = short[row] | (size > LONG_WORD)
    if not odd.any():
        return span_hashes(sums, words.start, words.end), weight, n_words, words.line[head]
    long_word = (size > LONG_WORD) & ~short[row]
    a = np.concatenate([line_start[short], words.start[long_word]])
    b = np.concatenate([line_end[short], words.end[long_word]])
    owner = np.concatenate([np.flatnonzero(short), row[long_word]])
    count = b - a - GRAM + 1
    at = np.repeat(a - np.cumsum(count) + count, count) + np.arange(count.sum())
    hashes = np.concatenate([span_hashes(sums, words.start[~odd], words.end[~odd]), span_hashes(sums, at, at + GRAM)])
    weights = np.concatenate([weight[~odd], np.full(len(at), 2, np.float32)])
    rows = np.concatenate([row[~odd], np.repeat(owner, count)])
    order = np.argsort(rows, kind="stable")
    return hashes[order], weights[order], np.bincount(rows, minlength=len(head)), words.line[head]


def shingle_features(words: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all ``n``-word shingles of each text and how many a text; fewer words are one shingle, none too."""
    word = span_hashes(prefix_sums(words.data), words.start, words.end)
    texts = len(words.first_line)
    text = np.searchsorted(words.first_line, words.line, side="right") - 1
    counts = np.bincount(text, minlength=texts)
    begin = np.cumsum(counts) - counts
    many = np.maximum(counts - n + 1, 1)
    at = np.repeat(begin - np.cumsum(many) + many, many) + np.arange(many.sum())
    last = np.repeat(begin + counts, many)
    hashes = np.zeros(len(at), np.uint64)
    padded = np.append(word, np.zeros(n, np.uint64))
    for i in range(n):
        here = np.where(at + i < last, padded[at + i] | np.uint64(1), np.uint64(0))
        hashes = mixed(hashes * np.uint64(BASE) + here)
    return hashes, many


def marks_of(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """SimHash of each row of features, rows one after another (``counts`` features each, one at least).

    Bits are added as bytes, eight to a machine word; a byte holds rows of up to
    255 features, longer ones are added by themselves.
    """
    ends = np.cumsum(counts)
    ones = np.zeros((len(counts), 64), np.int64)
    at = 0
    while at < len(counts):
        base = ends[at] - counts[at]
        upto = max(at + 1, int(np.searchsorted(ends, base + 50_000, side="right")))
        if upto == at + 1 and counts[at] > 255:
            total = 0
            for lo in range(base, ends[at], 50_000):
                part = hashes[lo : min(lo + 50_000, ends[at])].astype(">u8").view(np.uint8).reshape(-1, 8)
                total = total + np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int64)
            ones[at] = total
        else:
            bits = np.unpackbits(hashes[base : ends[upto - 1]].astype(">u8").view(np.uint8)).view(np.uint64).reshape(-1, 8)
            ones[at:upto] = np.add.reduceat(bits, ends[at:upto] - counts[at:upto] - base, axis=0).view(np.uint8)
            for i in np.flatnonzero(counts[at:upto] > 255).tolist():
                lo, hi = ends[at + i] - counts[at + i] - base, ends[at + i] - base
                ones[at + i] = bits[lo:hi].view(np.uint8).sum(axis=0, dtype=np.int64)
        at = upto
    return np.packbits(2 * ones > counts[:, None], axis=1).view(">u8").ravel().astype(np.uint64)


def bands_of(hashes: np.ndarray, weights: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Bucket names (``BANDS`` of 32 bits) of each row of features.

    A name is made of ``ROWS`` weighted min-hashes over the set of features, so two
    rows share it with the power ``ROWS`` of the similarity of their sets.
    """
    ends = np.cumsum(counts)
    low = np.empty((len(counts), BANDS * ROWS), np.int32)
    short = (hashes >> np.uint64(32)).astype(np.uint32)
    scale = np.float32(1) / weights
    space = np.empty((2, DRAWN, BANDS * ROWS), np.uint32)
    at = 0

    def least(lo: int, hi: int) -> np.ndarray:
        """Draws of features as the bits of floats over zero, which compare like the floats, and faster."""
        drawn, scaled = space[0, : hi - lo], space[1, : hi - lo].view(np.float32)
        np.multiply(short[lo:hi, None], TIMES, out=drawn)
        np.right_shift(drawn, np.uint32(1), out=drawn)
        np.multiply(drawn.view(np.int32), scale[lo:hi, None], out=scaled, dtype=np.float32, casting="unsafe")
        return scaled.view(np.int32)

    while at < len(counts):
        base = int(ends[at] - counts[at])
        upto = max(at + 1, int(np.searchsorted(ends, base + DRAWN, side="right")))
        stop = int(ends[upto - 1])
        if stop - base > DRAWN:
            low[at] = np.min([least(i, min(i + DRAWN, stop)).min(axis=0) for i in range(base, stop, DRAWN)], axis=0)
        else:
            np.minimum.reduceat(least(base, stop), ends[at:upto] - counts[at:upto] - base, axis=0, out=low[at:upto])
        at = upto
    bits = low.view(np.uint32).reshape(-1, BANDS, ROWS)
    name = np.tile(np.arange(1, BANDS + 1, dtype=np.uint64), (len(bits), 1))
    for i in range(ROWS):
        name = mixed(name * np.uint64(BASE) + bits[:, :, i])
    return (name >> np.uint64(32)).astype("<u4")
