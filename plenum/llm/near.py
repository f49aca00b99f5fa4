"""Groups of near-equal items: candidates from shared buckets, links verified inside the candidate sets.

Items are rows with a unique long ``node``, a SimHash ``mark`` and ``bands`` (bucket
names, as many for each item, see :mod:`plenum.llm.sketch`). Two items are candidates if
they share a bucket and their marks are at most ``RADIUS`` bits apart. A check on the items
themselves decides which candidates link.
"""

from __future__ import annotations

from collections.abc import Callable, Generator, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  (pa.compute)
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plenum.llm.grouped import bounds, slabs
from plenum.llm.sketch import BANDS, RADIUS, mixed
from plenum.llm.storage import cut, shuffle_width

ENTRIES = 4_000_000  # bucket entries that one task sorts, 12 bytes each
BLOCK = 256  # members of a set that are compared with all before at a time

Check = Callable[[list[tuple[int, int]]], np.ndarray]
Checks = Callable[[pa.ChunkedArray], tuple[Check, np.ndarray, float]]
Parts = Callable[[np.ndarray, int], np.ndarray]


def close_parts(marks: np.ndarray, radius: int = RADIUS) -> np.ndarray:
    """Label of each mark's part, parts being connected by marks at most ``radius`` bits apart.

    A part spreads from its first mark over the marks not reached yet, so one
    dense part costs a comparison of each mark with the few that are left.
    """
    label = np.full(len(marks), -1)
    left = np.arange(len(marks))
    while len(left):
        seed, left = left[0], left[1:]
        label[seed] = seed
        front = np.array([seed])
        while len(front) and len(left):
            near = np.zeros(len(left), bool)
            for lo in range(0, len(front), 64):
                open_ = np.flatnonzero(~near)
                if not len(open_):
                    break
                apart = np.bitwise_count(marks[front[lo : lo + 64], None] ^ marks[None, left[open_]]).min(axis=0)
                near[open_[apart <= radius]] = True
            front, left = left[near], left[~near]
            label[front] = seed
    return label


def sets_of(name: np.ndarray, mark: np.ndarray, band: np.ndarray, radius: int = RADIUS, parts: Parts = close_parts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Candidate sets (``set``, ``mark``, ``band``) of bucket entries: parts of two entries or more of one bucket, equal sets once with their first band.

    ``parts`` labels the marks of a bucket; two are compared right away.
    """
    order = np.sort(name.astype(np.uint64) << np.uint64(32) | np.arange(len(name), dtype=np.uint64))  # a task has under 2^32 entries
    name = (order >> np.uint64(32)).astype(np.uint32)
    order = (order & np.uint64(0xFFFFFFFF)).astype(np.int64)
    met = np.zeros(len(name) + 1, bool)
    met[1:-1] = name[1:] == name[:-1]
    shared = met[1:] | met[:-1]  # most entries are alone in their buckets
    name, order = name[shared], order[shared]
    mark, band = mark[order], band[order]
    order = np.lexsort((mark, name))
    name, mark, band = name[order], mark[order], band[order]
    begin, end = bounds(name)
    two = begin[end - begin == 2]
    two = two[np.bitwise_count(mark[two] ^ mark[two + 1]) <= radius]
    at, part = [two, two + 1], [two, two]
    for lo, hi in zip(begin[end - begin > 2].tolist(), end[end - begin > 2].tolist()):
        label = parts(mark[lo:hi], radius)
        size = np.bincount(label, minlength=hi - lo)[label]
        at.append(lo + np.flatnonzero(size > 1))
        part.append(lo + label[size > 1])
    at, part = np.concatenate(at), np.concatenate(part)
    order = np.lexsort((mark[at], part))
    at, part = at[order], part[order]
    once = np.ones(len(at), bool)
    once[1:] = (part[1:] != part[:-1]) | (mark[at[1:]] != mark[at[:-1]])
    at, part = at[once], part[once]  # a mark that several items have once; alone, it stands for them
    begin, end = bounds(part)
    key = np.add.reduceat(mixed(mark[at]), begin) if len(begin) else np.zeros(0, np.uint64)  # wraps around
    sets = np.repeat(mixed(key + (end - begin).astype(np.uint64)), end - begin)
    order = np.lexsort((band[at], mark[at], sets))
    sets, mark, band = sets[order], mark[at][order], band[at][order]
    once = np.ones(len(sets), bool)
    once[1:] = (sets[1:] != sets[:-1]) | (mark[1:] != mark[:-1])
    return sets[once], mark[once], band[once]


def packed_runs(values: np.ndarray, begin: np.ndarray, end: np.ndarray) -> pa.Array:
    """The bytes of each run of ``values``; the runs cover them one after another."""
    ends = np.append(begin, end[-1:]) * values.itemsize
    return pa.Array.from_buffers(pa.binary(), len(begin), [None, pa.py_buffer(ends.astype(np.int32).tobytes()), pa.py_buffer(values.tobytes())])


def candidate_sets(items: DataFrame, count: int, radius: int = RADIUS, keys: int = BANDS, parts: Parts = close_parts) -> DataFrame:
    """``set``, ``mark`` and ``band`` of the candidate sets among ``items`` (``mark``, ``bands`` of ``keys`` names), ``count`` rows or so.

    Bucket entries travel packed: a row is what one Arrow batch has for one of
    ``width`` partitions of the bucket names, so the shuffle moves few rows. Only
    buckets with candidates give rows. Each part of a bucket is one set; a set
    that several buckets have is kept once, with the first of their bands.
    """
    width = shuffle_width(items.sparkSession, count * keys, ENTRIES)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = np.frombuffer(b"".join(batch.column(1).to_pylist()), "<u4")
            marks, bands = np.repeat(batch.column(0).to_numpy(), keys), np.tile(np.arange(keys, dtype=np.uint8), batch.num_rows)
            place = names % np.uint32(width)
            order = np.argsort(place.astype(np.uint16) if width <= 1 << 16 else place, kind="stable")  # 16 bits are sorted by radix
            place = place[order]
            begin, end = bounds(place)
            packed = [packed_runs(x[order], begin, end) for x in (names, marks, bands)]
            yield pa.RecordBatch.from_arrays([pa.array(place[begin], pa.int64()), *packed], ["place", "names", "marks", "bands"])

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[bytes]] = [[], [], []]
        for batch in batches:
            for column, some in zip(held, batch.columns):
                column += some.to_pylist()
        found = sets_of(*(np.frombuffer(b"".join(x), kind) for x, kind in zip(held, ("<u4", np.uint64, np.uint8))), radius, parts)
        for lo in range(0, len(found[0]), 100_000):
            sets, marks, bands = (x[lo : lo + 100_000] for x in found)
            yield pa.RecordBatch.from_arrays([pa.array(sets.view(np.int64)), pa.array(marks.view(np.int64)), pa.array(bands.astype(np.int32))], ["set", "mark", "band"])

    dealt = items.select("mark", "bands").mapInArrow(deal, "place long, names binary, marks binary, bands binary")
    found = dealt.repartition(width, "place").select("names", "marks", "bands").mapInArrow(find, "set long, mark long, band int")
    return found.groupBy("set", "mark").agg(F.min("band").alias("band"))


def explore(marks: np.ndarray, before: np.ndarray, sizes: np.ndarray, least: float, radius: int = RADIUS) -> Generator[list[tuple[int, int]], np.ndarray, list[tuple[int, int]]]:
    """Links of one set: yields pairs to check, takes the answers, returns links that connect what alike pairs connect.

    ``before`` has a column for each band before the set's own: pairs that agree in
    one are left to that band's set. Pairs of which one's size is under ``least`` of the
    other's are never alike. Members come in order, a block at a time. A block is first tried on the first
    member of the largest group; then each member on members of other groups,
    the two nearest marks first, twice as many each round, until no candidate of another
    group is left. So near copies of one text cost a check or two each, however many they are.
    """
    n = len(marks)
    label, links = np.arange(n), []

    def settle(pairs: list[tuple[int, int]], same: np.ndarray) -> None:
        for i, j in [p for p, s in zip(pairs, same.tolist()) if s]:
            a, b = int(label[i]), int(label[j])
            if a != b:
                links.append((i, j))
                label[: top][label[: top] == max(a, b)] = min(a, b)

    for lo in range(0, n, BLOCK):
        top = min(n, lo + BLOCK)
        if lo:
            groups = np.bincount(label[:lo])
            head = int(groups.argmax())
            if groups[head] > 1:
                near = lo + np.flatnonzero((np.bitwise_count(marks[lo:top] ^ marks[head]) <= radius) & sizes_fit(sizes[lo:top], sizes[head], least))
                if len(near):
                    pairs = [(head, int(j)) for j in near]
                    settle(pairs, (yield pairs))
        else:
            head = 0
        inside = label[lo:top] == label[head]
        for mine, rows in ((lo + np.flatnonzero(inside), np.flatnonzero(label[:top] != label[head])), (lo + np.flatnonzero(~inside), np.arange(top))):
            if not len(mine) or not len(rows):
                continue
            apart = np.bitwise_count(marks[rows][:, None] ^ marks[mine][None, :])
            apart[(apart > radius) | (rows[:, None] >= mine[None, :]) & (rows[:, None] >= lo) | ~sizes_fit(sizes[rows][:, None], sizes[mine][None, :], least)] = 255
            for names in before.T:
                apart[names[rows][:, None] == names[mine][None, :]] = 255
            take = 2
            while True:
                apart[label[rows][:, None] == label[mine][None, :]] = 255
                open_ = np.flatnonzero((apart < 255).any(axis=0))
                if not len(open_):
                    break
                order = np.argsort(apart[:, open_], axis=0, kind="stable")[:take]
                pairs = []
                for c, column in enumerate(open_.tolist()):
                    for r in order[:, c].tolist():
                        if apart[r, column] < 255:
                            pairs.append((int(rows[r]), int(mine[column])))
                            apart[r, column] = 255
                settle(pairs, (yield pairs))
                take = min(2 * take, 64)
    return links


def sizes_fit(a: np.ndarray, b: np.ndarray, least: float) -> np.ndarray:
    """Whether the smaller of two sizes is ``least`` of the larger or more."""
    return np.minimum(a, b) >= least * np.maximum(a, b) - 1e-9


def links_of(marks: np.ndarray, bands: np.ndarray, ranges: list[tuple[int, int, int]], check: Check, sizes: np.ndarray | None = None, least: float = 0, radius: int = RADIUS) -> list[tuple[int, int]]:
    """Links inside each range (start, end, band) of members; the checks of all ranges are made together, round by round."""
    running, out = [], []
    sizes = np.ones(len(marks)) if sizes is None else sizes

    def step(lo: int, work: Generator, answer: np.ndarray | None) -> None:
        try:
            running.append((lo, work, work.send(answer)))
        except StopIteration as done:
            out.extend((lo + i, lo + j) for i, j in done.value)

    two = np.array([r[0] for r in ranges if r[1] - r[0] == 2], np.int64)
    met = np.logical_or.accumulate(bands[two] == bands[two + 1], axis=1) if len(two) else np.zeros((0, 1), bool)
    band = np.array([r[2] for r in ranges if r[1] - r[0] == 2], np.int64)
    earlier = (band > 0) & met[np.arange(len(two)), band - 1]
    two = two[~earlier & (np.bitwise_count(marks[two] ^ marks[two + 1]) <= radius) & sizes_fit(sizes[two], sizes[two + 1], least)]
    pairs = [(i, i + 1) for i in two.tolist()]
    if pairs:
        out.extend(pair for pair, same in zip(pairs, check(pairs).tolist()) if same)
    for lo, hi, band in ranges:
        if hi - lo > 2:
            step(lo, explore(marks[lo:hi], bands[lo:hi, :band], sizes[lo:hi], least, radius), None)
    while running:
        now, running = running, []
        same = check([(lo + i, lo + j) for lo, _, pairs in now for i, j in pairs])
        at = 0
        for lo, work, pairs in now:
            step(lo, work, same[at : at + len(pairs)])
            at += len(pairs)
    return out


def verified_links(members: DataFrame, checks: Checks, at_least: int = 1 << 16) -> DataFrame:
    """Links ``a``, ``b`` (nodes) of candidate sets: ``members`` has ``set``, ``band``, ``node``, ``mark``, ``bands`` and ``item``.

    ``checks`` gets the items of many sets and gives a check, which gets pairs of places and
    says which are alike, the items' sizes, and the share of the larger size that the smaller
    of an alike pair has at least; a pair is asked in the set of its first common band. A task
    holds ``at_least`` rows of whole sets, so its memory follows the near copies of
    one item that meet in one bucket; equal items are one node.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in slabs(batches, lambda t: t.column("set").to_numpy(), at_least):
            begin, end = bounds(table.column("set").to_numpy())
            node, mark, band = table.column("node").to_numpy(), table.column("mark").to_numpy().view(np.uint64), table.column("band").to_numpy()
            bands = np.frombuffer(b"".join(table.column("bands").to_pylist()), "<u4").reshape(table.num_rows, -1)
            ranges = [(lo, hi, int(band[lo])) for lo, hi in zip(begin.tolist(), end.tolist()) if hi - lo > 1]
            found = np.array(links_of(mark, bands, ranges, *checks(table.column("item"))), np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(node[found[:, 0]]), pa.array(node[found[:, 1]])], ["a", "b"])

    dealt = members.select("set", "band", "node", "mark", "bands", "item").repartition("set").sortWithinPartitions("set", "node")
    return dealt.mapInArrow(run, "a long, b long")


def suspects(items: DataFrame, count: int, keys: int = BANDS, parts: Parts = close_parts) -> DataFrame:
    """``set``, ``band`` and the columns of every item in a candidate set."""
    return cut(candidate_sets(items, count, keys=keys, parts=parts)).join(items, "mark")


def first_places(rows: DataFrame) -> DataFrame:
    """``rows`` (``high``, ``low``, ``doc_id``, ``body``, ``spot``, ``mark``, ``bands``) with a ``node`` number on the first row of each key.

    The key is ``high`` and ``low``; first means smallest ``doc_id``, ``body``, ``spot``; rows without bands are never first. Rows are
    dealt by key, sorted, and pass through with one key's state, so a key of
    many rows needs no memory. Rows of one place and key count once. Other rows lose mark and bands. Node numbers are
    unique and fixed once the result is written.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        last, number = None, TaskContext.get().partitionId() << 40
        for batch in batches:
            if not batch.num_rows:
                continue
            high, low = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            first = np.ones(batch.num_rows, bool)
            first[1:] = (high[1:] != high[:-1]) | (low[1:] != low[:-1])
            first[0] = last is None or last[:2] != (high[0], low[0])
            place = [batch.column(i).to_numpy() for i in range(5)]
            again = np.zeros(batch.num_rows, bool)  # a repeated row
            again[1:] = np.logical_and.reduce([x[1:] == x[:-1] for x in place])
            again[0] = last == tuple(x[0] for x in place)
            last = tuple(x[-1] for x in place)
            first &= batch.column(6).is_valid().to_numpy(zero_copy_only=False)
            node = number + np.cumsum(first) - 1
            number += int(first.sum())
            others = pa.array(~first)
            mark, bands = (pa.compute.if_else(others, pa.scalar(None, c.type), c) for c in (batch.column(5), batch.column(6)))
            out = pa.RecordBatch.from_arrays([*batch.columns[2:5], pa.array(node, mask=~first), mark, bands], ["doc_id", "body", "spot", "node", "mark", "bands"])
            yield out.filter(pa.array(~again)) if again.any() else out

    dealt = rows.repartition("high", "low").sortWithinPartitions("high", "low", "doc_id", "body", "spot")
    return dealt.select("high", "low", "doc_id", "body", "spot", "mark", "bands").mapInArrow(run, "doc_id long, body long, spot long, node long, mark long, bands binary")
