"""Streaming over rows that are clustered by key, a few Arrow batches at a time."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa


def slabs(batches: Iterator[pa.RecordBatch], keys_of: Callable[[pa.Table], np.ndarray], at_least: int = 65536) -> Iterator[pa.Table]:
    """Tables of whole groups from batches in which equal keys are neighbours.

    ``keys_of`` gives the key columns of a table as rows of an array. A table ends
    where a key ends and has about ``at_least`` rows, or more when one group alone
    is larger.
    """
    held: list[pa.RecordBatch] = []
    rows, wanted = 0, at_least
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        rows += batch.num_rows
        if rows < wanted:
            continue
        table = pa.Table.from_batches(held)
        last = int(bounds(keys_of(table))[0][-1])
        if last:
            yield table.slice(0, last)
            rest = table.slice(last)
            held, rows, wanted = rest.to_batches(), rest.num_rows, max(at_least, 2 * rest.num_rows)
        else:
            wanted = 2 * rows
    if held:
        yield pa.Table.from_batches(held)


def bounds(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and past-the-last index of each run of equal keys; keys are one row, or one row a key column."""
    keys = np.atleast_2d(keys)
    if not keys.shape[1]:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    starts = np.flatnonzero(np.concatenate(([True], (keys[:, 1:] != keys[:, :-1]).any(axis=0))))
    return starts, np.append(starts[1:], keys.shape[1])
