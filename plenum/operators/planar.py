"""Shapes of few edges, whole and many at a time in arrays: what ``shapes`` does over rows of edges for shapes of many.

A shape is a run of edges (px, py, qx, qy) in grid steps, ``p`` before ``q``. Shapes of like
size are padded to one length and handled together; no shape needs another one.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

CELLS = 1 << 20  # cells of the arrays that one step holds


def runs_of(owner: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """First row and number of rows of owners 0 to ``n`` - 1; ``owner`` is sorted."""
    size = np.bincount(owner, minlength=n)
    return np.cumsum(size) - size, size


def alike(size: np.ndarray, cells: Callable[[int], int]) -> Iterator[tuple[np.ndarray, int]]:
    """Owners of like size that are handled together, and the most rows of one; those without rows are left out."""
    order = np.argsort(size, kind="stable")
    order = order[size[order] > 0]
    at = len(order)
    while at:
        most = int(size[order[at - 1]])
        low = max(0, at - max(1, CELLS // cells(most)))
        yield order[low:at], most
        at = low


def padded(values: np.ndarray, first: np.ndarray, size: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of some owners as (owner, place), NaN beyond the last, and the number of the row at each place."""
    place = first[:, None] + np.arange(most)
    beyond = np.arange(most) >= size[:, None]
    place[beyond] = 0
    out = values[place]
    out[beyond] = np.nan
    return out, place


def odd(owner: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges that a shape has an odd number of times, each once, in order of owner, p and q."""
    order = np.lexsort((edges[:, 3], edges[:, 2], edges[:, 1], edges[:, 0], owner))
    owner, edges = owner[order], edges[order]
    new = np.ones(len(owner), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (edges[1:] != edges[:-1]).any(axis=1)
    begin = np.flatnonzero(new)
    kept = begin[np.diff(np.append(begin, len(owner))) % 2 == 1]
    return owner[kept], edges[kept]


def turn(px, py, qx, qy, x, y):
    """Twice the area of the triangle p, q, (x, y); positive if (x, y) lies on the left of p to q."""
    return (qx - px) * (y - py) - (qy - py) * (x - px)


def touching(px, py, qx, qy, x, y, turned):
    """Does (x, y) lie within a grain of the edge, between its ends?"""
    along = (x - px) * (qx - px) + (y - py) * (qy - py)
    square = (qx - px) * (qx - px) + (qy - py) * (qy - py)
    end = ((x == px) & (y == py)) | ((x == qx) & (y == qy))
    return ~end & (along > 0) & (along < square) & (turned * turned <= square)


def close_pairs(owner: np.ndarray, edges: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of edges of a shape whose boxes come within a grain, the smaller edge first."""
    first, size = runs_of(owner, n)
    found = []
    for some, most in alike(size, lambda k: k * k):
        e, row = padded(edges, first[some], size[some], most)
        left, right = e[:, :, 0], e[:, :, 2] + 1
        low, high = np.minimum(e[:, :, 1], e[:, :, 3]), np.maximum(e[:, :, 1], e[:, :, 3]) + 1
        # Edges stand in order of px, so of two the later one begins further right.
        near = left[:, None, :] <= right[:, :, None]
        near &= low[:, :, None] <= high[:, None, :]
        near &= low[:, None, :] <= high[:, :, None]
        near &= np.triu(np.ones((most, most), bool), 1)
        s, a, b = np.nonzero(near)
        found.append((row[s, a], row[s, b]))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate([x[0] for x in found]), np.concatenate([x[1] for x in found])


def cut_once(owner: np.ndarray, edges: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges cut where they cross or touch others of their shape."""
    i, j = close_pairs(owner, edges, n)
    a, b = edges[i].T, edges[j].T
    a_p, a_q = turn(*b, a[0], a[1]), turn(*b, a[2], a[3])
    b_p, b_q = turn(*a, b[0], b[1]), turn(*a, b[2], b[3])
    touch = [touching(*a, b[0], b[1], b_p), touching(*a, b[2], b[3], b_q), touching(*b, a[0], a[1], a_p), touching(*b, a[2], a[3], a_q)]
    proper = ~(touch[0] | touch[1] | touch[2] | touch[3]) & (np.sign(a_p) * np.sign(a_q) < 0) & (np.sign(b_p) * np.sign(b_q) < 0)
    k = np.flatnonzero(proper)
    share = a_p[k] / (a_p[k] - a_q[k])
    met = [np.rint(a[c, k] + (a[c + 2, k] - a[c, k]) * share) + 0.0 for c in (0, 1)]
    t = [np.flatnonzero(x) for x in touch]
    edge = np.concatenate([np.arange(len(edges)), i[t[0]], i[t[1]], j[t[2]], j[t[3]], i[k], j[k], np.arange(len(edges))])
    x = np.concatenate([edges[:, 0], b[0, t[0]], b[2, t[1]], a[0, t[2]], a[2, t[3]], met[0], met[0], edges[:, 2]])
    y = np.concatenate([edges[:, 1], b[1, t[0]], b[3, t[1]], a[1, t[2]], a[3, t[3]], met[1], met[1], edges[:, 3]])
    px, py, qx, qy = edges[edge].T
    along = (x - px) * (qx - px) + (y - py) * (qy - py)
    along[: len(edges)], along[len(edge) - len(edges) :] = -np.inf, np.inf
    order = np.lexsort((y, x, along, edge))
    edge, x, y = edge[order], x[order], y[order]
    piece = np.flatnonzero((edge[1:] == edge[:-1]) & ((x[1:] != x[:-1]) | (y[1:] != y[:-1])))
    back = (x[piece] > x[piece + 1]) | ((x[piece] == x[piece + 1]) & (y[piece] > y[piece + 1]))
    p, q = np.where(back, piece + 1, piece), np.where(back, piece, piece + 1)
    return owner[edge[piece]], np.column_stack([x[p], y[p], x[q], y[q]])


def outline(owner: np.ndarray, edges: np.ndarray, n: int, passes: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges around what the edges of each owner cover by the even-odd rule, the inside on the left of p to q."""
    owner, edges = odd(owner, edges)
    for _ in range(passes):
        owner, edges = odd(*cut_once(owner, edges, n))
    px, py, qx, qy = edges.T
    steep = np.abs(qy - py) > np.abs(qx - px)
    up = py < qy
    # A ray from the middle of an edge counts the edges beyond: upwards for flat edges, to the right for steep ones.
    upright = np.column_stack([px, py, qx, qy, np.where(steep, np.nan, (px + qx) / 2), (py + qy) / 2])
    lying = np.column_stack([*(np.where(up, c, d) for c, d in ((py, qy), (px, qx), (qy, py), (qx, px))), np.where(steep, (py + qy) / 2, np.nan), (px + qx) / 2])
    first, size = runs_of(owner, n)
    beyond = np.zeros(len(edges), np.int64)
    for walls in (upright, lying):
        for some, most in alike(size, lambda k: k * k):
            v, row = padded(walls, first[some], size[some], most)
            u1, w1, u2, w2, u, w = np.moveaxis(v, 2, 0)
            met = u1[:, None, :] <= u[:, :, None]
            met &= u[:, :, None] < u2[:, None, :]
            s, i, j = np.nonzero(met)
            far = (u2[s, j] - u1[s, j]) * (w[s, i] - w1[s, j]) < (w2[s, j] - w1[s, j]) * (u[s, i] - u1[s, j])
            beyond += np.bincount(row[s, i][far], minlength=len(edges))
    ahead = (beyond % 2 == 1) ^ (steep & up)
    return owner, np.where(ahead[:, None], edges, edges[:, [2, 3, 0, 1]])


def areas(owner: np.ndarray, edges: np.ndarray, layer: np.ndarray, n: int, layers: int) -> np.ndarray:
    """Area, in grid steps, of what all ``layers`` of each owner cover together, slab by slab.

    Slabs end at every corner and crossing, so in a slab edges keep their order, and
    its area is its width times what lies inside at its middle.
    """
    out = np.zeros(n)
    first, size = runs_of(owner, n)
    for some, most in alike(size, lambda k: k * (k * (k + 3) // 2 + 1)):
        e, row = padded(edges, first[some], size[some], most)
        e = e - e[:, :1, [0, 1, 0, 1]]  # near the origin doubles are finest
        px, py, qx, qy = np.moveaxis(e, 2, 0)
        i, j = np.triu_indices(most, 1)
        dx, dy = qx - px, qy - py
        den = dx[:, i] * dy[:, j] - dy[:, i] * dx[:, j]
        with np.errstate(divide="ignore", invalid="ignore"):
            ox, oy = px[:, j] - px[:, i], py[:, j] - py[:, i]
            t, s = (ox * dy[:, j] - oy * dx[:, j]) / den, (ox * dy[:, i] - oy * dx[:, i]) / den
            met = np.where((t > 0) & (t < 1) & (s > 0) & (s < 1), px[:, i] + t * dx[:, i], np.nan)
        cuts = np.sort(np.concatenate([px, qx, met], axis=1), axis=1)  # NaN last
        cuts = cuts[:, : int((~np.isnan(cuts)).sum(axis=1).max())]
        width = np.diff(cuts, axis=1)
        middle = (cuts[:, 1:] + cuts[:, :-1]) / 2
        o, m = np.nonzero(width > 0)
        at = middle[o, m][:, None]
        with np.errstate(divide="ignore", invalid="ignore"):
            y = py[o] + (at - px[o]) * (dy / dx)[o]
        y[~((px[o] <= at) & (at < qx[o]))] = np.inf
        order = np.argsort(y, axis=1)
        y = np.take_along_axis(y, order, axis=1)
        kind = np.take_along_axis(layer[row][o], order, axis=1)
        inside = np.ones(y.shape, bool)
        for k in range(layers):
            inside &= np.cumsum(kind == k, axis=1) % 2 == 1
        with np.errstate(invalid="ignore"):
            tall = np.where(inside[:, :-1] & (y[:, 1:] < np.inf), y[:, 1:] - y[:, :-1], 0.0).sum(axis=1)
        out[some] = np.bincount(o, tall * width[o, m], minlength=len(some))
    return out


def edges_in(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Owner and ends of the edges in a column of flat arrays of four numbers an edge; null has none."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    size = np.nan_to_num(column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)).astype(np.int64) // 4
    values = column.flatten().to_numpy(zero_copy_only=False)
    return np.repeat(np.arange(len(column)), size), values.reshape(-1, 4)


def listed(values: np.ndarray, *sizes: list[int]) -> pa.Array:
    """Nested lists of ``values``; ``sizes`` has the lengths of the lists from the innermost to the outermost."""
    out = pa.array(values, pa.float64())
    for size in sizes:
        out = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size, dtype=np.int64)]), pa.int32()), out)
    return out
