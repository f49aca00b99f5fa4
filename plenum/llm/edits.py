"""Edit similarity of many pairs of lines at once."""

from __future__ import annotations

import numpy as np

WORD_BITS = 64
MOST_WORDS = 512  # machine words of a pattern in a batch; longer ones are done one by one
LANES = 1 << 12  # machine words at work at a time
WINDOW = 16  # steps between which lanes begin and end
BINS = 64  # of letter counts; the letters a to z have bins of their own
TABLE = 1 << 21  # entries of a batch's table of character places


def same_start(a: str, b: str) -> int:
    """Length of the common prefix, by bisection on slices."""
    low, high = 0, min(len(a), len(b))
    while low < high:
        middle = (low + high + 1) // 2
        low, high = (middle, high) if a[low:middle] == b[low:middle] else (low, middle - 1)
    return low


def trimmed(a: str, b: str) -> tuple[str, str]:
    """Both strings without their common ends; the distance stays the same."""
    n = same_start(a, b)
    a, b = a[n:], b[n:]
    n = same_start(a[::-1], b[::-1])
    return a[: len(a) - n], b[: len(b) - n]


def words_cost(a: list[str], b: list[str], limit: float) -> float:
    """Cost of one way from ``a`` to ``b``, word by word with a look one word ahead: no less than their edit distance."""
    i = j = cost = 0
    last_a, last_b = len(a) - 1, len(b) - 1
    while i <= last_a and j <= last_b:
        if a[i] == b[j]:
            i, j = i + 1, j + 1
            continue
        if i < last_a and j < last_b and a[i + 1] == b[j + 1]:
            cost += max(len(a[i]), len(b[j]))
            i, j = i + 2, j + 2
        elif j < last_b and a[i] == b[j + 1]:
            cost += len(b[j]) + 1
            j += 1
        elif i < last_a and a[i + 1] == b[j]:
            cost += len(a[i]) + 1
            i += 1
        else:
            cost += max(len(a[i]), len(b[j]))
            i, j = i + 1, j + 1
        if cost > limit:
            return cost
    return cost + sum(len(x) + 1 for x in a[i:]) + sum(len(x) + 1 for x in b[j:])


def one_distance(a: str, b: str, limit: float) -> int:
    """Levenshtein distance of trimmed strings, bit-parallel over the characters of ``a``; over ``limit``, any number over it."""
    places: dict[str, int] = {}
    for i, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << i
    full, high = (1 << len(a)) - 1, 1 << (len(a) - 1)
    plus, minus, score = full, 0, len(a)
    for left, c in zip(range(len(b) - 1, -1, -1), b):
        eq = places.get(c, 0)
        diagonal = (((eq & plus) + plus) ^ plus) | eq | minus
        up = minus | (full & ~(diagonal | plus))
        down = plus & diagonal
        score += bool(up & high) - bool(down & high)
        if score - left > limit:
            return score - left
        up = (up << 1 | 1) & full
        plus = (down << 1 & full) | (full & ~(diagonal | up))
        minus = up & diagonal
    return score


def batch_distances(pairs: list[tuple[str, str]], limits: np.ndarray) -> np.ndarray:
    """Levenshtein distances of non-empty pairs, the bit-parallel columns of many pairs at once, ``WORD_BITS`` rows a machine word.

    A lane is a machine word of a pair. At a step the word ``w`` does the column after its last one, with what
    the word before carried out a step ago, so each step takes the lanes of all pairs together.
    A lane does the columns that ways within the limit can take, and begins and ends between windows of
    ``WINDOW`` steps; what it misses outside them counts as if it cost an edit a character, so nothing gets
    too small. Pairs come in as others leave. One that is over its limit may get any number over it.
    """
    one, top, full = np.uint64(1), np.uint64(WORD_BITS - 1), ~np.uint64(0)
    rows, columns = (np.array([len(x[i]) for x in pairs]) for i in (0, 1))
    longer = columns - rows
    most = np.maximum(np.minimum(np.floor(limits).astype(np.int64), rows + columns), np.maximum(np.abs(longer), 2))
    before, after = (most - longer) // 2, (most + longer) // 2  # how far a way within the limit gets from the diagonal
    words = -(-rows // WORD_BITS)
    last = np.cumsum(words) - 1
    pair = np.repeat(np.arange(len(pairs)), words)
    word = np.arange(len(pair)) - np.repeat(last - words + 1, words)
    start = (np.maximum(WORD_BITS * word - before[pair], 0) + word) // WINDOW * WINDOW  # the step of a lane's first column
    end = np.minimum(columns[pair], WORD_BITS * (word + 1) + after[pair]) + word  # and the one at which the next lane uses its last
    finish = columns + words - 2
    found = np.frombuffer("".join([x for pair in pairs for x in pair]).encode("utf-32-le", "surrogatepass"), np.uint32)
    met = np.zeros(int(found.max()) + 1, bool)
    met[found] = True
    letters = int(met.sum()) + 1  # the last one stands before the first column, and matches nothing
    code = (np.cumsum(met) - 1)[found]
    begin = np.cumsum(rows + columns) - rows - columns
    row = np.arange(rows.sum()) - np.repeat(np.cumsum(rows) - rows, rows)
    table = np.zeros(letters * len(pair), np.uint64)
    np.bitwise_or.at(table, (np.repeat(last - words + 1, rows) + row // WORD_BITS) * letters + code[np.repeat(begin, rows) + row], one << (row % WORD_BITS).astype(np.uint64))
    texts = np.full((columns + words + WINDOW).sum() + WINDOW, letters - 1)  # each behind as many blanks as the pair has words
    place = np.cumsum(columns + words + WINDOW) - columns - WINDOW
    column = np.arange(columns.sum()) - np.repeat(np.cumsum(columns) - columns, columns)
    texts[np.repeat(place, columns) + column] = code[np.repeat(begin + rows, columns) + column]
    at = place[pair] - word
    own = np.arange(len(pair)) * letters
    bottom = np.minimum(WORD_BITS * (word + 1), rows[pair])
    under = WORD_BITS * (word + 1) - bottom  # rows of a lane below the last row
    ahead = (columns - rows)[pair] + bottom + word  # less the step: how far a lane's corner is from the last diagonal
    below = np.where(rows % WORD_BITS, full << (rows % WORD_BITS).astype(np.uint64), np.uint64(0))
    plus, minus, up_out, down_out = np.full(len(pair), full), *np.zeros((3, len(pair)), np.uint64)
    score, out = np.zeros(len(pair), np.int64), np.full(len(pairs), -1)
    width = np.minimum(words, (WORD_BITS + most + WINDOW) // WORD_BITS + 1)  # lanes of a pair at work, about
    live, coming, entered, s = np.zeros(0, np.int64), np.zeros(0, np.int64), 0, 0
    while True:
        room = LANES - int(width[np.unique(pair[live])].sum()) if len(live) else LANES
        if entered < len(pairs) and room > LANES // 8:
            upto = max(entered + 1, entered + int(np.searchsorted(np.cumsum(width[entered : entered + room + 1]), room, side="right")))
            upto = min(upto, len(pairs))
            lanes = np.arange(last[entered] - words[entered] + 1, last[upto - 1] + 1)
            for x, change in ((start, s), (end, s), (at, -s), (ahead, s)):
                x[lanes] += change
            finish[entered:upto] += s
            coming, entered = np.concatenate([coming, lanes]), upto
        coming = coming[out[pair[coming]] < 0]
        ready = start[coming] == s
        new, coming = coming[ready], coming[~ready]
        first_columns = at[new] + s <= place[pair[new]]
        score[new] = np.where(first_columns, WORD_BITS * word[new], score[new - 1] - (up_out[new - 1].astype(np.int64) - down_out[new - 1].astype(np.int64))) + WORD_BITS
        live = live[(out[pair[live]] < 0) & (end[live] >= s)]
        live = np.sort(np.concatenate([live, new]))
        if not len(live):
            break
        n, who = len(live), pair[live]
        first = np.flatnonzero(np.diff(who, prepend=-1))
        p, m, up_, down_, total = plus[live], minus[live], up_out[live], down_out[live], score[live]
        mine, here = own[live], at[live] + s
        ending = who[first]
        ending = ending[finish[ending] < s + WINDOW]
        ends = finish[ending] - s
        carry_up, carry_down, eq, vertical, a, b = np.empty((6, n), np.uint64)
        for t in range(WINDOW):
            carry_up[1:], carry_down[1:] = up_[:-1], down_[:-1]
            carry_up[first], carry_down[first] = 1, 0
            spot = texts.take(here)
            spot += mine
            here += 1
            table.take(spot, out=eq, mode="clip")
            np.bitwise_or(eq, m, out=vertical)
            eq |= carry_down
            np.bitwise_and(eq, p, out=a)
            a += p
            a ^= p
            a |= eq  # the diagonals that stay level
            np.bitwise_or(a, p, out=b)
            np.invert(b, out=b)
            b |= m  # up
            a &= p  # down
            np.right_shift(b, top, out=up_)
            np.right_shift(a, top, out=down_)
            b <<= one
            b |= carry_up
            a <<= one
            a |= carry_down
            np.bitwise_or(vertical, b, out=p)
            np.invert(p, out=p)
            p |= a
            np.bitwise_and(b, vertical, out=m)
            total += up_.view(np.int64)
            total -= down_.view(np.int64)
            if len(ends) and (done := ending[ends == t]).size:
                k = np.searchsorted(live, last[done])
                out[done] = total[k] - np.bitwise_count(p[k] & below[done]).astype(np.int64) + np.bitwise_count(m[k] & below[done])
        plus[live], minus[live], up_out[live], down_out[live], score[live] = p, m, up_, down_, total
        s += WINDOW
        reached = s - ahead[live]  # columns beyond the diagonal that ends in the last corner
        least = total - under[live] - np.abs(reached)
        least[at[live] + s <= place[who]] = 0
        least = np.maximum.reduceat(least, first)
        over = (least > limits[who[first]]) & (out[who[first]] < 0)
        out[who[first][over]] = least[over]
    return out


def letter_counts(lines: list[str]) -> np.ndarray:
    """How many characters of each line fall in each of ``BINS`` bins by code point."""
    out = np.zeros((len(lines), BINS), np.int32)
    for lo in range(0, len(lines), 256):
        some = lines[lo : lo + 256]
        codes = np.frombuffer("".join(some).encode("utf-32-le", "surrogatepass"), np.uint32) & np.uint32(BINS - 1)
        codes = codes + np.repeat(np.arange(0, len(some) * BINS, BINS, dtype=np.uint32), [len(x) for x in some])
        out[lo : lo + 256] = np.bincount(codes, minlength=len(some) * BINS).reshape(-1, BINS)
    return out


def too_unlike(counts: np.ndarray, a: np.ndarray, b: np.ndarray, least: float) -> np.ndarray:
    """Whether the letters of lines ``a`` and ``b`` alone (:func:`letter_counts`) need more edits than ``least`` leaves: an edit takes away one letter at most and brings one."""
    out = np.zeros(len(a), bool)
    size = counts.sum(axis=1)
    for lo in range(0, len(a), 1 << 14):
        x, y = a[lo : lo + (1 << 14)], b[lo : lo + (1 << 14)]
        longest = np.maximum(size[x], size[y])
        most = (np.abs(counts[x] - counts[y]).sum(axis=1) + np.abs(size[x] - size[y])) // 2
        out[lo : lo + (1 << 14)] = most > (1 - least) * longest + 1e-9
    return out


def alike(pairs: list[tuple[str, str]], least: float) -> np.ndarray:
    """For each pair whether one minus distance over the longer length is ``least`` or more (two empty lines are alike)."""
    out = np.zeros(len(pairs), bool)
    waiting: list[tuple[int, int, str, str, float]] = []
    for k, (a, b) in enumerate(pairs):
        longest = max(len(a), len(b))
        limit = (1 - least) * longest + 1e-9
        if abs(len(a) - len(b)) > limit:
            continue
        a, b = trimmed(a, b)
        if len(a) > len(b):
            a, b = b, a
        if len(b) <= limit:  # replacing all that is left costs no more
            out[k] = True
        elif not a:
            out[k] = False
        elif words_cost(a.split(" "), b.split(" "), limit) <= limit:
            out[k] = True
        elif len(a) > MOST_WORDS * WORD_BITS:
            out[k] = one_distance(a, b, limit) <= limit
        else:
            waiting.append((-(-len(a) // WORD_BITS), k, a, b, limit))
    waiting.sort(key=lambda x: -len(x[3]))
    met = np.frombuffer("".join([y for x in waiting for y in x[2:4]]).encode("utf-32-le", "surrogatepass"), np.uint32)
    letters = np.count_nonzero(np.bincount(met)) if len(met) else 0
    most = max(1, TABLE // (letters + 1))
    at = 0
    while at < len(waiting):
        upto = at + 1
        lanes = waiting[at][0]
        while upto < len(waiting) and lanes + waiting[upto][0] <= most:
            lanes += waiting[upto][0]
            upto += 1
        part = waiting[at:upto]
        if len(part) < 12:  # too few to be worth the arrays
            for _, k, a, b, limit in part:
                out[k] = one_distance(a, b, limit) <= limit
        else:
            limits = np.array([x[4] for x in part])
            out[[x[1] for x in part]] = batch_distances([(x[2], x[3]) for x in part], limits) <= limits
        at = upto
    return out
