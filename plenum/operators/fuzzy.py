"""Fuzzy lookup of names: the matches that ``difflib.get_close_matches`` gives, with candidates found by equality of keys.

The ratio of two names of ``a`` and ``b`` characters is 2m / (a + b), where m
characters of both stand in the same order. A ratio of at least the cutoff thus
leaves a budget of characters that only one of them has. A known name is cut in
so many pieces that one of them, at least, loses or gains one character at most.
The index holds each piece whole and with each character deleted in turn; a name
asked for brings the substrings that may stand in a piece's place, whole and with
each character deleted. Taking the first piece whose running loss is below twice
its number bounds where that substring starts, so few substrings are needed.
Equal keys make candidates; the number of differing characters is checked in the
join, the ratio itself afterwards. Nothing with a ratio of the cutoff or more is lost.
"""

from __future__ import annotations

import difflib
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StringType

CUTOFF = 0.8
LEAST_CUTOFF = 0.6  # below it pieces of a name may be empty, and an empty piece tells nothing


def shared(total: int, cutoff: float) -> int:
    """The least number of common characters with which two names of ``total`` characters reach the cutoff."""
    m = max(0, int(cutoff * total / 2) - 1)
    while total and 2.0 * m / total < cutoff:
        m += 1
    return m


@lru_cache(maxsize=10_000)
def partners(length: int, cutoff: float) -> tuple[tuple[int, int], ...]:
    """Lengths that a name of ``length`` may match, each with the budget of differing characters."""
    out, other = [], max(0, int(length * cutoff / 2) - 1)
    while other <= 4 * length:
        m = shared(length + other, cutoff)
        if m <= min(length, other):
            out.append((other, length + other - 2 * m))
        other += 1
    return tuple(out)


def pieces(length: int, count: int) -> list[tuple[int, int]]:
    cuts = [i * length // count for i in range(count + 1)]
    return list(zip(cuts, cuts[1:]))


def shortened(text: str) -> Iterator[str]:
    return (text[:i] + text[i + 1 :] for i in range(len(text)))


def known_keys(name: str, cutoff: float = CUTOFF) -> set[str]:
    """Keys of a known name: its pieces in every layout that a partner's length asks for."""
    keys = set()
    for count in {budget // 2 + 1 for _, budget in partners(len(name), cutoff)}:
        for place, (lo, hi) in enumerate(pieces(len(name), count)):
            head = f"{len(name)},{count},{place},"
            keys.add(head + name[lo:hi])
            keys.update(head + s for s in shortened(name[lo:hi]))
    return keys


def asked_keys(name: str, cutoff: float = CUTOFF) -> set[str]:
    """Keys of a name asked for: at each length of a known name, what may stand in the place of each piece."""
    keys = set()
    for length, budget in partners(len(name), cutoff):
        count = budget // 2 + 1
        for place, (lo, hi) in enumerate(pieces(length, count)):
            head = f"{length},{count},{place},"
            for size in (hi - lo - 1, hi - lo, hi - lo + 1):
                local = abs(size - (hi - lo))
                before = 2 * place + 1 - local
                for shift in range(-before, before + 1, 1 + local):
                    at = lo + shift
                    rest = len(name) - length - shift - (size - (hi - lo))
                    if size < 0 or at < 0 or at + size > len(name) or abs(rest) > budget - 2 * place - local:
                        continue
                    text = name[at : at + size]
                    keys.update([head + text] if size <= hi - lo else (head + s for s in shortened(text)))
    return keys


def keyed(names: DataFrame, column: str, keys, cutoff: float) -> DataFrame:
    """``names`` with a row for each key of ``column``; keys are compared by 64-bit hashes, so a clash is one more candidate."""

    @F.pandas_udf(ArrayType(StringType()))
    def made(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: sorted(keys(t, cutoff)))

    return names.withColumn("__key", F.explode(made(column))).withColumn("__key", F.xxhash64("__key"))


def name_index(known: DataFrame, name: str = "name", scope: tuple[str, ...] = (), cutoff: float = CUTOFF) -> DataFrame:
    """Index of known names, to be saved as a table and used for lookups at the same ``cutoff`` (0.6 or more).

    A row for each key of each distinct lower-cased name in its scope, with the
    number of its rows as ``copies``. Null names are left out; a null scope is a scope.
    """
    if cutoff < LEAST_CUTOFF:
        raise ValueError(f"a cutoff below {LEAST_CUTOFF} can't be looked up by pieces")
    distinct = known.where(F.col(name).isNotNull()).groupBy(*scope, F.lower(name).alias("name")).agg(F.count(F.lit(1)).alias("copies"))
    return keyed(distinct, "name", known_keys, cutoff)


@F.pandas_udf(DoubleType())
def ratio(name: pd.Series, asked: pd.Series) -> pd.Series:
    """Ratio as ``get_close_matches`` takes it: the second name is the one asked for."""
    matcher, last, out = difflib.SequenceMatcher(), None, []
    for known, word in zip(name, asked):
        if word != last:
            matcher.set_seq2(word)
            last = word
        matcher.set_seq1(known)
        out.append(matcher.ratio())
    return pd.Series(out, dtype="float64")


def close_pairs(asked: DataFrame, index: DataFrame, column: str, scope: tuple[str, ...] = (), cutoff: float = CUTOFF) -> DataFrame:
    """Distinct pairs of lower-cased names (``asked``, ``name``, ``copies``, ``score``) with a ratio of ``cutoff`` or more.

    What shares a frequent key only is told apart inside the join, so a piece that
    many names have ("city of") costs comparisons, but no rows.
    """
    words = asked.where(F.col(column).isNotNull()).select(*[F.col(s).alias(f"__{s}") for s in scope], F.lower(column).alias("asked")).distinct()
    left = keyed(words, "asked", asked_keys, cutoff)
    total = F.length("asked") + F.length("name")
    budget = F.floor(total * (1 - cutoff) + 1e-6)
    same = (left["__key"] == index["__key"]) & (F.levenshtein("asked", "name") <= budget)
    for s in scope:
        same = same & left[f"__{s}"].eqNullSafe(index[s])
    found = left.join(index, same).select(*[F.col(f"__{s}").alias(s) for s in scope], "asked", "name", "copies").distinct()
    return found.withColumn("score", ratio("name", "asked")).where(F.col("score") >= cutoff)


def close_names(asked: DataFrame, index: DataFrame, column: str = "name", scope: tuple[str, ...] = (), n: int = 5, cutoff: float = CUTOFF) -> DataFrame:
    """For each distinct name asked for, its ``n`` closest known rows: best score first, then the later name; ``rank`` from 1.

    Known names that several rows have count as often as they occur, as in a list
    of all rows: ``taken`` tells how many of a name's rows are among the ``n``.
    """
    order = Window.partitionBy(*scope, "asked").orderBy(F.desc("score"), F.desc("name"))
    ranked = close_pairs(asked, index, column, scope, cutoff).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)
    before = F.coalesce(F.sum("copies").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return ranked.withColumn("taken", F.least(F.col("copies"), n - before)).where("taken > 0").drop("copies")


def suggestions(asked: DataFrame, known: DataFrame, column: str = "name", name: str = "name", n: int = 5, cutoff: float = CUTOFF) -> DataFrame:
    """Rows of ``known`` for each name asked for (``asked``, ``score``): those of its exact name, or else of its closest names."""
    matches = close_names(asked, name_index(known, name, cutoff=cutoff), column, n=n, cutoff=cutoff)
    exact = F.max(F.col("asked") == F.col("name")).over(Window.partitionBy("asked"))
    chosen = matches.withColumn("__exact", exact).where(~F.col("__exact") | (F.col("asked") == F.col("name"))).select("asked", "score", F.col("name").alias("__name"))
    return known.join(chosen, F.lower(F.col(name)) == F.col("__name")).drop("__name")
