"""Quality rules from a learned decision list (operator 4), native expressions only."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plenum.llm.words import let, words

LABEL_ROWS = 20000  # labelled rows the list is fitted on, taken in hash order
MAX_RULES = 12
MAX_CONDITIONS = 4
CUTS = 24
WINDOW = 8

FEATURES = ("symbol_rate", "repeat_rate", "dup_line_rate", "upper_rate", "word_len", "pipe_rate", "bang_rate")


def occurrences(text: Column, characters: str) -> Column:
    """How many characters of a class (as a regular expression) a text has."""
    return (F.length(text) - F.length(F.regexp_replace(text, characters, ""))).cast("long")


def count_of(text: Column, mark: str) -> Column:
    """How often an ASCII character occurs, by byte search."""
    return (F.octet_length(text) - F.octet_length(F.replace(text, F.lit(mark), F.lit("")))).cast("long")


def run_hashes(tokens: Column, window: int, body: Callable[[Column], Column], known: int = 1) -> Column:
    """``body`` of the hashes of all runs of ``window`` (a power of two) words, built by doubling: two halves make a run."""
    if known == window:
        return body(tokens)
    pairs = F.transform(F.sequence(F.lit(0), F.size(tokens) - known - 1), lambda i: F.xxhash64(F.get(tokens, i), F.get(tokens, i + known)))
    return let(pairs, lambda h: run_hashes(h, window, body, 2 * known))


def repeated_words(tokens: Column, window: int = WINDOW) -> Column:
    """Words covered by a ``window``-word run that occurs twice or more in ``tokens``.

    Runs are compared by 64-bit hash within one text. Only texts with a repeated
    run pay for the sort that finds where.
    """

    def covered(hashes: Column) -> Column:
        placed = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def marks(order: Column) -> Column:
            last = F.size(order)
            same = lambda x, k: (k >= 0) & (k < last) & (F.get(order, k)["h"] == x["h"])
            hit = F.filter(order, lambda x, k: F.coalesce(same(x, k - 1), F.lit(False)) | F.coalesce(same(x, k + 1), F.lit(False)))
            return F.array_sort(F.transform(hit, lambda x: x["i"]))

        zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(-window).alias("end"))
        step = lambda acc, p: F.struct((acc["n"] + p + window - F.greatest(acc["end"], p)).cast("long").alias("n"), (p + window).alias("end"))
        return let(placed, lambda order: F.aggregate(marks(order), zero, step, lambda acc: acc["n"]))

    def count(tokens: Column) -> Column:
        none = F.lit(0).cast("long")
        found = run_hashes(tokens, window, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), none).otherwise(covered(h)))
        return F.when(F.size(tokens) <= window, none).otherwise(found)

    return let(tokens, count)


def text_statistics(docs: DataFrame) -> DataFrame:
    """``docs`` with the base statistics and the features of the decision list.

    Null texts count as empty: all counts zero. Every expression runs inside the
    scan's task, row by row; there is no shuffle.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    base = docs.withColumn("__words", words(F.col("text"))).withColumn("__lines", lines)
    stats = base.select(
        *docs.columns,
        F.size("__words").cast("long").alias("n_words"),
        F.length(F.array_join("__words", "")).cast("long").alias("word_chars"),
        occurrences(text, "[#*$%&|<>]").alias("n_symbols"),
        (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long").alias("n_dup_lines"),
        repeated_words(F.col("__words")).alias("n_repeat_words"),
        F.size("__lines").cast("long").alias("__n_lines"),
        count_of(text, "|").alias("__pipes"),
        count_of(text, "!").alias("__bangs"),
        occurrences(text, r"\p{Lu}").alias("__upper"),
    )
    rate = lambda part, whole: F.round(F.col(part) / F.greatest(F.col(whole), F.lit(1)), 6)
    return stats.select(
        *docs.columns, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        rate("n_symbols", "word_chars").alias("symbol_rate"),
        rate("n_repeat_words", "n_words").alias("repeat_rate"),
        rate("n_dup_lines", "__n_lines").alias("dup_line_rate"),
        rate("__upper", "word_chars").alias("upper_rate"),
        rate("word_chars", "n_words").alias("word_len"),
        rate("__pipes", "word_chars").alias("pipe_rate"),
        rate("__bangs", "word_chars").alias("bang_rate"),
        F.monotonically_increasing_id().alias("__row"),  # see once()
    )


def once(condition: Column) -> Column:
    """``condition`` on statistics, tied to a column that Spark won't compute twice.

    A plain filter would be pushed below the projection, and each statistic in it worked out again there.
    """
    return condition & (F.col("__row") >= 0)


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


@dataclass(frozen=True)
class Condition:
    """One interpretable test: a statistic at least, or at most, a threshold."""

    feature: str
    at_least: bool
    threshold: float

    def holds(self, row: dict) -> bool:
        return row[self.feature] >= self.threshold if self.at_least else row[self.feature] <= self.threshold

    def column(self) -> Column:
        return F.col(self.feature) >= F.lit(self.threshold) if self.at_least else F.col(self.feature) <= F.lit(self.threshold)

    def __str__(self) -> str:
        return f"{self.feature} {'>=' if self.at_least else '<='} {self.threshold:g}"


def thresholds(rows: list[dict]) -> dict[str, list[float]]:
    """Candidate thresholds of each feature: quantiles of the labelled rows, and of the bad ones."""
    out = {}
    for name in FEATURES:
        found: set[float] = set()
        for part in (rows, [r for r in rows if not r["quality"]]):
            values = sorted(r[name] for r in part)
            found.update(values[min(len(values) - 1, i * len(values) // CUTS)] for i in range(CUTS + 1) if values)
        out[name] = sorted(found)
    return out


def precision(rows: list[dict]) -> float:
    """Laplace estimate of the share of bad rows."""
    return (sum(not r["quality"] for r in rows) + 1) / (len(rows) + 2)


def gain(before: list[dict], after: list[dict]) -> float:
    bad = sum(not r["quality"] for r in after)
    return bad * (math.log2(precision(after)) - math.log2(precision(before)))


def learn(rows: list[dict], least_precision: float = 0.9, least_bad: int = 3) -> list[list[Condition]]:
    """Ordered rules that each say "bad", by sequential covering on plain labelled rows.

    A rule grows on two thirds of the rows by the condition with the highest
    information gain and is pruned on the last third by dropping conditions
    while the precision there does not fall. Rows that a kept rule covers are
    removed before the next. A rule that is not precise enough ends the list.
    """
    rules: list[list[Condition]] = []
    rest = list(rows)
    while len(rules) < MAX_RULES and sum(not r["quality"] for r in rest) >= least_bad:
        grow, prune = [r for i, r in enumerate(rest) if i % 3], [r for i, r in enumerate(rest) if not i % 3]
        cuts = thresholds(grow)
        rule: list[Condition] = []
        inside = grow
        while len(rule) < MAX_CONDITIONS and any(r["quality"] for r in inside):
            best, most = None, 1e-9
            for name, values in cuts.items():
                ordered = sorted(inside, key=lambda r, n=name: r[n])
                keys = [r[name] for r in ordered]
                bads = [0]
                for r in ordered:
                    bads.append(bads[-1] + (not r["quality"]))
                n, total = len(ordered), bads[-1]
                base = math.log2((total + 1) / (n + 2))
                below = at = 0
                for value in values:
                    while below < n and keys[below] < value:
                        below += 1
                    at = max(at, below)
                    while at < n and keys[at] <= value:
                        at += 1
                    for bad, size, up in ((total - bads[below], n - below, True), (bads[at], at, False)):
                        if bad < least_bad or size == n:
                            continue
                        g = bad * (math.log2((bad + 1) / (size + 2)) - base)
                        if g > most:
                            best, most = Condition(name, up, value), g
            if best is None:
                break
            rule.append(best)
            inside = [r for r in inside if best.holds(r)]
        if not rule:
            break
        worth = lambda x: precision([r for r in prune if all(c.holds(r) for c in x)])
        while len(rule) > 1:
            shorter = max((rule[:i] + rule[i + 1 :] for i in range(len(rule))), key=worth)
            if worth(shorter) < worth(rule):
                break
            rule = shorter
        covered = [r for r in rest if all(c.holds(r) for c in rule)]
        if not covered or precision(covered) < least_precision:
            break
        rules.append(rule)
        rest = [r for r in rest if not all(c.holds(r) for c in rule)]
    return rules


def labelled_rows(docs: DataFrame, labels: DataFrame, bound: int = LABEL_ROWS) -> list[dict]:
    """At most ``bound`` labelled rows with their features, taken by the hash of doc_id."""
    usable = labels.where("doc_id is not null and quality in (0, 1)").groupBy("doc_id").agg(F.min("quality").cast("int").alias("quality"))
    chosen = usable.orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound)
    part = docs.where("doc_id is not null").select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    seen = text_statistics(part).where(once(~base_failed())).select("doc_id", "quality", *FEATURES)
    return [r.asDict() for r in seen.orderBy(F.xxhash64("doc_id"), "doc_id").collect()]


def verdict(rules: list[list[Condition]]) -> Column:
    """Ordered conditional expression: null if the base rules fail, else the number of the first rule that rejects, 0 if none."""
    number = F.when(base_failed(), F.lit(None).cast("int"))
    for i, rule in enumerate(rules, 1):
        met = F.lit(True)
        for condition in rule:
            met = met & condition.column()
        number = number.when(met, F.lit(i))
    return number.otherwise(F.lit(0))


def judged(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` with base statistics, ``base_failed``, ``rule``, ``kept`` and ``__row``.

    ``docs`` needs ``doc_id`` and ``text``. Null and empty texts fail the base rules.
    Labels that are null, unknown or without a document are ignored; a document
    labelled twice counts as bad if either label does. Without labels the list
    is empty and everything that passes the base rules is kept. Repeated rows
    keep their rows. Columns of ``docs`` with the name of an added one give way to it
    (:func:`keep` returns them untouched). One scan reads the texts of the labelled sample, one all.
    """
    rules = learn(labelled_rows(docs, labels))
    own = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", *FEATURES, "base_failed", "rule", "kept")
    plain = docs.select(*[c for c in docs.columns if c.lower() not in own])
    stats = text_statistics(plain).withColumn("base_failed", base_failed()).withColumn("rule", verdict(rules))
    return stats.withColumn("kept", F.coalesce(F.col("rule") == 0, F.lit(False)))


def keep(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows of ``docs``, all columns as they are, that :func:`judged` keeps."""
    whole = F.struct(*docs.columns).alias("__whole")
    told = judged(docs.select("doc_id", "text", whole), labels)
    return told.where(once(F.col("kept"))).select("__whole.*")


def op4(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Digest of :func:`judged`."""
    named = docs.select(F.col("doc_id").cast("long"), "text")
    return judged(named, labels).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
