"""Mixing sources to target weights by distributed prefix sums (operator 5), native expressions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plenum.llm.storage import cut
from plenum.llm.words import n_words

WEIGHTS = (5, 2, 1)
SHARE = 1.5  # of all sizes, what the mix takes
EPOCHS = 2  # most times a source is used
SLICE_ROWS = 20000  # rows of one slice of a source that one task orders


def targets(sizes: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, epochs: int = EPOCHS) -> DataFrame:
    """Words to take from each source (``source_key``, ``source``, ``source_size``).

    Weights go round the sources in order of code point, null last. A source is
    filled at most ``epochs`` times; what it can't hold is shared among the
    others by weight until none is above. That end state is a common level: the
    sources with the least capacity for their weight are full, the others get
    weight times level. The table has one row a source.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.row_number().over(by_name) - 1) % len(weights) + 1)
    rows = sizes.withColumn("weight", weight).withColumn("most", F.lit(float(epochs)) * F.col("source_size"))
    fill = Window.orderBy((F.col("most") / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    up_to = fill.rowsBetween(Window.unboundedPreceding, -1)
    from_here = fill.rowsBetween(0, Window.unboundedFollowing)
    every = Window.partitionBy()
    rows = rows.withColumn("budget", F.lit(share) * F.sum("source_size").over(every))
    rows = rows.withColumn("level", (F.col("budget") - F.coalesce(F.sum("most").over(up_to), F.lit(0.0))) / F.sum("weight").over(from_here))
    rows = rows.withColumn("place", F.row_number().over(fill))
    open_level = F.when(F.col("level") * F.col("weight") <= F.col("most"), F.struct("place", "level"))
    rows = rows.withColumn("water", F.min(open_level).over(every)["level"])
    return rows.withColumn("target", F.least(F.col("most"), F.coalesce(F.col("water") * F.col("weight"), F.col("most")))).select("source_key", "source_size", "target")


def hash_key() -> Column:
    """Random but fixed order of documents: the MD5 of the id's decimal digits."""
    return F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))


def source_key() -> Column:
    """The source, told apart from a null one."""
    return F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit(""))


def body() -> Column:
    """A hash of the text: with id and source it tells rows apart."""
    return F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))


def mixture(docs: DataFrame) -> DataFrame:
    """How many words the mix takes of each row of ``docs``: see :func:`shares`."""
    return shares(docs).select("doc_id", "size", "source_size", "target", "taken")


def shares(docs: DataFrame, split_last: bool = True) -> DataFrame:
    """How many words the mix takes of each row of ``docs`` (``doc_id``, ``source``, ``text``).

    Returns ``doc_id``, ``source_key``, ``body``, ``size``, ``source_size``, ``target`` and ``taken``. Whole epochs are taken first; the rest of the
    target goes to the rows whose running total in hash order stays below it,
    the row on the edge giving only the words still missing (or, without
    ``split_last``, all of its words if at least half of them fit, else none).
    Running totals: each source is cut in slices of equal hash range, slices are
    summed with map-side combining, their offsets are prefix sums over the small
    table of slices, and only rows of one slice are ordered together. So a source
    with a third of all rows is spread over as many tasks as its rows need.
    Null texts have size 0, the null source is a source of its own, null and
    repeated ids are ordered by id, then size, then a hash of the text. An empty table gives an empty result.
    """
    text_free = [c for c in ("doc_id", "source") if c in docs.columns]
    narrow = docs.select(*text_free, n_words(F.col("text")).alias("size"), body().alias("body"))
    narrow = narrow.withColumn("source_key", source_key())
    narrow = cut(narrow.withColumn("mix_key", hash_key()))
    per_source = narrow.groupBy("source_key").agg(F.min("source").alias("source"), F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_rows"))
    plan = targets(per_source).join(per_source.select("source_key", "n_rows"), "source_key")
    slices = F.greatest(F.lit(1), F.ceil(F.col("n_rows") / SLICE_ROWS)).cast("long")
    plan = cut(plan.withColumn("slices", slices))
    head = F.conv(F.substring("mix_key", 1, 8), 16, 10).cast("long")
    rows = narrow.join(plan, "source_key").withColumn("slice", F.floor(head * F.col("slices") / (1 << 32)).cast("long"))
    rows = rows.repartition("source_key", "slice")  # else the window keeps the join's partitioning, a source to a task
    sums = rows.groupBy("source_key", "slice").agg(F.sum("size").alias("slice_size"))
    before = Window.partitionBy("source_key").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("source_key", "slice", F.coalesce(F.sum("slice_size").over(before), F.lit(0)).alias("offset"))
    inside = Window.partitionBy("source_key", "slice").orderBy("mix_key", "doc_id", "size", "body").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.join(offsets, ["source_key", "slice"])
    start = F.col("offset") + F.coalesce(F.sum("size").over(inside), F.lit(0))
    full = F.when(F.col("source_size") > 0, F.floor(F.floor("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    rows = rows.withColumn("start", start).withColumn("full", full).withColumn("rest", (F.floor("target") - F.col("full") * F.col("source_size")).cast("long"))
    part = F.greatest(F.lit(0), F.least(F.col("size"), F.col("rest") - F.col("start")))
    if not split_last:
        part = F.when(2 * part >= F.col("size"), F.col("size")).otherwise(F.lit(0))
    return rows.withColumn("taken", (F.col("full") * F.col("size") + part).cast("long")).select("doc_id", "source_key", "body", "size", "source_size", "target", "taken")


def mixed(docs: DataFrame) -> DataFrame:
    """The mix itself: rows of ``docs`` as often as the mix takes them, whole documents only.

    All columns are kept. Rows without words have no share and stay out, as do
    rows past their source's budget. Rows of one id, source and text share what
    the mix takes of them all: each comes equally often, the first ones once more.
    """
    key = ["doc_id", "source_key", "body"]
    counts = shares(docs, split_last=False).where("size > 0")
    total, rows = F.sum((F.col("taken") / F.col("size")).cast("long")), F.count(F.lit(1))
    times = counts.groupBy(*key).agg(total.alias("__total"), rows.alias("__rows")).where("__total > 0")
    times = times.select(*[F.col(c).alias(f"__{c}") for c in key], "__total", "__rows")
    named = docs.withColumn("__own_source", source_key()).withColumn("__own_body", body())
    same = named["doc_id"].eqNullSafe(times["__doc_id"]) & (F.col("__own_source") == F.col("__source_key")) & (F.col("__own_body") == F.col("__body"))
    out = named.join(times, same)
    place = F.row_number().over(Window.partitionBy("__doc_id", "__source_key", "__body").orderBy(F.lit(1)))
    extra = (F.when(F.col("__rows") == 1, F.lit(1)).otherwise(place) <= F.col("__total") % F.col("__rows")).cast("long")
    copies = F.floor(F.col("__total") / F.col("__rows")) + extra
    return out.withColumn("__n", copies).where("__n > 0").withColumn("__n", F.explode(F.sequence(F.lit(1).cast("long"), F.col("__n")))).select(*docs.columns)


def op5(docs: DataFrame) -> DataFrame:
    """Digest of :func:`mixture`, its own columns."""
    return mixture(docs)
