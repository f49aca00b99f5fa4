"""Latest-per-key, as-of, nearest and preference operators as plain DataFrame plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest_per_key(df: DataFrame, keys: list[str], order: list[Column], n: int = 1, rank: str | None = None) -> DataFrame:
    """The first ``n`` rows of each key; ``order`` must end in a total order.

    Written as a filtered ``row_number``, which Spark turns into a group limit
    before the shuffle: a key sends at most ``n`` rows a task.
    """
    name = rank or "__rank"
    ranked = df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    kept = ranked.where(F.col(name) <= n)
    return kept if rank else kept.drop(name)


def asof_backward(left: DataFrame, right: DataFrame, keys: list[str], left_time: str, right_time: str, payload: list[str], tie: str, strict: bool = False, null_times: bool = False) -> DataFrame:
    """Each left row with the latest right row of its key at or before its time.

    Both sides are merged in one frame and one window per key carries the last
    right row forward, so a key costs one sort instead of a join of all its pairs. ``strict``
    asks for an earlier time; ``null_times`` admits right rows without a time as
    oldest. ``payload`` columns come back null where nothing precedes.
    """
    r = right.select(*keys, F.col(right_time).alias("__t"), F.lit(1 if strict else 0).alias("__side"), F.col(tie).cast("string").alias("__tie"), F.struct(*payload).alias("__row"))
    if not null_times:
        r = r.where("__t is not null")
    f = left.select(*keys, F.col(left_time).alias("__t"), F.lit(0 if strict else 1).alias("__side"), F.lit("").alias("__tie"), F.struct(*left.columns).alias("__left"))
    order = Window.partitionBy(*keys).orderBy(F.col("__t").asc_nulls_first(), "__side", "__tie").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    merged = r.unionByName(f, allowMissingColumns=True).withColumn("__hit", F.last("__row", ignorenulls=True).over(order)).where("__left is not null")
    return merged.select("__left.*", *[F.col("__hit")[c].alias(c if c not in left.columns else f"{c}_prior") for c in payload])


def nearest_within(left: DataFrame, right: DataFrame, on: list[Column], left_key: str, distance: Column, most: int, tie: list[Column]) -> DataFrame:
    """For each left row the right row at the least distance up to ``most``; ties by ``tie``."""
    near = left.join(right, on, "inner").withColumn("__d", distance).where(F.col("__d") <= most)
    return latest_per_key(near, [left_key], [F.col("__d").asc(), *tie]).withColumnRenamed("__d", "distance")


def unique_by_key(df: DataFrame, keys: list[str], id_column: str) -> DataFrame:
    """Keys that name exactly one id; a key with several resolves to none."""
    return df.groupBy(*keys).agg(F.count_distinct(id_column).alias("__n"), F.min(id_column).alias(id_column)).where("__n = 1").drop("__n")


def preferred(df: DataFrame, keys: list[str], source: str, best: str) -> DataFrame:
    """Rows of the ``best`` source where a key has any, else all its rows."""
    has_best = F.max(F.col(source) == best).over(Window.partitionBy(*keys))
    return df.withColumn("__best", has_best).where((F.col(source) == best) | ~F.coalesce("__best", F.lit(False))).drop("__best")


def members_at(members: DataFrame, points: DataFrame, key: str, start: str, end: str, at: str) -> DataFrame:
    """Pairs of a point and the members whose interval holds it: start <= at < end, or no end."""
    return points.join(members, key).where((F.col(start) <= F.col(at)) & (F.col(end).isNull() | (F.col(at) < F.col(end))))


def children_or_self(parents: DataFrame, key: str, edges: DataFrame, child: str, parent: str) -> DataFrame:
    """Each requested key with itself and its children: two equi joins instead of one with OR."""
    own = parents.join(edges.select(F.col(child).alias(key), F.col(child).alias("member")), key)
    below = parents.join(edges.select(F.col(parent).alias(key), F.col(child).alias("member")), key)
    return own.unionByName(below).distinct()


def in_caller_order(df: DataFrame, key: str, wanted: list) -> DataFrame:
    """Rows of the wanted keys in the order the caller gave them (``position``)."""
    spark = df.sparkSession
    kind = df.schema[key].dataType.simpleString()
    listed = spark.createDataFrame([(i, k) for i, k in enumerate(wanted)], f"position int, {key} {kind}")
    return df.join(F.broadcast(listed), key).orderBy("position")


def gaps_and_islands(df: DataFrame, keys: list[str], value: str, order: list[Column]) -> DataFrame:
    """Runs of equal values in order: keys, ``value``, first and last place (``first_at``, ``last_at``), ``length``."""
    w = Window.partitionBy(*keys).orderBy(*order)
    changed = (~F.col(value).eqNullSafe(F.lag(value).over(w)) | F.row_number().over(w).eqNullSafe(1)).cast("int")
    marked = df.withColumn("__place", F.row_number().over(w)).withColumn("__change", changed).withColumn("__run", F.sum("__change").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return marked.groupBy(*keys, "__run", value).agg(F.min("__place").alias("first_at"), F.max("__place").alias("last_at"), F.count(F.lit(1)).alias("length")).drop("__run")
