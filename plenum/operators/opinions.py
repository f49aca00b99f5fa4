"""Opinion clustering: vote matrix, imputation, projection, clusters and consensus."""

from __future__ import annotations

from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


MOST_COMMENTS = 10_000  # columns of a full matrix


def imputed(votes: DataFrame, user: str = "user_id", comment: str = "comment_id", vote: str = "vote") -> DataFrame:
    """All pairs of participants and comments: the vote, or the comment's mean where there is none.

    The full matrix is what the projection needs and nothing else should ask for
    (:func:`consensus` works on the votes). One discussion has a few hundred
    comments; over ``MOST_COMMENTS`` this raises.
    """
    means = votes.groupBy(comment).agg(F.avg(vote).alias("mean"))
    if (n := means.count()) > MOST_COMMENTS:
        raise ValueError(f"{n} comments are too many for a full matrix; cluster by a part of them")
    people = votes.select(user).distinct()
    grid = people.crossJoin(F.broadcast(means))  # at most MOST_COMMENTS rows
    full = grid.join(votes.select(user, comment, F.col(vote).cast("double").alias("own")), [user, comment], "left")
    return full.select(user, comment, F.coalesce("own", "mean", F.lit(0.0)).alias("value"), F.col("own").isNotNull().alias("voted"))


def how_many(participants: Column, most: int = 5) -> Column:
    """Number of clusters for so many participants."""
    return F.greatest(F.lit(2), F.least(2 + F.floor(participants / 12), F.lit(most), participants))


def vectors(matrix: DataFrame, user: str = "user_id", comment: str = "comment_id") -> DataFrame:
    """One vector a participant, in order of comment."""
    ordered = F.array_sort(F.collect_list(F.struct(comment, "value")))
    return matrix.groupBy(user).agg(array_to_vector(F.transform(ordered, lambda x: x["value"])).alias("features"))


def project(rows: DataFrame, dims: int = 2) -> DataFrame:
    model = PCA(k=dims, inputCol="features", outputCol="position").fit(rows)
    return model.transform(rows).withColumn("position", vector_to_array("position"))


def clusters(rows: DataFrame, k: int, seed: int = 42) -> DataFrame:
    model = KMeans(k=k, seed=seed, maxIter=100, featuresCol="features", predictionCol="cluster").fit(rows)
    return model.transform(rows)


def consensus(votes: DataFrame, labels: DataFrame, user: str = "user_id", comment: str = "comment_id", vote: str = "vote") -> tuple[DataFrame, DataFrame]:
    """Votes of each cluster and comment, and smoothed agreement of each comment averaged over clusters.

    As on the imputed matrix: agreement is a value of exactly 1, disagreement of
    exactly -1, and seen is the size of the cluster. A missing vote stands for the
    comment's mean, so it counts only where that mean is 1 or -1; the matrix itself
    is never built. Clusters are few (:func:`how_many`), so their product with the
    comments is small.
    """
    means = votes.groupBy(comment).agg(F.avg(vote).alias("mean"))
    people = labels.select(user, "cluster")
    sizes = votes.select(user).distinct().join(people, user).groupBy("cluster").agg(F.count(F.lit(1)).alias("seen"))
    said = votes.join(people, user).groupBy("cluster", comment).agg(F.count_if(F.col(vote) == 1).alias("yes"), F.count_if(F.col(vote) == -1).alias("no"), F.count(vote).alias("given"))
    cells = means.crossJoin(sizes).join(said, ["cluster", comment], "left")
    silent = F.col("seen") - F.coalesce("given", F.lit(0))
    agree = F.coalesce("yes", F.lit(0)) + F.when(F.col("mean") == 1, silent).otherwise(0)
    disagree = F.coalesce("no", F.lit(0)) + F.when(F.col("mean") == -1, silent).otherwise(0)
    groups = cells.select("cluster", comment, agree.alias("agree"), disagree.alias("disagree"), "seen")
    score = groups.groupBy(comment).agg(F.avg((F.col("agree") + 1) / (F.col("seen") + 2)).alias("consensus"))
    return groups, score


def centers(positions: DataFrame) -> DataFrame:
    """Mean position of each cluster."""
    return positions.groupBy("cluster").agg(F.avg(F.get("position", 0)).alias("x"), F.avg(F.get("position", 1)).alias("y"), F.count(F.lit(1)).alias("n"))
