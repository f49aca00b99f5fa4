"""Approximate nearest neighbours by additive quantisation (operator 3)."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plenum.llm.storage import cut

CODEBOOKS = 8  # at least; one for each 8 dimensions, so that a dimension has a bit whatever the length
CODEWORDS = 256
BEAM = 4
TRAIN_ROWS = 8192  # rows the codebooks are fitted on; every row is encoded
BLOCK_ROWS = 16384  # vectors scored by one task
QUERY_ROWS = 16384  # queries held by one task
RERANK = 640  # candidates of a query and block that are scored exactly at first: a twenty-fifth of a full block
DEVIATIONS = 3.0  # then every other one whose score may be off by this many deviations and reach the best
REFIT = 8  # codebooks that are refitted together


def kmeans(rows: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 12) -> np.ndarray:
    """Lloyd's centroids; empty clusters are reseeded with the rows farthest from their centroid."""
    centres = rows[rng.choice(len(rows), k, replace=len(rows) < k)].copy()
    for _ in range(rounds):
        far = (centres**2).sum(1)[None, :] - 2 * rows @ centres.T
        near = far.argmin(1)
        counts = np.bincount(near, minlength=k)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, rows)
        full = counts > 0
        centres[full] = sums[full] / counts[full, None]
        if not full.all():
            error = far[np.arange(len(rows)), near] + (rows**2).sum(1)
            worst = np.argsort(-error)[: int((~full).sum())]
            centres[np.flatnonzero(~full)[: len(worst)]] = rows[worst]
    return centres


def encode(rows: np.ndarray, books: np.ndarray, beam: int = BEAM) -> tuple[np.ndarray, np.ndarray]:
    """Codes of ``rows`` by beam search over the codebooks, and the decoded vectors.

    Every codebook spans all dimensions. The beam keeps the ``beam`` partial sums
    nearest to the row; each step tries all codewords on each residual.
    """
    n, dim = rows.shape
    codes = np.zeros((n, 1, 0), np.uint8)
    residual = rows[:, None, :].astype(np.float32)
    for book in books:
        norms = (book**2).sum(1)
        width = residual.shape[1]
        flat = residual.reshape(-1, dim)
        error = (norms[None, :] - 2 * flat @ book.T + (flat**2).sum(1)[:, None]).reshape(n, -1)
        keep = min(beam, error.shape[1])
        best = np.argpartition(error, keep - 1, axis=1)[:, :keep]
        origin, word = best // len(book), best % len(book)
        pick = np.arange(n)[:, None]
        codes = np.concatenate([codes[pick, origin], word[:, :, None].astype(np.uint8)], axis=2)
        residual = residual[pick, origin] - book[word]
        assert width >= 1
    error = (residual**2).sum(2)
    best = error.argmin(1)
    pick = np.arange(n)
    return codes[pick, best], rows - residual[pick, best]


def refit(rows: np.ndarray, books: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """Codebooks that decode ``codes`` nearest to ``rows``: ridge least squares around ``books``."""
    codebooks, codewords, _ = books.shape
    total = codebooks * codewords
    hit = (codes + np.arange(codebooks)[None, :] * codewords).astype(np.int64)
    gram, right = np.zeros((total, total)), np.zeros((total, rows.shape[1]))
    for m in range(codebooks):
        np.add.at(right, hit[:, m], rows)
        for other in range(codebooks):
            np.add.at(gram, (hit[:, m], hit[:, other]), 1.0)
    start = books.reshape(total, -1).astype(np.float64)
    change = np.linalg.solve(gram + 0.05 * np.eye(total), right - gram @ start)
    return (start + change).reshape(books.shape).astype(np.float32)


def train(rows: np.ndarray, codebooks: int = CODEBOOKS, codewords: int = CODEWORDS, seed: int = 7) -> np.ndarray:
    """Codebooks (codebook, word, dimension): residual k-means, then least-squares refits of ``REFIT`` books together."""
    rng = np.random.default_rng(seed)
    rows = rows.astype(np.float32)
    books = []
    residual = rows.copy()
    for _ in range(codebooks):
        book = kmeans(residual, codewords, rng)
        far = (book**2).sum(1)[None, :] - 2 * residual @ book.T
        residual = residual - book[far.argmin(1)]
        books.append(book)
    books = np.stack(books).astype(np.float32)
    for _ in range(2):
        codes, decoded = encode(rows, books)
        for at in range(0, codebooks, REFIT):
            part = range(at, min(at + REFIT, codebooks))
            own = sum(books[m][codes[:, m]] for m in part)
            fitted = refit(rows - decoded + own, books[part.start : part.stop], codes[:, part.start : part.stop])
            books[part.start : part.stop] = fitted
            decoded = decoded - own + sum(books[m][codes[:, m]] for m in part)
    return books


def top(scores: np.ndarray, keep: int) -> list[np.ndarray]:
    """For each row the columns of the ``keep`` highest scores; ties at the edge go to the lower column."""
    n = scores.shape[1]
    if n <= keep:
        return [np.arange(n)] * len(scores)
    edge = np.partition(scores, n - keep, axis=1)[:, n - keep]
    out = []
    for row, least in zip(scores, edge):
        above = np.flatnonzero(row > least)
        level = np.flatnonzero(row == least)[: keep - len(above)]
        out.append(np.concatenate([above, level]))
    return out


def valid_vectors(table: DataFrame) -> DataFrame:
    """Rows that take part: ``vec_id`` and vector not null, all components finite, not all zero; components keep their precision."""
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    zero = F.forall("embedding", lambda x: x == 0)
    kind = "array<float>" if table.schema["embedding"].dataType.simpleString() == "array<float>" else "array<double>"
    chosen = table.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(kind).alias("embedding"))
    return chosen.where("vec_id is not null and embedding is not null").where(~bad & ~zero)


OUT = "query_id long, rank int, vec_id long, score double"


def nearest(table: DataFrame, queries: DataFrame, k: int = 20, rerank: int = RERANK) -> DataFrame:
    """The ``k`` rows of ``table`` with the largest inner product for each row of ``queries``.

    Both have ``vec_id`` and ``embedding``. Equal vectors form one class that is
    encoded and scored once and keeps its ``k + 1`` smallest ids, so a vector
    that a third of the rows share costs as much as any other. A query meets the
    vectors of its own length; each length that queries have gets its own
    codebooks. An id is never its own neighbour. Rows with a null id, or a vector
    that is null, zero or has a null or non-finite component take no part;
    repeated ids with equal vectors count once. Empty tables give an empty
    result; fewer than ``k`` candidates give all of them.
    """
    spark = table.sparkSession
    rank_ids = Window.partitionBy("embedding").orderBy("vec_id")
    rows = valid_vectors(table).withColumn("place", F.dense_rank().over(rank_ids)).where(F.col("place") <= k + 1)
    classes = rows.groupBy("embedding").agg(F.array_sort(F.collect_set("vec_id")).alias("ids"))
    classes = cut(classes.select("embedding", "ids", F.element_at("ids", 1).alias("first"), F.size("embedding").alias("length")))
    asked = cut(valid_vectors(queries).dropDuplicates(["vec_id"]).withColumn("length", F.size("embedding")))
    lengths = asked.groupBy("length").agg(F.count(F.lit(1)).alias("wanted")).join(classes.groupBy("length").agg(F.count(F.lit(1)).alias("total")), "length")
    hits = [nearest_of_length(classes.where(F.col("length") == r["length"]), asked.where(F.col("length") == r["length"]), r["total"], r["wanted"], k, rerank) for r in lengths.orderBy("length").collect()]
    if not hits:
        return spark.createDataFrame([], OUT)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return reduce(DataFrame.unionByName, hits).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def nearest_of_length(classes: DataFrame, asked: DataFrame, total: int, wanted: int, k: int, rerank: int) -> DataFrame:
    """``query_id``, ``vec_id``, ``score`` of the best ``k`` rows a query and block; vectors have one length.

    The codebooks are fitted on ``TRAIN_ROWS`` classes in hash order; every class is
    encoded. Classes and queries are dealt at random to blocks of bounded size; a
    task scores one block of codes against one block of queries by lookup tables
    (scaled by the stored norm over the decoded norm), reranks the best
    ``rerank`` classes by the exact double-precision product, then all others whose decoded product plus
    ``DEVIATIONS`` times its error (stored residual norm times the query's over the root of the
    dimensions) reaches the best ``k`` so far, and emits ``k`` rows a query.
    """
    spark = classes.sparkSession
    kind = classes.schema["embedding"].dataType.simpleString()
    sample = classes.orderBy(F.xxhash64("first"), "first").limit(TRAIN_ROWS).select("embedding").toPandas()
    rows = np.stack(sample["embedding"].to_numpy())
    books = train(rows, max(CODEBOOKS, -(-rows.shape[1] // 8)), min(CODEWORDS, max(1, len(sample))))
    shared = spark.sparkContext.broadcast(books)  # codebooks x CODEWORDS x dimensions floats, whatever the table's size

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            block = batch.column(0).flatten().to_numpy().reshape(batch.num_rows, -1).astype(np.float32)
            codes, decoded = encode(block, shared.value)
            length, met = np.linalg.norm(block, axis=1), np.linalg.norm(decoded, axis=1)
            scale = np.where(met > 0, length / np.where(met > 0, met, 1), 0).astype(np.float32)
            error = np.linalg.norm(block - decoded, axis=1).astype(np.float32)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), batch.column(2), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(scale), pa.array(error)],
                ["embedding", "ids", "first", "codes", "scale", "error"],
            )

    blocks, shelves = -(-total // BLOCK_ROWS), -(-wanted // QUERY_ROWS)
    coded = classes.select("embedding", "ids", "first").mapInArrow(index, f"embedding {kind}, ids array<long>, first long, codes binary, scale float, error float")
    left = coded.withColumn("block", F.pmod(F.xxhash64("first"), F.lit(blocks))).withColumn("shelf", F.explode(F.sequence(F.lit(0), F.lit(shelves - 1))))
    right = asked.withColumn("shelf", F.pmod(F.xxhash64("vec_id"), F.lit(shelves)).cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))

    def search(base: pd.DataFrame, ask: pd.DataFrame) -> pd.DataFrame:
        if not len(base) or not len(ask):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        base = base.sort_values("first", kind="stable")
        vectors = np.stack(base["embedding"].to_numpy())
        codes = np.frombuffer(b"".join(base["codes"]), np.uint8).reshape(len(base), -1)
        scale, error, ids = base["scale"].to_numpy(np.float32), base["error"].to_numpy(np.float32), base["ids"].to_numpy()
        wide, word = shared.value, len(shared.value[0])
        names = ask["vec_id"].to_numpy()
        found: list[tuple] = []
        for at in range(0, len(ask), 256):
            whole = np.stack(ask["embedding"].iloc[at : at + 256].to_numpy()).astype(np.float64)
            part = whole.astype(np.float32)
            tables = np.einsum("mwd,qd->mwq", wide, part).reshape(len(wide), word, len(part))
            scores = tables[0][codes[:, 0]]
            for m in range(1, len(wide)):
                scores += tables[m][codes[:, m]]
            may = scores + error[:, None] * (DEVIATIONS * np.linalg.norm(part, axis=1) / np.sqrt(part.shape[1]))[None, :]
            scores *= scale[:, None]
            for q, columns in enumerate(top(np.ascontiguousarray(scores.T), rerank)):
                exact = vectors[columns].astype(np.float64) @ whole[q]
                if k + 1 < len(exact) < len(base):  # one more than k, for the query itself may be among them
                    more = may[:, q] >= np.partition(exact, -k - 1)[-k - 1]
                    more[columns] = False
                    more = np.flatnonzero(more)
                    columns, exact = np.concatenate([columns, more]), np.concatenate([exact, vectors[more].astype(np.float64) @ whole[q]])
                close = np.flatnonzero(exact >= np.partition(exact, -keep)[-keep] - 1e-9 * (1 + np.abs(exact).max())) if (keep := min(k + 1, len(exact))) else np.arange(0)
                columns = columns[close]
                exact = np.cumsum(vectors[columns].astype(np.float64) * whole[q], axis=1)[:, -1]  # in order of the components
                columns, exact = columns[o := np.lexsort((columns, -exact))], exact[o]
                me, got = names[at + q], []
                for c, s in zip(columns, exact):
                    if len(got) >= k and s < got[-1][1]:
                        break
                    got.extend((i, s) for i in ids[c] if i != me)
                got.sort(key=lambda x: (-x[1], x[0]))
                found.extend((me, i, s) for i, s in got[:k])
        return pd.DataFrame(found, columns=["query_id", "vec_id", "score"])

    return left.groupBy("block", "shelf").cogroup(right.groupBy("block", "shelf")).applyInPandas(search, "query_id long, vec_id long, score double")


def op3(embeddings: DataFrame) -> DataFrame:
    """The 20 nearest of every row whose ``vec_id`` is divisible by 20, against all rows."""
    return nearest(embeddings, embeddings.where("vec_id % 20 = 0"))
