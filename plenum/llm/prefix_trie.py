"""Prefix trie of conversations (operator 11).

A conversation's turns are digested, the digests are chained from its first turn
on, and every prefix becomes a row. Prefixes with the same depth and digest are one
node of the trie. Sums over a node's subtree come from exploding nodes to all their
ancestors; a node hands its values to its smallest member, and what one member
holds below a depth goes to its ancestor there as one row, so there are never more
rows than prefixes, however deep a conversation is.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plenum.llm.grouped import bounds
from plenum.llm.storage import written
from plenum.llm.words import n_words

ROOT = hashlib.sha256(b"no turn").digest()
NO_ENDS = hashlib.sha256(b"").hexdigest()
SLICE_IDS = 1 << 16  # ids of one node that travel as one row
NODE, PARENT = ["node_a", "node_b"], ["parent_a", "parent_b"]  # the first 128 bits of a SHA-256 each


def numbered_turns(conversations: DataFrame) -> DataFrame:
    """``conv_id``, ``place`` (from 0), ``digest`` and ``words`` of every turn.

    Order: turn (null first), then role, then text. Texts are shuffled once, by
    conversation and turn, and only digests by conversation, so a conversation
    with very many turns has its texts spread over many tasks.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", role.alias("role"), text.alias("text")).where("conv_id is not null")
    tie = F.row_number().over(Window.partitionBy("conv_id", "turn").orderBy("role", "text"))
    framed = F.concat(F.octet_length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text"))
    narrow = rows.select("conv_id", "turn", tie.alias("tie"), F.unhex(F.sha2(framed, 256)).alias("digest"), n_words(F.col("text")).alias("words"))
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "tie")
    return narrow.select("conv_id", (F.row_number().over(order) - 1).cast("long").alias("place"), "digest", "words")


def shared_openings(turns: DataFrame, family: int = 20, most: int = 4) -> DataFrame:
    """Turns of conversations rebuilt on the opening of their family's first one, with a row of place -1 for each conversation.

    The first h turns (h: CRC-32 of the decimal id modulo ``most``) are those of conversation
    ``c - c % family``, or as many as it has.
    """
    own = turns.withColumn("h", F.crc32(F.col("conv_id").cast("string").cast("binary")) % most)
    every = own.where("place = 0").select("conv_id", "h", (F.col("conv_id") - F.col("conv_id") % family).alias("base"))
    heads = turns.where((F.col("conv_id") % family == 0) & (F.col("place") < most - 1)).withColumnRenamed("conv_id", "base")
    opening = every.join(heads, "base").where("place < h")
    columns = ["conv_id", "place", "digest", "words"]
    start = every.select("conv_id", F.lit(-1).cast("long").alias("place"), F.lit(None).cast("binary").alias("digest"), F.lit(0).cast("long").alias("words"))
    return start.unionByName(opening.select(*columns)).unionByName(own.where("place >= h").select(*columns))


def halves(digests: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(d[:16] for d in digests), "<i8").reshape(-1, 2)


def prefixes(turns: DataFrame) -> DataFrame:
    """Every prefix of every conversation: ``conv_id``, ``depth``, node, parent, ``words`` of its last turn, ``ends``.

    A conversation's digests pass through one task in order; it keeps the last digest and one row.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv_now, digest, depth, held = None, ROOT, 0, None
        for batch in batches:
            if not batch.num_rows:
                continue
            out = [] if held is None else [held]
            for conv, place, turn, words in zip(*(c.to_pylist() for c in batch.columns)):
                if place < 0:
                    conv_now, before, digest, depth = conv, ROOT, ROOT, 0
                else:
                    before, digest, depth = digest, hashlib.sha256(digest + turn).digest(), depth + 1
                out.append((conv_now, depth, digest, before, words))
            held = out.pop()  # whether it is a last turn shows in the next row
            if out:
                yield frame(out, held[0])
        if held is not None:
            yield frame([held], None)

    def frame(rows: list[tuple], following: int | None) -> pa.RecordBatch:
        conv, depth, node, parent, words = zip(*rows)
        ends = [a != b for a, b in zip(conv, [*conv[1:], following])]
        node, parent = halves(node), halves(parent)
        columns = [pa.array(conv, pa.int64()), pa.array(depth, pa.int64()), *(pa.array(x) for x in (*node.T, *parent.T)), pa.array(words, pa.int64()), pa.array(ends)]
        return pa.RecordBatch.from_arrays(columns, ["conv_id", "depth", *NODE, *PARENT, "words", "ends"])

    dealt = turns.select("conv_id", "place", "digest", "words").repartition("conv_id").sortWithinPartitions("conv_id", "place")
    return dealt.mapInArrow(run, "conv_id long, depth long, node_a long, node_b long, parent_a long, parent_b long, words long, ends boolean")


def end_digests(ends: DataFrame) -> DataFrame:
    """SHA-256 of each node's ids in ascending order, comma-joined.

    Ids are range-partitioned by node and id, so a node at which very many
    conversations end is cut into slices; its hash is fed slice after slice.
    """

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, conv = (c.to_numpy() for c in batch.columns)
            edge, stop = bounds(np.stack([a, b])) if len(a) else ([], [])
            cuts = [(i, min(i + SLICE_IDS, hi)) for lo, hi in zip(edge, stop) for i in range(lo, hi, SLICE_IDS)]
            ids = [",".join(map(str, conv[lo:hi].tolist())) for lo, hi in cuts]
            first = np.array([lo for lo, _ in cuts], np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(x[first]) for x in (a, b, conv)] + [pa.array(ids, pa.string())], [*NODE, "first", "ids"])

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, None
        for batch in batches:
            done: list[tuple] = []
            for a, b, ids in zip(*(batch.column(i).to_pylist() for i in (0, 1, 3))):
                if (a, b) == now:
                    state.update(b"," + ids.encode())
                    continue
                if now is not None:
                    done.append((*now, state.hexdigest()))
                now, state = (a, b), hashlib.sha256(ids.encode())
            if done:
                yield result(done)
        if now is not None:
            yield result([(*now, state.hexdigest())])

    def result(rows: list[tuple]) -> pa.RecordBatch:
        a, b, digest = zip(*rows)
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(digest)], [*NODE, "ends_sha256"])

    sliced = ends.repartitionByRange(*NODE, "conv_id").sortWithinPartitions(*NODE, "conv_id").mapInArrow(joined, "node_a long, node_b long, first long, ids string")
    ordered = sliced.repartition(*NODE).sortWithinPartitions(*NODE, "first")
    return ordered.mapInArrow(hashed, "node_a long, node_b long, ends_sha256 string")


def same(left: DataFrame, right: DataFrame, names: list[str]) -> Column:
    """``left`` at ``names`` is the node of ``right``."""
    return (left[names[0]] == right["r_a"]) & (left[names[1]] == right["r_b"])


def by_node(df: DataFrame) -> DataFrame:
    return df.withColumnsRenamed({"node_a": "r_a", "node_b": "r_b"})


def trie(turns: DataFrame) -> DataFrame:
    """Nodes of the prefix trie of ``turns`` (``conv_id``, ``place`` with a row of place -1 for each conversation, ``digest``, ``words``).

    One row per node: ``conv_id`` (smallest member), ``depth``, ``parent_conv_id`` (null at the root),
    ``n_convs``, ``n_children``, ``n_leaves``, ``saved_tokens``, ``ends_sha256``; see :func:`op11`.
    Nodes with very many children or members are counted by partial sums; only the
    lookup of a child's parent has such a key, and Spark splits that join's skewed side.
    """
    rows = written(prefixes(turns), "trie-prefixes")
    nodes = rows.groupBy("depth", *NODE).agg(
        F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.max("words").alias("words"), *[F.min(c).alias(c) for c in PARENT]
    )
    nodes = written(nodes, "trie-nodes")
    children = nodes.where("depth > 0").groupBy(*[F.col(p).alias(r) for p, r in zip(PARENT, ("r_a", "r_b"))]).agg(F.count(F.lit(1)).alias("n_children"))
    nodes = nodes.join(children, same(nodes, children, NODE), "left").drop("r_a", "r_b").withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("long")))
    own = nodes.select("conv_id", "depth", (F.col("n_children") == 0).cast("long").alias("leaf"), ((F.col("n_convs") - 1) * F.col("words")).alias("saved"))
    held = rows.select("conv_id", "depth", *NODE).join(own.where("leaf > 0 or saved > 0"), ["conv_id", "depth"], "left")
    below = Window.partitionBy("conv_id").orderBy(F.col("depth").desc()).rowsBetween(Window.unboundedPreceding, 0)
    to_ancestors = held.select(*NODE, F.sum("leaf").over(below).alias("leaf"), F.sum("saved").over(below).alias("saved")).where("leaf > 0 or saved > 0")
    subtree = by_node(to_ancestors.groupBy(*NODE).agg(F.sum("leaf").alias("n_leaves"), F.sum("saved").alias("saved_tokens")))
    nodes = nodes.join(subtree, same(nodes, subtree, NODE), "left").drop("r_a", "r_b")
    ends = by_node(end_digests(rows.where("ends").select(*NODE, "conv_id")))
    nodes = nodes.join(ends, same(nodes, ends, NODE), "left").drop("r_a", "r_b")
    parents = by_node(nodes.select(*NODE, F.col("conv_id").alias("parent_conv_id")))
    found = nodes.join(parents, same(nodes, parents, PARENT) & (nodes["depth"] > 0), "left")
    zero = F.lit(0).cast("long")
    return found.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", F.coalesce("n_leaves", zero).alias("n_leaves"),
        F.coalesce("saved_tokens", zero).alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(NO_ENDS)).alias("ends_sha256"),
    )


def conversation_trie(conversations: DataFrame) -> DataFrame:
    """The trie of ``conversations`` as they are (``conv_id``, ``turn``, ``role``, ``text``)."""
    turns = numbered_turns(conversations)
    start = turns.where("place = 0").select("conv_id", F.lit(-1).cast("long").alias("place"), F.lit(None).cast("binary").alias("digest"), F.lit(0).cast("long").alias("words"))
    return trie(start.unionByName(turns))


def op11(conversations: DataFrame) -> DataFrame:
    """The trie of ``conversations`` rebuilt on shared openings (:func:`shared_openings`).

    A node is a distinct sequence of first turns (role and text); the root has
    none. ``n_convs`` counts the members (conversations that start with it),
    ``n_children`` the nodes one turn deeper, ``n_leaves`` the childless nodes of its
    subtree, itself included; ``saved_tokens`` sums, over the subtree, the members but
    one times the words of the last text; ``ends_sha256`` is the hash of the ids of members that end there.
    Null role or text is empty, a null turn comes first, ties go by role and text,
    repeated rows are turns of their own. Rows without a conv_id belong to no
    conversation and are left out. Other columns are ignored; no rows, no nodes.
    """
    return trie(shared_openings(numbered_turns(conversations)))
