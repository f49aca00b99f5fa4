"""Token counts in Arrow batches balanced by bytes (operator 6)."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BATCH_BYTES = 1 << 20
PART_CHARS = 1 << 14  # texts longer than this are split, where that is safe
LIMIT = 4096
SAFE = re.compile(r"(?<=[A-Za-z]) (?=[A-Za-z])")


@cache
def sentencepiece_model(path: str):
    from sentencepiece import SentencePieceProcessor

    return SentencePieceProcessor(model_file=path)


@cache
def splittable(path: str) -> bool:
    """True if no piece of the model holds a space mark after another character.

    Then no merge can span the space between two letters, and a part after such a
    space starts with the same mark that the model puts before every text.
    """
    model = sentencepiece_model(path)
    return all("▁" not in model.id_to_piece(i).lstrip("▁") for i in range(model.vocab_size())) and model.encode("a", out_type=str)[0].startswith("▁")


def parts(text: str, most: int = PART_CHARS) -> list[str]:
    """``text`` cut at single spaces between ASCII letters into parts of about ``most`` characters.

    The space at a cut is left out: the model's mark before each text stands for
    it. A stretch without a safe place stays whole.
    """
    out, start = [], 0
    while len(text) - start > most:
        place = SAFE.search(text, start + most)
        if place is None:
            break
        out.append(text[start : place.start()])
        start = place.end()
    out.append(text[start:])
    return out


def token_lengths(texts: list[str], path: str) -> list[int]:
    """Tokens of each text, encoded in batches of about ``BATCH_BYTES``."""
    model, safe = sentencepiece_model(path), splittable(path)
    counts = [0] * len(texts)
    batch: list[str] = []
    owner: list[int] = []
    size = 0

    def flush() -> None:
        nonlocal size
        for i, ids in zip(owner, model.encode(batch, num_threads=1)):
            counts[i] += len(ids)
        batch.clear()
        owner.clear()
        size = 0

    for i, text in enumerate(texts):
        for part in parts(text) if safe else [text]:
            batch.append(part)
            owner.append(i)
            size += len(part) if part.isascii() else len(part.encode("utf-8", "surrogatepass"))
            if size >= BATCH_BYTES:
                flush()
    if batch:
        flush()
    return counts


def count_tokens(docs: DataFrame, model_path: str, limit: int = LIMIT) -> DataFrame:
    """``doc_id``, ``n_bytes``, ``n_tokens`` and ``over_limit`` of every row of ``docs``.

    Null texts count as empty: no bytes, no tokens. Repeated rows are counted
    each; an empty table gives an empty result. Only lengths leave the workers.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = token_lengths([x.as_py() or "" for x in batch.column(2)], model_path)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(counts, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    source = docs.select(F.col("doc_id").cast("long"), F.octet_length(text).cast("long").alias("n_bytes"), text.alias("text"))
    counted = source.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)


def op6(docs: DataFrame) -> DataFrame:
    """Counts under piece_bpe_32k.model."""
    import public_tokenizers

    return count_tokens(docs, public_tokenizers.path("piece_bpe_32k.model"))
