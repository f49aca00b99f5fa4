"""The driver's queries for the training-data operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from plenum.llm import additive_search, decision_list, html_text, line_dedup, mixing, packing, prefix_trie, repeats, shingle_join, simhash, target_sampling, token_counts, warc
from plenum.llm.oracles import ORACLES

Query = Callable[[SparkSession, str], DataFrame]


def over(table: str, apply: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: apply(spark.read.parquet(f"{sf_dir}/{table}.parquet"))


def quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    return decision_list.op4(documents, labels)


def target_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, benchmark = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    return target_sampling.op12(documents, benchmark)


def queries() -> dict[str, Query]:
    return {
        "op1_simhash": over("documents", simhash.op1),
        "op2_html_text": over("pages", html_text.op2),
        "op3_additive_search": over("embeddings", additive_search.op3),
        "op4_quality_rules": quality_rules,
        "op5_mixing": over("documents", mixing.op5),
        "op6_token_counts": over("documents", token_counts.op6),
        "op7_repeats": over("documents", repeats.op7),
        "op8_warc": over("pages", warc.op8),
        "op9_line_dedup": over("documents", line_dedup.op9),
        "op10_packing": over("documents", packing.op10),
        "op11_prefix_trie": over("conversations", prefix_trie.op11),
        "op12_target_sampling": target_resampling,
        "op13_shingle_join": over("documents", shingle_join.op13),
    }


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
