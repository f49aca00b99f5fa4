"""Read-only SQL: one query over registered tables, checked by Spark's own parser."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

COMMENTS = re.compile(r"--[^\n]*|/\*.*?\*/", re.S)
FORBIDDEN = re.compile(r"\b(insert|update|delete|merge|drop|alter|create|truncate|grant|revoke|set|reset|call|copy|load|refresh|cache|uncache|analyze|msck|use|add|reflect|java_method)\b", re.I)


class NotReadOnly(ValueError):
    """The text is no single read-only query."""


def validated(spark: SparkSession, sql: str) -> str:
    """The query without comments, if it is one SELECT or WITH; strings are not looked at for forbidden words."""
    text = COMMENTS.sub(" ", sql).strip().rstrip(";").strip()
    bare = re.sub(r"'(?:[^'\\]|''|\\.)*'", "''", text)
    if ";" in bare:
        raise NotReadOnly("one statement only")
    if not re.match(r"(?i)(select|with)\b", bare) or FORBIDDEN.search(bare):
        raise NotReadOnly("only SELECT and WITH queries are allowed")
    plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(text)
    if "Command" in plan.getClass().getSimpleName():
        raise NotReadOnly("commands are not allowed")
    return text


def run_query(spark: SparkSession, sql: str, limit: int = 1000) -> DataFrame:
    """Result of a validated query, at most ``limit`` rows."""
    return spark.sql(validated(spark, sql)).limit(limit)
