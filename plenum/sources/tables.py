"""Parquet tables by name, and a quarantine for rows that break their schema."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tables(spark: SparkSession, sf_dir: str, *names: str) -> list[DataFrame]:
    return [table(spark, sf_dir, n) for n in names]


def quarantine(df: DataFrame, checks: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """Rows that pass all checks, and the others with the names of the checks they fail (``failed``)."""
    failed = F.filter(F.array(*[F.when(~F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in checks.items()]), lambda x: x.isNotNull())
    marked = df.withColumn("failed", failed)
    return marked.where(F.size("failed") == 0).drop("failed"), marked.where(F.size("failed") > 0)


ATTACHMENT = T.StructType([T.StructField("name", T.StringType()), T.StructField("url", T.StringType()), T.StructField("type", T.StringType()), T.StructField("pages", T.ArrayType(T.IntegerType()))])
ITEM = T.StructType(
    [
        T.StructField("vendor_item_id", T.StringType()),
        T.StructField("title", T.StringType()),
        T.StructField("sequence", T.IntegerType()),
        T.StructField("agenda_number", T.StringType()),
        T.StructField("matter_file", T.StringType()),
        T.StructField("sponsors", T.ArrayType(T.StringType())),
        T.StructField("attachments", T.ArrayType(ATTACHMENT)),
    ]
)
MEETING = T.StructType(
    [
        T.StructField("vendor_id", T.StringType()),
        T.StructField("title", T.StringType()),
        T.StructField("start", T.StringType()),
        T.StructField("agenda_url", T.StringType()),
        T.StructField("packet_url", T.StringType()),
        T.StructField("items", T.ArrayType(ITEM)),
    ]
)
SEQUENCE_MOST = 10_000  # larger sequence numbers are taken for errors


def clean_attachments(items: Column) -> Column:
    """Attachments without those that lack a web address or have a page span out of order; the others stay."""

    def good(a: Column) -> Column:
        span = a["pages"].isNull() | ((F.size(a["pages"]) == 2) & (F.get(a["pages"], 0) >= 1) & (F.get(a["pages"], 1) >= F.get(a["pages"], 0)))
        return F.coalesce(a["url"].rlike("^https?://"), F.lit(False)) & F.coalesce(span, F.lit(False))

    return F.filter(items, good)


def read_meetings(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Meeting records from line-delimited JSON: valid rows and quarantined ones.

    Integer ids arrive as text, a sequence out of range becomes its place in the
    list, one malformed attachment drops alone, a record that is no JSON or has
    no id, no title or an unreadable start is quarantined.
    """
    shape = T.StructType([*MEETING.fields, T.StructField("_corrupt", T.StringType())])
    raw = spark.read.schema(shape).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").json(path)

    def tidy(item: Column, place: Column) -> Column:
        in_range = item["sequence"].between(0, SEQUENCE_MOST)
        return item.withField("sequence", F.when(in_range, item["sequence"]).otherwise(place + 1)).withField("attachments", clean_attachments(item["attachments"]))

    rows = raw.withColumn("items", F.transform("items", tidy)).withColumn("date", F.try_to_timestamp("start"))
    return quarantine(
        rows,
        {
            "json": F.col("_corrupt").isNull(),
            "vendor_id": F.length(F.trim("vendor_id")) > 0,
            "title": F.length(F.trim("title")) > 0,
            "start": F.col("start").isNull() | F.col("date").isNotNull(),
        },
    )
