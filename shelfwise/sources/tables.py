"""Scans and list imports (SRC1–SRC4)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfwise import schemas

TRIM_CHARS = " \t\r\n"


def read_table(spark: SparkSession, base: str, name: str) -> DataFrame:
    """SRC1: scan one catalogue table with its declared schema (no inference).

    Filters and projections applied later are pushed into this parquet scan.
    """
    return spark.read.schema(schemas.TABLES[name]).parquet(f"{base.rstrip('/')}/{name}.parquet")


def read_pages(spark: SparkSession, base: str, min_partitions: int | None = None) -> DataFrame:
    """SRC2: stored raw pages (page_id, url, html).

    HTML rows are large; ``min_partitions`` spreads them over more tasks
    (round-robin repartition) before the regex-heavy page jobs.
    """
    df = read_table(spark, base, "pages")
    return df.repartition(min_partitions) if min_partitions else df


def _lines(text: DataFrame, column: str = "value") -> DataFrame:
    """One trimmed, non-blank line per row."""
    lines = text.select(F.explode(F.split(F.col(column), "\n")).alias("line"))
    lines = lines.select(F.trim(F.col("line"), F.lit(TRIM_CHARS)).alias("line"))
    return lines.where(F.col("line") != "")


def import_keywords(text: DataFrame, platform: str, existing: DataFrame, column: str = "value") -> tuple[DataFrame, DataFrame]:
    """SRC3: keyword list import — one keyword per line, trimmed, blanks dropped,
    only new (platform, keyword) pairs inserted.

    Returns (new keyword rows, counts).  ``skipped`` counts non-blank lines that
    were not inserted (already present, or repeated in the input).
    """
    lines = _lines(text, column)
    new = (lines.select(F.lit(platform).alias("platform"), F.col("line").alias("keyword")).distinct()
           .join(existing.select("platform", "keyword"), ["platform", "keyword"], "left_anti")
           .withColumn("status", F.lit(True)))
    counts = lines.agg(F.count(F.lit(1)).alias("lines_read")).select(
        "lines_read", new.select(F.count(F.lit(1))).scalar().alias("created"))
    counts = counts.withColumn("skipped", F.col("lines_read") - F.col("created"))
    return new, counts


def enqueue_urls(urls: DataFrame, platform: str, priority: int, existing: DataFrame,
                 column: str = "url") -> DataFrame:
    """SRC4: queue new urls — trimmed, blanks dropped, existing (platform, url)
    skipped, status pending with the given priority."""
    u = (urls.select(F.trim(F.col(column), F.lit(TRIM_CHARS)).alias("url")).where(F.col("url") != "")
         .select(F.lit(platform).alias("platform"), "url").distinct())
    new = u.join(existing.select("platform", "url"), ["platform", "url"], "left_anti")
    return new.select("platform", "url", F.lit("pending").alias("status"),
                      F.lit(priority).cast("int").alias("priority"), F.lit(0).alias("retry_count"))
