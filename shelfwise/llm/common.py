"""Helpers shared by the training-data operators."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfwise.session import checkpoint_dir

#: A stored table up to this many rows may be broadcast (each row is a few dozen bytes).
BROADCAST_ROWS = 200_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


#: Spark's setting that shuffle files go when the action that wrote them ends.
FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored(df: DataFrame, name: str, free: bool = False) -> DataFrame:
    """``df`` written once to the shared folder and read back.

    Cuts the lineage: what follows reads files that every executor sees, so a lost
    executor costs no recomputation of ``df``, and every reader sees the same rows.
    With ``free`` the shuffle files behind it are removed as soon as it is written.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/llm/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(FREE_SHUFFLES, "false")
    spark.conf.set(FREE_SHUFFLES, "true" if free else before)
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(FREE_SHUFFLES, before)
    return spark.read.schema(df.schema).parquet(path)


def fresh(df: DataFrame, name: str) -> str:
    """``name``, with underscores before it until ``df`` has no column of that name (in any case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def maybe_broadcast(df: DataFrame, rows: int) -> DataFrame:
    """Broadcast hint for a stored table of known, small row count; else Spark shuffles."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def text_key(text) -> F.Column:
    """64-bit content hash; with the document's id it names a text without carrying it."""
    return F.xxhash64(F.coalesce(text, F.lit("")), text.isNull())
