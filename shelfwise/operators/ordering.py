"""Sort, limit and paging (§2.6).

Global ``orderBy`` is a range-partitioned sort (sampled bounds), so a hot sort
key is spread over several ranges instead of one task; ``orderBy().limit(k)``
plans as a per-partition top-k.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def order_by(df: DataFrame, column: str | None, direction: str | None = "desc",
             allowed: list[str] | None = None, default: str = "created_at",
             tie_break: str | None = None) -> DataFrame:
    """SRT1: caller-chosen sort column (whitelisted, else the default) and direction.

    Spark's null order already matches MySQL: nulls first ascending, last descending.
    """
    if not column or (allowed is not None and column not in allowed):
        column = default
    c = F.col(column).desc() if (direction or "").lower() == "desc" else F.col(column).asc()
    keys = [c] + ([F.col(tie_break)] if tie_break else [])
    return df.orderBy(*keys)


def page(df: DataFrame, keys: list, size: int = 20, number: int = 1, with_total: bool = True) -> DataFrame:
    """SRT2: page ``number`` (1-based) of ``size`` rows plus the total row count.

    The key list must end with a unique column so pages are stable.  For deep
    pages use :func:`page_after` (keyset) instead of an offset.
    """
    out = df.orderBy(*keys).offset((number - 1) * size).limit(size)
    if with_total:
        out = out.withColumn("total_rows", df.select(F.count(F.lit(1))).scalar())
    return out


def page_after(df: DataFrame, key: str, unique: str, after_key=None, after_unique=None,
               size: int = 20) -> DataFrame:
    """SRT2 keyset variant: the ``size`` rows after (after_key, after_unique)."""
    if after_key is not None:
        df = df.where((F.col(key) > after_key) | ((F.col(key) == after_key) & (F.col(unique) > after_unique)))
    return df.orderBy(key, unique).limit(size)


def sample_n(df: DataFrame, n: int = 10, key: str = "id") -> DataFrame:
    """SRT3: first ``n`` rows by id."""
    return df.orderBy(key).limit(n)


def keyword_list(keywords: DataFrame) -> DataFrame:
    """SRT4: keywords sorted by platform then keyword."""
    return keywords.orderBy("platform", "keyword")


def runs_by_category(runs: DataFrame) -> DataFrame:
    """SRT5: runs grouped by category, newest first inside each category.

    Emitted as rows (category, runs in category, run columns) in a global sort
    rather than one collected list per category, so a large category is never
    gathered into one row or one task.
    """
    counts = runs.groupBy("category").agg(F.count(F.lit(1)).alias("category_runs"))
    return (runs.join(counts, "category")
            .select("category", "category_runs", "scraper_id", "platform", "status", "created_at")
            .orderBy("category", F.col("created_at").desc(), F.col("scraper_id").desc()))
