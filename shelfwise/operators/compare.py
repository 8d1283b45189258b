"""Run-to-run comparison (§2.7).

The reference compares two runs' SKU lists with array set functions that keep
the left side's duplicates, so counts are semi / anti joins over rows, not
INTERSECT / EXCEPT over distinct values.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwise.operators.ranking import first_per_key


def _run(df: DataFrame, run_id: str) -> DataFrame:
    return df.where(F.col("scraper_id") == run_id)


def compare_skus(products: DataFrame, run1: str, run2: str) -> DataFrame:
    """SET1: totals, common (left duplicates kept), only in 1, only in 2 — one row.

    One pass: rows per sku and run are counted (partial aggregates), then summed.
    Rows without a sku count in the totals and are in no other run.
    """
    s = F.col("scraper_id")
    per = products.where(s.isin(run1, run2)).groupBy("sku").agg(
        F.count_if(s == run1).alias("a"), F.count_if(s == run2).alias("b"))
    both = F.col("sku").isNotNull() & (F.col("a") > 0) & (F.col("b") > 0)
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    return per.agg(total(F.col("a")).alias("total_run1"), total(F.col("b")).alias("total_run2"),
                   total(F.when(both, F.col("a"))).alias("common"),
                   total(F.when(~both, F.col("a"))).alias("only_in_run1"),
                   total(F.when(~both, F.col("b"))).alias("only_in_run2"))


def price_changes(products: DataFrame, run1: str, run2: str, limit: int | None = None) -> DataFrame:
    """SET2: price movement for the common SKU rows of run 1, all of them unless a
    ``limit`` is given.

    A limit cuts the run-1 rows (ordered by product_id, duplicates kept) whose sku
    is in run 2 *before* keeping the rows whose price changed.  Each side's price is its first row per sku.  A
    missing price counts as 0 in the difference; percent is 0 when the old
    price is not positive.
    """
    a = _run(products, run1)
    b = _run(products, run2)
    head = a.select("product_id", "sku").join(b.select("sku").distinct(), "sku", "left_semi")
    if limit is not None:
        head = head.orderBy("product_id").limit(limit)
    first_a = first_per_key(a.select("sku", "product_id", "title", "price"), ["sku"], "product_id")
    first_b = first_per_key(b.select("sku", "product_id", "price"), ["sku"], "product_id")
    j = (head.select(F.col("product_id").alias("row_id"), "sku")
         .join(first_a.select("sku", "title", F.col("price").alias("price_run1")), "sku")
         .join(first_b.select("sku", F.col("price").alias("price_run2")), "sku"))
    p1, p2 = F.col("price_run1"), F.col("price_run2")
    diff = F.coalesce(p2, F.lit(0)) - F.coalesce(p1, F.lit(0))
    return (j.where(~p1.eqNullSafe(p2))
            .select("row_id", "sku", "title", "price_run1", "price_run2", diff.alias("difference"),
                    F.when(p1 > 0, F.round(F.lit(100.0) * diff / p1, 2)).otherwise(F.lit(0.0))
                    .cast("double").alias("percentage")))


def count_deltas(df: DataFrame, run1: str, run2: str) -> DataFrame:
    """SET3: row totals of two runs and their difference (run2 - run1)."""
    return df.agg(F.count_if(F.col("scraper_id") == run1).alias("total_run1"),
                  F.count_if(F.col("scraper_id") == run2).alias("total_run2")) \
        .withColumn("difference", F.col("total_run2") - F.col("total_run1"))
