"""End-to-end jobs: each is one Spark job graph built from the operators.

A. ingest      stored product pages → records → validation → upsert → new table version + counters
B. dashboard   the stats document (overview, per-platform performance, health)
C. run compare SKU overlap, price movement and row deltas of two runs
D. rankings    stored search pages → cards → positions (per platform scheme) → product ids → append
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfwise.operators import compare as cp
from shelfwise.operators import filters as fl
from shelfwise.operators import pages as pg
from shelfwise.operators import ranking as rk
from shelfwise.operators import stats
from shelfwise.operators import upsert as up
from shelfwise.operators.common import lit
from shelfwise.operators.joins import resolve_product
from shelfwise.session import checkpoint_dir
from shelfwise.sources import export as ex

# fixed values: how each platform numbers search positions
POSITION_SCHEME = {
    "amazon": "organic", "flipkart": "organic", "meesho": "organic", "blinkit": "organic",
    "reliancedigital": "slot", "bigbasket": "slot", "croma": "organic_slot", "vijaysales": "kept_base",
}


def ingest(spark: SparkSession, pages: DataFrame, current: DataFrame | None, asof,
           target: str, version: str) -> tuple[str, DataFrame, DataFrame]:
    """A: parse product pages, keep valid records, merge them into ``current``
    and write the result as ``target/v=<version>``.

    Returns (written path, ingest counters per platform, rejected records).
    """
    records = pg.page_products(pages)
    good, rejected = fl.validate_products(records)
    good = good.drop("warning").withColumnRenamed("page_id", "product_id") \
        .withColumn("product_id", F.md5(F.concat_ws("|", "platform", "sku"))) \
        .withColumn("scraped_date", F.to_date(F.lit(asof)))
    if current is None:
        current = spark.createDataFrame([], good.schema)
    # written once with the action of every row, so the pages are parsed once for table and counters
    staged = f"{checkpoint_dir(spark).rstrip('/')}/ingest/{version}-{uuid.uuid4().hex}"
    result = up.upsert_products(current, good, asof)
    result.write.parquet(staged)
    merged = spark.read.schema(result.schema).parquet(staged)
    path = up.write_version(merged.drop("action"), target, version, partition_by=["platform"])
    counters = up.ingest_counters(merged)
    return path, counters, rejected


def positions(items: DataFrame, per_page: int = 24) -> DataFrame:
    """D (numbering): each platform's cards numbered with its own scheme."""
    out = None
    for scheme, fn in (("organic", rk.organic_position), ("slot", lambda d: rk.slot_position(d, per_page)),
                       ("organic_slot", lambda d: rk.organic_slot_position(d, per_page)),
                       ("kept_base", rk.kept_base_position)):
        plats = [p for p, s in POSITION_SCHEME.items() if s == scheme]
        part = fn(items.where(F.col("platform").isin(plats)))
        out = part if out is None else out.unionByName(part)
    return out


def rankings(search_pages: DataFrame, products: DataFrame, keyword_of_page: DataFrame, asof,
             target: str | None = None) -> DataFrame:
    """D: search pages (page_id, url, html, platform) + (page_id, keyword_id, page)
    → ranking rows with positions and product ids; appended to ``target`` when given."""
    cards = pg.search_items(search_pages).join(keyword_of_page, "page_id") \
        .withColumn("created_at", lit(asof)) \
        .withColumn("item_id", F.shiftleft(F.col("page_id"), 20) + F.col("ordinal"))  # up to a million cards a page
    ranked = resolve_product(positions(cards), products)
    rows = up.append_rankings(ranked.withColumnRenamed("item_id", "id"))
    if target:
        up.append_to(rows, target, partition_by=["platform"])
    return rows


def dashboard(products: DataFrame, logs: DataFrame, platforms: DataFrame, asof, days: int = 7) -> DataFrame:
    """B: the JSON stats document."""
    return ex.stats_document(stats.overview(products, logs, asof),
                             stats.platform_performance(logs, products, platforms, asof, days),
                             stats.health(products, logs, asof))


def compare_runs(products: DataFrame, rankings_df: DataFrame, run1: str, run2: str) -> dict[str, DataFrame]:
    """C: the run comparison screen as three DataFrames."""
    return {"skus": cp.compare_skus(products, run1, run2),
            "price_changes": cp.price_changes(products, run1, run2),
            "rankings": cp.count_deltas(rankings_df, run1, run2)}
