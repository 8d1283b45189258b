"""Joins (§2.3).  All equi-joins.

Join strategy is left to Catalyst + AQE: a side is broadcast only when its
measured size is under ``spark.sql.autoBroadcastJoinThreshold`` (planner
statistics, then runtime shuffle statistics under AQE), otherwise the join is
sort-merge and AQE splits skewed partitions.  Explicit ``broadcast`` hints are
used only for tables with a fixed size (the 8-row platform dimension).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwise.operators.ranking import latest_per_key


def product_dim(products: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """One row per (platform, sku): the latest snapshot (ties: highest product_id).

    ``cols`` limits the carried columns (product_id is always kept).
    """
    keep = None if cols is None else ["product_id"] + [c for c in cols if c != "product_id"]
    return latest_per_key(products, ["platform", "sku"], ["scraped_date", "product_id"], keep)


def with_product(reviews: DataFrame, products: DataFrame,
                 cols=("product_id", "title", "brand", "price")) -> DataFrame:
    """JOI1: review ⟕ product on (platform, sku); product columns null when unknown."""
    dim = product_dim(products, list(cols)).select(
        "platform", "sku", *[F.col(c).alias(f"product_{c}") if c != "product_id" else F.col(c) for c in cols])
    return reviews.drop(*[c for c in ("product_id",) if c in reviews.columns]).join(dim, ["platform", "sku"], "left")


def resolve_product(rankings: DataFrame, products: DataFrame) -> DataFrame:
    """JOI11: attach product_id by (platform, sku); null when the product is unknown."""
    dim = product_dim(products, ["product_id"]).select("platform", "sku", "product_id")
    base = rankings.drop("product_id") if "product_id" in rankings.columns else rankings
    return base.join(dim, ["platform", "sku"], "left")


def rankings_with_product(rankings: DataFrame, products: DataFrame) -> DataFrame:
    """JOI2: ranking ⟕ product on product_id (nullable) for title / brand / price."""
    dim = product_dim(products, ["title", "brand", "price"]).select("product_id", F.col("title").alias("product_title"),
                                       F.col("brand").alias("product_brand"),
                                       F.col("price").alias("product_price"))
    return rankings.join(dim, "product_id", "left")


def rankings_with_keyword(rankings: DataFrame, keywords: DataFrame) -> DataFrame:
    """JOI3: ranking ⟕ keyword on keyword_id."""
    k = keywords.select(F.col("id").alias("keyword_id"), "keyword", F.col("status").alias("keyword_status"))
    return rankings.join(k, "keyword_id", "left")


def reviews_of(reviews: DataFrame, products: DataFrame, brand: str | None = None,
               sku: str | None = None) -> DataFrame:
    """JOI4: reviews whose product has the given brand / sku (EXISTS → semi join)."""
    p = products
    if brand is not None:
        p = p.where(F.col("brand") == brand)
    if sku is not None:
        p = p.where(F.col("sku") == sku)
    return reviews.join(p.select("platform", "sku"), ["platform", "sku"], "left_semi")


def config_products(configs: DataFrame, runs: DataFrame, products: DataFrame) -> DataFrame:
    """JOI5: configuration → runs → products through scraper_id."""
    cr = configs.select(F.col("id").alias("configuration_id"), F.col("platform").alias("config_platform"),
                        F.col("category").alias("config_category")) \
        .join(runs.select("configuration_id", "scraper_id"), "configuration_id")
    return cr.join(products.select("scraper_id", "product_id", "sku", "platform", "price"), "scraper_id")


def backfill(child: DataFrame, parent: DataFrame, child_key: str, parent_key: str,
             cols: list[str], only_null: bool = True) -> DataFrame:
    """JOI6: copy ``cols`` from parent into child by key (a left join, so
    unmatched child rows keep their values).  ``only_null`` fills only nulls."""
    p = parent.select(F.col(parent_key).alias("__k"), *[F.col(c).alias(f"__p_{c}") for c in cols])
    j = child.join(p, F.col(child_key) == F.col("__k"), "left")
    for c in cols:
        new = (F.coalesce(F.col(c), F.col(f"__p_{c}")) if only_null
               else F.when(F.col("__k").isNotNull(), F.col(f"__p_{c}")).otherwise(F.col(c)))
        j = j.withColumn(c, new)
    return j.drop("__k", *[f"__p_{c}" for c in cols])


def only_new(new: DataFrame, existing: DataFrame, keys: list[str]) -> DataFrame:
    """JOI7: insert-if-absent — distinct candidates whose key is not present yet."""
    return new.dropDuplicates(keys).join(existing.select(*keys), keys, "left_anti")


def first_per_sku_in_run(products: DataFrame, run_id: str) -> DataFrame:
    """First row (lowest product_id) of each sku within one run."""
    from shelfwise.operators.ranking import first_per_key
    return first_per_key(products.where(F.col("scraper_id") == run_id), ["sku"], "product_id")


def price_pairs(products: DataFrame, run1: str, run2: str) -> DataFrame:
    """JOI8: same-SKU pairs of two runs (first row per sku on each side)."""
    a = first_per_sku_in_run(products, run1).select("sku", "title", F.col("price").alias("price_run1"))
    b = first_per_sku_in_run(products, run2).select("sku", F.col("price").alias("price_run2"))
    return a.join(b, "sku")


def per_platform(df: DataFrame, platforms: DataFrame, value_cols: list[str]) -> DataFrame:
    """JOI9: every configured platform, zero-filled where ``df`` has no row."""
    out = F.broadcast(platforms).join(df, "platform", "left")
    return out.select("platform", "name", *[F.coalesce(F.col(c), F.lit(0)).cast("bigint").alias(c)
                                             for c in value_cols])


def with_last_run(configs: DataFrame, runs: DataFrame) -> DataFrame:
    """JOI10: latest run (created_at, then scraper_id) attached to each configuration.

    ``max_by`` is a partial aggregate: a configuration with millions of runs is
    reduced map-side instead of being sorted in one task.
    """
    last = runs.groupBy(F.col("configuration_id").alias("id")).agg(
        F.max_by(F.struct("scraper_id", "status", "created_at"),
                 F.struct("created_at", "scraper_id")).alias("r"))
    return configs.join(last, "id", "left").select(
        "id", "platform", "category", F.col("r.scraper_id").alias("last_scraper_id"),
        F.col("r.status").alias("last_status"), F.col("r.created_at").alias("last_created_at"))

