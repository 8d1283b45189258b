"""CSV / JSON sinks (SNK1–SNK5).

Each export is a DataFrame with the reference's column headers; ``write_csv``
writes it in parallel (one file per partition, ``maxRecordsPerFile`` in place
of the reference's 100-row chunks).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwise.operators.filters import apply_filters, has_items

# fixed values: export headers
PRODUCT_HEADERS = ["ID", "Platform", "SKU", "Title", "Brand", "Price", "Sale Price", "Rating", "Reviews Count",
                   "Include/Exclude", "Last Scraped", "Created At"]
REVIEW_HEADERS = ["ID", "Platform", "Brand", "SKU", "Product Title", "Reviewer Name", "Rating", "Review Title",
                  "Review Text", "Review Date", "Verified Purchase", "Helpful Count", "Has Images", "Created At"]
KEYWORD_HEADERS = ["ID", "Platform", "Keyword", "Status", "Created At", "Updated At"]
RUN_PRODUCT_HEADERS = ["SKU", "Title", "Brand", "Price", "Sale Price", "Rating", "Review Count", "URL"]
RUN_REVIEW_HEADERS = ["Product SKU", "Reviewer", "Rating", "Title", "Text", "Date", "Verified"]
RUN_RANKING_HEADERS = ["SKU", "Keyword", "Position", "Page"]


def _c(df: DataFrame, name: str, dtype: str = "string"):
    return F.col(name) if name in df.columns else F.lit(None).cast(dtype)


def _yes_no(c):
    return F.when(c, F.lit("Yes")).otherwise(F.lit("No"))


def export_products(products: DataFrame, platform=None, brand=None, include_exclude=None,
                    scrape_date=None) -> DataFrame:
    """SNK1: product export with its 12 fixed headers; blank filters are skipped."""
    df = apply_filters(products, {"platform": platform, "brand": brand, "include_exclude": include_exclude})
    if scrape_date:
        df = df.where(F.to_date("scraped_date") == F.lit(scrape_date).cast("date"))
    vals = [_c(df, "product_id"), _c(df, "platform"), _c(df, "sku"), _c(df, "title"), _c(df, "brand"),
            _c(df, "price", "decimal(10,2)"), _c(df, "sale_price", "decimal(10,2)"), _c(df, "rating", "decimal(3,2)"),
            _c(df, "review_count", "int"), _c(df, "include_exclude"), _c(df, "scraped_date", "date"),
            _c(df, "created_at", "timestamp")]
    return df.select(*[v.alias(h) for v, h in zip(vals, PRODUCT_HEADERS)])


def export_reviews(reviews: DataFrame, products: DataFrame, platform=None, brand=None, sku=None,
                   rating=None) -> DataFrame:
    """SNK2: review export — product columns from a left join ('N/A' when the
    product is unknown), Yes/No flags, Has Images."""
    from shelfwise.operators.joins import product_dim, reviews_of
    r = apply_filters(reviews, {"platform": platform, "rating": rating})
    if brand or sku:
        r = reviews_of(r, products, brand=brand, sku=sku)
    dim = product_dim(products, ["brand", "title"]).select("platform", "sku", F.col("sku").alias("__p_sku"),
                                       F.col("brand").alias("__p_brand"), F.col("title").alias("__p_title"))
    j = r.join(dim, ["platform", "sku"], "left")
    na = lambda c: F.coalesce(F.col(c), F.lit("N/A"))
    vals = [F.col("id"), F.col("platform"), na("__p_brand"), na("__p_sku"), na("__p_title"), _c(j, "reviewer_name"),
            _c(j, "rating", "decimal(3,2)"), _c(j, "review_title"), _c(j, "review_text"), _c(j, "review_date", "date"),
            _yes_no(F.coalesce(_c(j, "verified_purchase", "boolean"), F.lit(False))), _c(j, "helpful_count", "int"),
            _yes_no(has_items(_c(j, "review_images"))), _c(j, "created_at", "timestamp")]
    return j.select(*[v.alias(h) for v, h in zip(vals, REVIEW_HEADERS)])


def export_keywords(keywords: DataFrame, platform=None, status=None) -> DataFrame:
    """SNK3: keyword export with an Active / Inactive label."""
    df = apply_filters(keywords, {"platform": platform})
    if status:
        df = df.where(F.col("status") == F.lit(status == "active"))
    vals = [F.col("id"), F.col("platform"), F.col("keyword"),
            F.when(F.col("status"), "Active").otherwise("Inactive"),
            _c(df, "created_at", "timestamp"), _c(df, "updated_at", "timestamp")]
    return df.select(*[v.alias(h) for v, h in zip(vals, KEYWORD_HEADERS)])


def export_run(run_id: str, kind: str, products: DataFrame | None = None, reviews: DataFrame | None = None,
               rankings: DataFrame | None = None, keywords: DataFrame | None = None) -> DataFrame:
    """SNK4: one run's rows in one of three shapes: products, reviews (with the
    product sku, 'N/A' when unknown) or rankings (with the keyword, 'N/A')."""
    if kind == "products":
        df = products.where(F.col("scraper_id") == run_id)
        vals = [F.col("sku"), F.col("title"), F.col("brand"), F.col("price"), F.col("sale_price"), F.col("rating"),
                F.col("review_count"), _c(df, "product_url")]
        return df.select(*[v.alias(h) for v, h in zip(vals, RUN_PRODUCT_HEADERS)])
    if kind == "reviews":
        from shelfwise.operators.joins import product_dim
        r = reviews.where(F.col("scraper_id") == run_id)
        dim = product_dim(products, []).select("platform", "sku", F.col("sku").alias("__p_sku"))
        j = r.join(dim, ["platform", "sku"], "left")
        vals = [F.coalesce("__p_sku", F.lit("N/A")), F.col("reviewer_name"), F.col("rating"), F.col("review_title"),
                F.col("review_text"), _c(j, "review_date", "date"), _yes_no(F.coalesce("verified_purchase", F.lit(False)))]
        return j.select(*[v.alias(h) for v, h in zip(vals, RUN_REVIEW_HEADERS)])
    if kind == "rankings":
        r = rankings.where(F.col("scraper_id") == run_id)
        k = keywords.select(F.col("id").alias("keyword_id"), "keyword")
        j = r.join(k, "keyword_id", "left")
        vals = [F.col("sku"), F.coalesce("keyword", F.lit("N/A")), F.col("position"), F.col("page")]
        return j.select(*[v.alias(h) for v, h in zip(vals, RUN_RANKING_HEADERS)])
    raise ValueError(f"unknown export kind {kind!r}")


def write_csv(df: DataFrame, path: str, max_records_per_file: int | None = None) -> None:
    """Write an export as headed CSV files (parallel, one per partition)."""
    w = df.write.mode("overwrite").option("header", True)
    if max_records_per_file:
        w = w.option("maxRecordsPerFile", max_records_per_file)
    w.csv(path)


def stats_document(overview: DataFrame, performance: DataFrame, health: DataFrame) -> DataFrame:
    """SNK5: one JSON document {overview, platformPerformance, systemHealth}.

    The per-platform part is collected from the platform aggregate, which has
    one row per configured platform (8), so the document stays small.
    """
    perf = performance.agg(F.sort_array(F.collect_list(F.struct(*performance.columns))).alias("p"))
    doc = overview.select(F.struct(*overview.columns).alias("overview")).select(
        "overview", perf.select("p").scalar().alias("platformPerformance"),
        health.select(F.struct(*health.columns)).scalar().alias("systemHealth"))
    return doc.select(F.to_json(F.struct("overview", "platformPerformance", "systemHealth")).alias("document"))


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)
