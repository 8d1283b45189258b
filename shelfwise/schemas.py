"""Explicit schemas, enumerations and fixed constants.

Every table we write or read back is declared here; nothing is inferred.
"""

from __future__ import annotations

from pyspark.sql import types as T

S, L, I, B = T.StringType(), T.LongType(), T.IntegerType(), T.BooleanType()
# timestamps are wall-clock values (the driver data carries no zone): timestamp_ntz
D, TS = T.DateType(), T.TimestampNTZType()
PRICE = T.DecimalType(10, 2)
RATING = T.DecimalType(3, 2)
PERCENT = T.DecimalType(5, 2)
STRS = T.ArrayType(S)
SMAP = T.MapType(S, S)


def _struct(*fields):
    return T.StructType([T.StructField(n, t, True) for n, t in fields])


# ---- fixed values (must equal the reference's) -------------------------------
# platform code -> display name, in the order the reference configures them
PLATFORMS = [
    ("amazon", "Amazon India"),
    ("flipkart", "Flipkart"),
    ("vijaysales", "VijaySales"),
    ("reliancedigital", "Reliance Digital"),
    ("croma", "Croma"),
    ("blinkit", "Blinkit"),
    ("bigbasket", "Bigbasket"),
    ("meesho", "Meesho"),
]
PLATFORM_CODES = [p for p, _ in PLATFORMS]

LOG_STATUSES = ["started", "completed", "failed", "partial"]
RUN_STATUSES = ["pending", "running", "completed", "failed", "stopped"]
CONFIG_STATUSES = ["active", "inactive", "paused"]
URL_STATUSES = ["pending", "processing", "completed", "failed"]

# price validity window used by the sanitizer (rupees)
PRICE_MIN, PRICE_MAX = 2000, 1600000
# field maxima for truncation: title, description, brand, model / category
MAX_TITLE, MAX_DESCRIPTION, MAX_BRAND, MAX_CATEGORY = 500, 5000, 100, 200  # display limits (STR6)
# CLI storage estimate: bytes per product row and per log row
BYTES_PER_PRODUCT, BYTES_PER_LOG = 2048, 1024
# ---- end of fixed values ----------------------------------------------------

PLATFORM = _struct(("platform", S), ("name", S))

PRODUCTS = _struct(
    ("product_id", S), ("platform", S), ("sku", S), ("title", S), ("description", S), ("brand", S),
    ("manufacturer", S), ("model_name", S), ("color", S), ("category", S), ("currency_code", S),
    ("price", PRICE), ("sale_price", PRICE), ("offers", S), ("inventory_status", S),
    ("rating", RATING),
    ("rating_1_star_percent", PERCENT), ("rating_2_star_percent", PERCENT),
    ("rating_3_star_percent", PERCENT), ("rating_4_star_percent", PERCENT),
    ("rating_5_star_percent", PERCENT),
    ("review_count", I), ("image_urls", STRS), ("video_urls", STRS),
    ("technical_details", SMAP), ("additional_information", SMAP),
    ("seller_name", S), ("product_badge", S), ("amazon_choice", B), ("bestseller", B),
    ("fulfilled_by", B), ("highlights", S), ("customers_say", S), ("delivery_price", S),
    ("delivery_date", S), ("weight", S), ("dimensions", S), ("variants", S), ("product_url", S),
    ("is_active", B), ("include_exclude", S), ("scraped_date", D), ("scraper_id", S),
)

REVIEWS = _struct(
    ("id", L), ("product_id", S), ("platform", S), ("sku", S), ("scraper_id", S), ("review_id", S),
    ("reviewer_name", S), ("reviewer_profile_url", S), ("rating", RATING), ("review_title", S),
    ("review_text", S), ("review_date", D), ("verified_purchase", B), ("helpful_count", I),
    ("review_images", STRS), ("video_urls", STRS), ("variant_info", S), ("review_url", S),
)

KEYWORDS = _struct(("id", L), ("platform", S), ("keyword", S), ("category", S), ("status", B),
                   ("created_at", TS))

RANKINGS = _struct(("id", L), ("product_id", S), ("sku", S), ("keyword_id", L), ("platform", S),
                   ("scraper_id", S), ("position", I), ("page", I), ("created_at", TS))

SCRAPING_URLS = _struct(("id", L), ("platform", S), ("url", S), ("status", S), ("priority", I),
                        ("retry_count", I), ("error_message", S), ("last_scraped_at", TS),
                        ("next_scheduled_run", TS), ("created_at", TS))

ERROR_DETAIL = _struct(("message", S), ("details", S), ("timestamp", TS))

SCRAPING_LOGS = _struct(
    ("id", L), ("platform", S), ("status", S), ("products_found", I), ("products_added", I),
    ("products_updated", I), ("products_deactivated", I), ("errors_count", I), ("error_message", S),
    ("error_details", T.ArrayType(ERROR_DETAIL)), ("started_at", TS), ("completed_at", TS),
    ("duration_seconds", I), ("created_at", TS),
)

SCRAPER_CONFIGURATIONS = _struct(
    ("id", L), ("platform", S), ("category", S), ("tag", S), ("category_url", S), ("status", S),
    ("total_runs", I), ("last_run_at", TS), ("last_scraper_id", S),
)

SCRAPER_RUNS = _struct(
    ("scraper_id", S), ("configuration_id", L), ("platform", S), ("category", S), ("tag", S),
    ("status", S), ("products_scraped", I), ("reviews_scraped", I), ("rankings_scraped", I),
    ("errors_count", I), ("started_at", TS), ("completed_at", TS), ("duration_seconds", I),
    ("created_at", TS),
)

PAGES = _struct(("page_id", L), ("url", S), ("html", S))

SEARCH_ITEMS = _struct(("item_id", L), ("keyword_id", L), ("platform", S), ("page", I),
                       ("ordinal", I), ("sku", S), ("title", S), ("is_sponsored", B),
                       ("created_at", TS))

TABLES = {
    "products": PRODUCTS, "reviews": REVIEWS, "keywords": KEYWORDS, "rankings": RANKINGS,
    "scraping_urls": SCRAPING_URLS, "scraping_logs": SCRAPING_LOGS,
    "scraper_configurations": SCRAPER_CONFIGURATIONS, "scraper_runs": SCRAPER_RUNS,
    "pages": PAGES, "search_items": SEARCH_ITEMS, "platforms": PLATFORM,
}
