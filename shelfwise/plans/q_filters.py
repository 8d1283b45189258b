"""Catalogue entries for §2.2 filters and predicates."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfwise.operators import filters as fl
from shelfwise.operators.common import latest
from shelfwise.plans.catalog import query

LOG_ASOF = "(SELECT max(created_at) FROM scraping_logs)"


@query("fil01_apply_filters", """
SELECT * FROM scraper_runs WHERE platform = 'amazon' AND status = 'completed'""")
def fil01(t):
    return fl.apply_filters(t.scraper_runs, {"platform": "amazon", "status": "completed", "tag": ""})


@query("fil02_search", """
SELECT product_id, platform, sku, title, brand FROM products
WHERE title ILIKE '%red%' OR brand ILIKE '%red%'""")
def fil02(t):
    return fl.search(t.products, ["title", "brand"], "red").select("product_id", "platform", "sku", "title", "brand")


@query("fil03_contains", """
SELECT scraper_id, category FROM scraper_runs WHERE category ILIKE '%urgent%'""")
def fil03(t):
    return fl.contains(t.scraper_runs, "category", "urgent").select("scraper_id", "category")


@query("fil04_date_between", """
SELECT scraper_id, created_at FROM scraper_runs
WHERE CAST(created_at AS DATE) >= DATE '1996-01-01' AND CAST(created_at AS DATE) <= DATE '1996-03-31'""")
def fil04(t):
    return fl.date_between(t.scraper_runs, "created_at", "1996-01-01", "1996-03-31").select("scraper_id", "created_at")


@query("fil05_date_range", """
SELECT id, created_at FROM scraping_logs
WHERE created_at BETWEEN TIMESTAMP '1997-06-01 00:00:00' AND TIMESTAMP '1997-06-30 00:00:00'""")
def fil05(t):
    import datetime as dt
    return fl.date_range(t.scraping_logs, "created_at", dt.datetime(1997, 6, 1), dt.datetime(1997, 6, 30)) \
        .select("id", "created_at")


@query("fil06_recent", f"""
SELECT id, platform, status, created_at FROM scraping_logs WHERE created_at >= {LOG_ASOF} - INTERVAL 30 DAY""")
def fil06(t):
    return fl.recent(t.scraping_logs, "created_at", latest(t.scraping_logs, "created_at"), 30) \
        .select("id", "platform", "status", "created_at")


@query("fil07_has_items", """
SELECT id, review_images FROM reviews WHERE review_images IS NOT NULL AND review_images NOT IN ('[]', 'null')""")
def fil07(t):
    return t.reviews.where(fl.has_items("review_images")).select("id", "review_images")


@query("fil07b_has_no_items", """
SELECT id, review_images FROM reviews WHERE review_images IS NULL OR review_images IN ('[]', 'null')""")
def fil07b(t):
    return t.reviews.where(fl.has_no_items("review_images")).select("id", "review_images")


@query("fil08_sentiment_neutral", """
SELECT id, rating FROM reviews WHERE rating BETWEEN 2.1 AND 3.9""")
def fil08(t):
    return fl.sentiment_filter(t.reviews, "neutral").select("id", "rating")


@query("fil08b_sentiment_critical", """
SELECT id, rating FROM reviews WHERE rating <= 2""")
def fil08b(t):
    return fl.sentiment_filter(t.reviews, "critical").select("id", "rating")


@query("fil08c_sentiment_positive", """
SELECT id, rating FROM reviews WHERE rating >= 4""")
def fil08c(t):
    return fl.sentiment_filter(t.reviews, "positive").select("id", "rating")


@query("fil09_curated", """
SELECT product_id, include_exclude FROM products WHERE include_exclude = 'include'""")
def fil09(t):
    return fl.curated(t.products).select("product_id", "include_exclude")


@query("fil10_incomplete_products", """
SELECT product_id, platform FROM products
WHERE (price IS NULL OR brand IS NULL OR title IS NULL OR title = '' OR review_count % 5 = 0) AND is_active""")
def fil10(t):
    # an empty description on a fifth of the products, none on another fifth
    left = F.col("review_count") % 5
    p = t.products.withColumn("description", F.when(left == 0, "").when(left > 1, F.col("title")))
    return fl.incomplete_products(p).select("product_id", "platform")


@query("fil11_scopes", """
SELECT product_id FROM products WHERE is_active AND platform = 'flipkart'""")
def fil11(t):
    return fl.on_platform(fl.active(t.products), "flipkart").select("product_id")


@query("fil12_by_ids", """
SELECT id, platform FROM reviews WHERE id IN (SELECT doc_id FROM labels WHERE toxic = 1)""")
def fil12(t):
    ids = t.labels.where(F.col("toxic") == 1).select(F.col("doc_id").alias("id"))
    return fl.by_ids(t.reviews, ids).select("id", "platform")


@query("fil13_validity", """
SELECT product_id, coalesce(regexp_matches(sku, '^[A-Z0-9\\-_]{3,50}$', 'i'), false) AS sku_ok,
 coalesce(CAST(price AS DOUBLE) BETWEEN 2000 AND 1600000, false) AS price_ok,
 coalesce(CAST(rating AS DOUBLE) BETWEEN 0 AND 5, false) AS rating_ok
FROM products""")
def fil13(t):
    return t.products.select("product_id", fl.valid_sku("sku").alias("sku_ok"),
                             fl.valid_price(F.col("price")).alias("price_ok"),
                             fl.valid_rating(F.col("rating")).alias("rating_ok"))


# products of which some lack a sku, a title or a platform, at prices on both sides of the least one
_LACKING = """(SELECT product_id, CASE WHEN review_count % 11 = 0 THEN '' WHEN review_count % 11 = 1 THEN NULL ELSE sku END AS sku,
  CASE WHEN review_count % 13 = 0 THEN '0' ELSE title END AS title, CASE WHEN review_count % 17 = 0 THEN NULL ELSE platform END AS platform, price / 10 AS price FROM products) p"""


def _lacking(t):
    left = lambda n: F.col("review_count") % n
    return t.products.select("product_id", F.when(left(11) == 0, "").when(left(11) > 1, F.col("sku")).alias("sku"), F.when(left(13) == 0, "0").otherwise(F.col("title")).alias("title"),
                             F.when(left(17) != 0, F.col("platform")).alias("platform"), (F.col("price") / 10).alias("price"))


@query("fil14_validate_products", f"""
SELECT product_id, CASE WHEN price IS NOT NULL AND NOT (price BETWEEN 2000 AND 1600000) THEN 'price out of range' END AS warning
FROM {_LACKING} WHERE NOT (sku IS NULL OR sku IN ('', '0') OR title IS NULL OR title IN ('', '0') OR platform IS NULL OR platform IN ('', '0'))""")
def fil14(t):
    good, _ = fl.validate_products(_lacking(t))
    return good.select("product_id", "warning")


@query("fil14b_rejected_products", f"""
SELECT product_id FROM {_LACKING} WHERE sku IS NULL OR sku IN ('', '0') OR title IS NULL OR title IN ('', '0') OR platform IS NULL OR platform IN ('', '0')""")
def fil14b(t):
    _, bad = fl.validate_products(_lacking(t))
    return bad.select("product_id")


def _has(c: str) -> str:
    return f"({c} IS NOT NULL AND CAST({c} AS VARCHAR) NOT IN ('', '0'))"


_RATED = "(rating IS NOT NULL AND rating <> 0)"


@query("fil15_accept_reviews", f"""
SELECT id, platform FROM reviews WHERE coalesce(CASE
 WHEN platform = 'amazon' THEN {_has('review_id')}
 WHEN platform = 'flipkart' THEN {_has('review_id')} OR {_has('review_text')}
 WHEN platform = 'meesho' THEN {_has('reviewer_name')} AND {_RATED} AND {_has('review_text')}
 WHEN platform IN ('croma', 'reliancedigital', 'bigbasket') THEN {_has('review_text')} OR {_RATED}
 ELSE {_has('review_text')} END, false)""")
def fil15(t):
    return fl.accept_reviews(t.reviews).select("id", "platform")


@query("fil16_reviewable", """
SELECT product_id, sku FROM products WHERE platform = 'croma' AND is_active AND product_url IS NOT NULL AND sku IS NOT NULL""")
def fil16(t):
    return fl.reviewable(t.products, "croma").select("product_id", "sku")


@query("fil17_rankable", """
SELECT id, keyword FROM keywords WHERE platform = 'amazon' AND status""")
def fil17(t):
    return fl.rankable(t.keywords, "amazon").select("id", "keyword")


@query("fil18_usable_pages", """
SELECT page_id FROM pages WHERE strlen(html) >= 1000 AND NOT (
 contains(lower(html), 'ap_signin_form') OR contains(lower(html), 'sign-in') OR contains(lower(html), 'sign in to continue')
 OR contains(lower(html), 'enter your email or mobile phone number') OR contains(lower(html), 'ap_email')
 OR contains(lower(html), 'ap_password'))""")
def fil18(t):
    return fl.usable_pages(t.pages).select("page_id")


@query("fil18b_usable_pages_by_platform", """
SELECT page_id, platform FROM (SELECT p.page_id, p.html, u.platform FROM pages p JOIN scraping_urls u ON p.page_id = u.id) x
WHERE strlen(html) >= CASE WHEN platform = 'reliancedigital' THEN 5001 ELSE 1000 END AND NOT (
 contains(lower(html), 'ap_signin_form') OR contains(lower(html), 'sign-in') OR contains(lower(html), 'sign in to continue')
 OR contains(lower(html), 'enter your email or mobile phone number') OR contains(lower(html), 'ap_email')
 OR contains(lower(html), 'ap_password'))""")
def fil18b(t):
    from shelfwise.sources.views import _PLATFORM_OF
    pages = t.pages.select("page_id", "html", F.expr(_PLATFORM_OF.format(k="page_id")).alias("platform"))
    return fl.usable_pages(pages, platform="platform").select("page_id", "platform")
