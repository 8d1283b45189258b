"""Catalogue entries for §2.3 joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfwise.operators import joins as jn
from shelfwise.plans.catalog import query

# latest snapshot per (platform, sku) — the product dimension used by the joins
PD = """pd AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY platform, sku
  ORDER BY scraped_date DESC NULLS LAST, product_id DESC) AS rn FROM products) x WHERE rn = 1)"""


@query("joi01_with_product", f"""
WITH {PD}
SELECT r.id, r.platform, r.sku, pd.product_id, pd.title AS product_title, pd.brand AS product_brand,
 pd.price AS product_price
FROM reviews r LEFT JOIN pd ON r.platform = pd.platform AND r.sku = pd.sku""")
def joi01(t):
    return jn.with_product(t.reviews, t.products).select(
        "id", "platform", "sku", "product_id", "product_title", "product_brand", "product_price")


@query("joi02_rankings_with_product", f"""
WITH {PD}, rk AS (SELECT r.id, r.keyword_id, r.position, pd.product_id FROM rankings r
  LEFT JOIN pd ON r.platform = pd.platform AND r.sku = pd.sku)
SELECT rk.id, rk.keyword_id, rk.position, rk.product_id, pd.title AS product_title, pd.brand AS product_brand,
 pd.price AS product_price FROM rk LEFT JOIN pd ON rk.product_id = pd.product_id""")
def joi02(t):
    rk = jn.resolve_product(t.rankings, t.products).select("id", "keyword_id", "position", "product_id")
    return jn.rankings_with_product(rk, t.products).select(
        "id", "keyword_id", "position", "product_id", "product_title", "product_brand", "product_price")


@query("joi03_rankings_with_keyword", """
SELECT r.id, r.keyword_id, r.position, k.keyword, k.status AS keyword_status
FROM rankings r LEFT JOIN keywords k ON r.keyword_id = k.id""")
def joi03(t):
    return jn.rankings_with_keyword(t.rankings, t.keywords).select(
        "id", "keyword_id", "position", "keyword", "keyword_status")


@query("joi04_reviews_of_brand", """
SELECT r.id, r.platform, r.sku FROM reviews r WHERE EXISTS (
 SELECT 1 FROM products p WHERE p.platform = r.platform AND p.sku = r.sku AND p.brand = 'Brand#13')""")
def joi04(t):
    return jn.reviews_of(t.reviews, t.products, brand="Brand#13").select("id", "platform", "sku")


@query("joi05_config_products", """
SELECT c.id AS configuration_id, c.platform AS config_platform, c.category AS config_category, r.scraper_id,
 p.product_id, p.sku, p.platform, p.price
FROM scraper_configurations c JOIN scraper_runs r ON r.configuration_id = c.id JOIN products p ON lpad(substr(p.sku, 4), 10, '0') = r.scraper_id""")
def joi05(t):
    # a product belongs to the run that has the number of its sku
    return jn.config_products(t.scraper_configurations, t.scraper_runs, t.products.withColumn("scraper_id", F.expr("lpad(substr(sku, 4), 10, '0')")))


@query("joi06_backfill", """
SELECT r.id, r.keyword_id, CASE WHEN k.id IS NOT NULL THEN k.platform ELSE r.platform END AS platform
FROM rankings r LEFT JOIN keywords k ON r.keyword_id = k.id""")
def joi06(t):
    return jn.backfill(t.rankings.select("id", "keyword_id", "platform"), t.keywords, "keyword_id", "id",
                       ["platform"], only_null=False)


@query("joi06b_backfill_reviews", """
WITH r AS (SELECT id, concat(platform, '|', sku) AS product_key, CASE WHEN id % 3 = 0 THEN NULL ELSE platform END AS platform,
  CASE WHEN id % 4 = 0 THEN NULL ELSE sku END AS sku FROM reviews),
p AS (SELECT DISTINCT concat(platform, '|', sku) AS product_key, platform, sku FROM products)
SELECT r.id, r.product_key, coalesce(r.platform, p.platform) AS platform, coalesce(r.sku, p.sku) AS sku
FROM r LEFT JOIN p ON r.product_key = p.product_key""")
def joi06b(t):
    key = F.concat_ws("|", "platform", "sku").alias("product_key")
    unset = lambda c, n: F.when(F.col("id") % n != 0, F.col(c)).alias(c)
    reviews = t.reviews.select("id", key, unset("platform", 3), unset("sku", 4))
    products = t.products.select(key, "platform", "sku").distinct()
    return jn.backfill(reviews, products, "product_key", "product_key", ["platform", "sku"])


@query("joi07_only_new", """
SELECT DISTINCT platform, sku FROM reviews r WHERE NOT EXISTS (
 SELECT 1 FROM products p WHERE p.platform = r.platform AND p.sku = r.sku)""")
def joi07(t):
    return jn.only_new(t.reviews.select("platform", "sku"), t.products, ["platform", "sku"])


@query("joi08_price_pairs", """
WITH a AS (SELECT sku, title, price FROM (SELECT *, row_number() OVER (PARTITION BY sku ORDER BY product_id) AS rn
  FROM products WHERE scraper_id = '0000199601') x WHERE rn = 1),
b AS (SELECT sku, price FROM (SELECT *, row_number() OVER (PARTITION BY sku ORDER BY product_id) AS rn
  FROM products WHERE scraper_id = '0000199602') x WHERE rn = 1)
SELECT a.sku, a.title, a.price AS price_run1, b.price AS price_run2 FROM a JOIN b ON a.sku = b.sku""")
def joi08(t):
    return jn.price_pairs(t.products, "0000199601", "0000199602")


@query("joi09_per_platform", """
SELECT p.platform, p.name, coalesce(r.n, 0) AS top_rated_reviews FROM platforms p
LEFT JOIN (SELECT platform, count(*) AS n FROM reviews WHERE rating >= 4.5 GROUP BY platform) r ON p.platform = r.platform""")
def joi09(t):
    counts = (t.reviews.where(F.col("rating") >= 4.5).groupBy("platform")
              .agg(F.count(F.lit(1)).alias("top_rated_reviews")))
    return jn.per_platform(counts, t.platforms, ["top_rated_reviews"])


@query("joi10_with_last_run", """
SELECT c.id, c.platform, c.category, r.scraper_id AS last_scraper_id, r.status AS last_status,
 r.created_at AS last_created_at
FROM scraper_configurations c LEFT JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY configuration_id
  ORDER BY created_at DESC, scraper_id DESC) AS rn FROM scraper_runs) x WHERE rn = 1) r ON r.configuration_id = c.id""")
def joi10(t):
    return jn.with_last_run(t.scraper_configurations, t.scraper_runs)


@query("joi11_resolve_product", f"""
WITH {PD}
SELECT r.id, r.platform, r.sku, pd.product_id FROM rankings r LEFT JOIN pd ON r.platform = pd.platform AND r.sku = pd.sku""")
def joi11(t):
    return jn.resolve_product(t.rankings.select("id", "platform", "sku"), t.products).select(
        "id", "platform", "sku", "product_id")
