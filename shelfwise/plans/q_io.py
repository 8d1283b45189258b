"""Catalogue entries for §2.1 sources and sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfwise.operators import pages as pg
from shelfwise.operators import stats
from shelfwise.operators.common import latest
from shelfwise.plans.catalog import query
from shelfwise.sources import export as ex
from shelfwise.sources import tables as tb

PD = ("pd AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY platform, sku "
      "ORDER BY scraped_date DESC NULLS LAST, product_id DESC) AS rn FROM products) x WHERE rn = 1)")
TRIM = "' ' || chr(9) || chr(13) || chr(10)"


@query("src01_read_table", """
SELECT page_id, url, CAST(strlen(html) AS INTEGER) AS html_bytes FROM pages""")
def src01(t):
    df = tb.read_table(t.spark, t.sf_dir, "pages")
    return df.select("page_id", "url", F.octet_length("html").alias("html_bytes"))


@query("src02_read_pages", """
SELECT page_id, regexp_extract(url, '^(https?://[^/?#]+)', 1) AS host FROM pages""")
def src02(t):
    return tb.read_pages(t.spark, t.sf_dir, min_partitions=8).select("page_id", pg.host("url").alias("host"))


@query("src03_import_keywords", f"""
WITH nb AS (SELECT trim(l, {TRIM}) AS line FROM (SELECT unnest(string_split(text, chr(10))) AS l FROM documents) x
  WHERE trim(l, {TRIM}) <> ''),
new AS (SELECT DISTINCT line FROM nb WHERE NOT EXISTS (SELECT 1 FROM keywords k WHERE k.platform = 'amazon' AND k.keyword = nb.line))
SELECT (SELECT count(*) FROM nb) AS lines_read, (SELECT count(*) FROM new) AS created,
 (SELECT count(*) FROM nb) - (SELECT count(*) FROM new) AS skipped""")
def src03(t):
    _, counts = tb.import_keywords(t.documents.select(F.col("text").alias("value")), "amazon", t.keywords)
    return counts


@query("src04_enqueue_urls", """
WITH l AS (SELECT DISTINCT trim(CASE WHEN starts_with(h, 'http') THEN h ELSE regexp_extract(url, '^(https?://[^/?#]+)', 1) || h END,
   ' ' || chr(9) || chr(13) || chr(10)) AS url
  FROM (SELECT url, unnest(regexp_extract_all(html, 'href="([^"]+)"', 1)) AS h FROM pages) x)
SELECT 'amazon' AS platform, url, 'pending' AS status, 5 AS priority, 0 AS retry_count FROM l
WHERE url <> '' AND NOT EXISTS (SELECT 1 FROM scraping_urls s WHERE s.platform = 'amazon' AND s.url = l.url)""")
def src04(t):
    hrefs = F.explode(F.regexp_extract_all("html", F.lit(r'href="([^"]+)"'), 1)).alias("h")
    links = t.pages.select("url", hrefs).select(
        F.when(F.col("h").startswith("http"), F.col("h")).otherwise(F.concat(pg.host("url"), F.col("h"))).alias("url"))
    return tb.enqueue_urls(links, "amazon", 5, t.scraping_urls)


@query("snk01_export_products", """
SELECT product_id AS "ID", platform AS "Platform", sku AS "SKU", title AS "Title", brand AS "Brand", price AS "Price",
 sale_price AS "Sale Price", rating AS "Rating", review_count AS "Reviews Count", include_exclude AS "Include/Exclude",
 scraped_date AS "Last Scraped", CAST(NULL AS TIMESTAMP) AS "Created At"
FROM products WHERE platform = 'amazon' AND include_exclude = 'include'""")
def snk01(t):
    return ex.export_products(t.products, platform="amazon", include_exclude="include")


@query("snk02_export_reviews", f"""
WITH {PD}
SELECT r.id AS "ID", r.platform AS "Platform", coalesce(pd.brand, 'N/A') AS "Brand", coalesce(pd.sku, 'N/A') AS "SKU",
 coalesce(pd.title, 'N/A') AS "Product Title", r.reviewer_name AS "Reviewer Name", r.rating AS "Rating",
 r.review_title AS "Review Title", r.review_text AS "Review Text", CAST(NULL AS DATE) AS "Review Date",
 CASE WHEN coalesce(r.verified_purchase, false) THEN 'Yes' ELSE 'No' END AS "Verified Purchase",
 r.helpful_count AS "Helpful Count",
 CASE WHEN r.review_images IS NOT NULL AND r.review_images NOT IN ('[]', 'null') THEN 'Yes' ELSE 'No' END AS "Has Images",
 CAST(NULL AS TIMESTAMP) AS "Created At"
FROM reviews r LEFT JOIN pd ON r.platform = pd.platform AND r.sku = pd.sku""")
def snk02(t):
    return ex.export_reviews(t.reviews, t.products)


@query("snk03_export_keywords", """
SELECT id AS "ID", platform AS "Platform", keyword AS "Keyword", CASE WHEN status THEN 'Active' ELSE 'Inactive' END AS "Status",
 CAST(NULL AS TIMESTAMP) AS "Created At", CAST(NULL AS TIMESTAMP) AS "Updated At" FROM keywords""")
def snk03(t):
    return ex.export_keywords(t.keywords)


@query("snk04_export_run_products", """
SELECT sku AS "SKU", title AS "Title", brand AS "Brand", price AS "Price", sale_price AS "Sale Price", rating AS "Rating",
 review_count AS "Review Count", product_url AS "URL" FROM products WHERE scraper_id = '0000199601'""")
def snk04(t):
    return ex.export_run("0000199601", "products", products=t.products)


@query("snk04b_export_run_rankings", """
SELECT r.sku AS "SKU", coalesce(k.keyword, 'N/A') AS "Keyword", r.position AS "Position", r.page AS "Page"
FROM rankings r LEFT JOIN keywords k ON r.keyword_id = k.id WHERE r.scraper_id = '0020240110'""")
def snk04b(t):
    return ex.export_run("0020240110", "rankings", rankings=t.rankings, keywords=t.keywords)


@query("snk04c_export_run_reviews", """
SELECT coalesce(p.sku, 'N/A') AS "Product SKU", r.reviewer_name AS "Reviewer", r.rating AS "Rating", r.review_title AS "Title",
 r.review_text AS "Text", CAST(NULL AS DATE) AS "Date", CASE WHEN r.verified_purchase THEN 'Yes' ELSE 'No' END AS "Verified"
FROM reviews r LEFT JOIN (SELECT DISTINCT platform, sku FROM products) p ON r.platform = p.platform AND r.sku = p.sku
WHERE r.scraper_id = '0020240110'""")
def snk04c(t):
    return ex.export_run("0020240110", "reviews", products=t.products, reviews=t.reviews)


@query("snk05_stats_document")
def snk05(t):
    asof = latest(t.scraping_logs, "created_at")
    return ex.stats_document(stats.overview(t.products, t.scraping_logs, asof),
                             stats.platform_performance(t.scraping_logs, t.products, t.platforms, asof, 7),
                             stats.health(t.products, t.scraping_logs, asof))
