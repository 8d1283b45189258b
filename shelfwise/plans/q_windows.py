"""Catalogue entries for §2.5 windows / top-k / latest-per-key and §2.6 ordering."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfwise.operators import ordering as od
from shelfwise.operators import ranking as rk
from shelfwise.operators.common import latest
from shelfwise.plans.catalog import query

ITEM_COLS = ["item_id", "keyword_id", "platform", "search_date", "sku", "page", "is_sponsored", "created_at"]


@query("win01_current_snapshot", """
SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY platform, sku
  ORDER BY scraped_date DESC NULLS LAST, product_id DESC) AS rn FROM products
  WHERE scraped_date IS NULL OR scraped_date >= (SELECT max(scraped_date) FROM products) - INTERVAL 2 DAY) x WHERE rn = 1""")
def win01(t):
    return rk.current_snapshot(t.products, latest(t.products, "scraped_date"), 2)


@query("win02_latest_ranking", """
SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY keyword_id, sku ORDER BY created_at DESC, id DESC) AS rn
  FROM rankings) x WHERE rn = 1""")
def win02(t):
    return rk.latest_ranking(t.rankings)


@query("win03_ranking_history", """
SELECT * FROM rankings WHERE created_at >= (SELECT max(created_at) FROM rankings) - INTERVAL 30 DAY""")
def win03(t):
    return rk.ranking_history(t.rankings, latest(t.rankings, "created_at"), 30)


@query("win04_organic_position", """
SELECT *, CAST(row_number() OVER (PARTITION BY keyword_id ORDER BY page, created_at, item_id) AS INT) AS position
FROM search_items WHERE NOT is_sponsored""")
def win04(t):
    return rk.organic_position(t.search_items.select(*ITEM_COLS))


@query("win05_slot_position", """
SELECT * EXCLUDE (ordinal) FROM (SELECT *, CAST((page - 1) * 24 + row_number() OVER (PARTITION BY keyword_id, page
  ORDER BY created_at, item_id) AS INT) AS position, 0 AS ordinal
  FROM search_items WHERE platform IN ('reliancedigital', 'bigbasket')) x WHERE NOT is_sponsored""")
def win05(t):
    items = t.search_items.select(*ITEM_COLS).where(F.col("platform").isin("reliancedigital", "bigbasket"))
    return rk.slot_position(items, 24)


@query("win06_organic_slot_position", """
SELECT * FROM (SELECT *, CAST((page - 1) * 24 + row_number() OVER (PARTITION BY keyword_id, page
  ORDER BY created_at, item_id) AS INT) AS position
  FROM search_items WHERE platform = 'croma' AND NOT is_sponsored) x WHERE sku IS NOT NULL""")
def win06(t):
    items = t.search_items.select(*ITEM_COLS).where(F.col("platform") == "croma")
    return rk.organic_slot_position(items, 24)


@query("win07_kept_base_position", """
WITH it AS (SELECT * FROM search_items WHERE platform = 'vijaysales'),
k AS (SELECT keyword_id, page, count(*) FILTER (WHERE NOT is_sponsored) AS kept FROM it GROUP BY keyword_id, page),
b AS (SELECT keyword_id, page, coalesce(sum(kept) OVER (PARTITION BY keyword_id ORDER BY page
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS base FROM k),
n AS (SELECT it.*, row_number() OVER (PARTITION BY keyword_id, page ORDER BY created_at, item_id) AS ordinal FROM it)
SELECT n.* EXCLUDE (ordinal), CAST(b.base + n.ordinal AS INT) AS position
FROM n JOIN b ON n.keyword_id = b.keyword_id AND n.page = b.page WHERE NOT n.is_sponsored""")
def win07(t):
    items = t.search_items.select(*ITEM_COLS).where(F.col("platform") == "vijaysales")
    return rk.kept_base_position(items)


@query("win08_last_runs", """
SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY configuration_id ORDER BY created_at DESC, scraper_id DESC) AS INTEGER) AS run_rank
  FROM scraper_runs) x WHERE run_rank <= 10""")
def win08(t):
    return rk.last_runs(t.scraper_runs, 10)


@query("win08b_last_runs_overall", """
SELECT * FROM scraper_runs ORDER BY created_at DESC, scraper_id DESC LIMIT 20""")
def win08b(t):
    return rk.last_runs(t.scraper_runs, 20, per_config=False)


@query("win09_platform_last_next", """
WITH l AS (SELECT platform, scraper_id AS last_completed_run, created_at AS last_completed_at FROM (
  SELECT *, row_number() OVER (PARTITION BY platform ORDER BY created_at DESC, scraper_id DESC) AS rn
  FROM scraper_runs WHERE status = 'completed') x WHERE rn = 1),
n AS (SELECT platform, id AS next_url_id FROM (SELECT *, row_number() OVER (PARTITION BY platform ORDER BY priority DESC, id) AS rn
  FROM scraping_urls WHERE status = 'pending') x WHERE rn = 1)
SELECT coalesce(l.platform, n.platform) AS platform, l.last_completed_run, l.last_completed_at, n.next_url_id
FROM l FULL JOIN n ON l.platform = n.platform""")
def win09(t):
    return rk.platform_last_next(t.scraper_runs, t.scraping_urls)


# runs with an end, urls with a schedule (some without)
@query("win09b_platform_scheduled_next", """
WITH r AS (SELECT *, created_at + to_seconds(CAST(duration_seconds AS BIGINT)) AS completed_at FROM scraper_runs),
l AS (SELECT platform, scraper_id AS last_completed_run, completed_at AS last_completed_at FROM (
  SELECT *, row_number() OVER (PARTITION BY platform ORDER BY completed_at DESC, scraper_id DESC) AS rn FROM r WHERE status = 'completed') x WHERE rn = 1),
u AS (SELECT *, CASE WHEN retry_count > 0 THEN TIMESTAMP '2024-01-01' + to_hours(CAST(id * 37 % 1000 AS BIGINT)) END AS next_scheduled_run FROM scraping_urls),
n AS (SELECT platform, id AS next_url_id FROM (SELECT *, row_number() OVER (PARTITION BY platform ORDER BY next_scheduled_run, id) AS rn
  FROM u WHERE next_scheduled_run IS NOT NULL) x WHERE rn = 1)
SELECT coalesce(l.platform, n.platform) AS platform, l.last_completed_run, l.last_completed_at, n.next_url_id FROM l FULL JOIN n ON l.platform = n.platform""")
def win09b(t):
    runs = t.scraper_runs.withColumn("completed_at", F.expr("timestampadd(SECOND, duration_seconds, created_at)"))
    urls = t.scraping_urls.withColumn("next_scheduled_run", F.when(F.col("retry_count") > 0, F.expr("timestampadd(HOUR, CAST(id * 37 % 1000 AS INT), TIMESTAMP_NTZ'2024-01-01')")))
    return rk.platform_last_next(runs, urls)


@query("win10_first_per_sku", """
SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY sku ORDER BY product_id) AS rn FROM products) x WHERE rn = 1""")
def win10(t):
    return rk.first_per_sku(t.products)


@query("win11_pending_queue", """
SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY platform ORDER BY priority DESC, id) AS INTEGER) AS queue_rank
  FROM scraping_urls WHERE status = 'pending') x WHERE queue_rank <= 10""")
def win11(t):
    return rk.pending_queue(t.scraping_urls, 10)


@query("win12_page_cutoff", """
WITH g AS (SELECT *, CASE WHEN organic_items >= 10 THEN 1 ELSE 0 END AS good FROM search_pages),
s1 AS (SELECT *, sum(good) OVER (PARTITION BY keyword_id ORDER BY page ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS grp FROM g),
s2 AS (SELECT *, sum(1 - good) OVER (PARTITION BY keyword_id, grp ORDER BY page ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS streak FROM s1),
s3 AS (SELECT *, min(CASE WHEN streak >= 2 THEN page - 1 END) OVER (PARTITION BY keyword_id) AS cut FROM s2)
SELECT keyword_id, page, organic_items FROM s3 WHERE cut IS NULL OR page < cut""")
def win12(t):
    return rk.page_cutoff(t.search_pages, "keyword_id", 2, F.col("organic_items") >= 10)


@query("win13_retry_outcome", """
SELECT page_key, count(*) FILTER (WHERE attempt <= 3 AND attempt <= coalesce(first_ok, attempt)) AS attempts_used,
 min(CASE WHEN rows_found > 0 AND attempt <= 3 THEN attempt END) AS recovered_at,
 min(CASE WHEN rows_found > 0 AND attempt <= 3 THEN attempt END) IS NOT NULL AS recovered
FROM (SELECT *, min(CASE WHEN rows_found > 0 AND attempt <= 3 THEN attempt END) OVER (PARTITION BY page_key) AS first_ok
  FROM page_attempts) a GROUP BY page_key""")
def win13(t):
    return rk.retry_outcome(t.page_attempts, "page_key", 3)


# attempts minutes apart: every event of a platform's users
_COOLDOWN_SQL = """
WITH RECURSIVE a AS (SELECT DISTINCT platform, created_at AS x FROM search_items),
acc(platform, ts) AS (
 SELECT platform, min(x) FROM a GROUP BY platform
 UNION ALL
 SELECT c.platform, (SELECT min(a.x) FROM a WHERE a.platform = c.platform AND a.x >= c.ts + INTERVAL 12 HOUR) FROM acc c WHERE c.ts IS NOT NULL)
SELECT platform, ts AS created_at FROM acc WHERE ts IS NOT NULL"""


@query("win14_cooldown", _COOLDOWN_SQL)
def win14(t):
    return rk.cooldown(t.search_items.select("platform", "created_at"), "created_at", "platform", 12)


@query("srt01_order_by", """
SELECT product_id, price FROM products ORDER BY price DESC, product_id""")
def srt01(t):
    return od.order_by(t.products.select("product_id", "price"), "price", "desc",
                       allowed=["price", "title", "scraped_date"], tie_break="product_id")


@query("srt02_page", """
SELECT product_id, sku, price, (SELECT count(*) FROM products) AS total_rows FROM products
ORDER BY price DESC NULLS LAST, product_id LIMIT 20 OFFSET 40""")
def srt02(t):
    df = t.products.select("product_id", "sku", "price")
    return od.page(df, [F.col("price").desc_nulls_last(), "product_id"], 20, 3)


@query("srt03_sample_n", """
SELECT product_id, sku, price FROM products WHERE scraper_id = '0000199601' ORDER BY product_id LIMIT 10""")
def srt03(t):
    df = t.products.where(F.col("scraper_id") == "0000199601").select("product_id", "sku", "price")
    return od.sample_n(df, 10, "product_id")


@query("srt04_keyword_list", """
SELECT id, platform, keyword FROM keywords ORDER BY platform, keyword""")
def srt04(t):
    return od.keyword_list(t.keywords.select("id", "platform", "keyword"))


@query("srt05_runs_by_category", """
SELECT r.category, c.category_runs, r.scraper_id, r.platform, r.status, r.created_at FROM scraper_runs r
JOIN (SELECT category, count(*) AS category_runs FROM scraper_runs GROUP BY category) c ON r.category = c.category""")
def srt05(t):
    return od.runs_by_category(t.scraper_runs)
