"""Catalogue entries for §2.4 aggregations."""

from __future__ import annotations

from shelfwise.operators import stats
from shelfwise.operators.common import latest
from shelfwise.plans.catalog import query

LOG_ASOF = "(SELECT max(created_at) FROM scraping_logs)"
PROD_ASOF = "(SELECT max(scraped_date) FROM products)"
CNT = "count(*) FILTER (WHERE {})"


def c(cond: str) -> str:
    return CNT.format(cond)


@query("agg01_platform_stats", """
SELECT platform, count(*) AS total_products, count(*) FILTER (WHERE is_active) AS active_products,
 count(*) FILTER (WHERE NOT is_active) AS inactive_products,
 round(avg(price) FILTER (WHERE is_active), 2) AS avg_price,
 min(price) FILTER (WHERE is_active) AS min_price, max(price) FILTER (WHERE is_active) AS max_price,
 count(DISTINCT brand) FILTER (WHERE is_active) AS brands_count, max(scraped_date) AS last_scrape,
 count(*) FILTER (WHERE is_active AND rating IS NOT NULL) AS products_with_rating,
 round(avg(rating) FILTER (WHERE is_active AND rating IS NOT NULL), 2) AS avg_rating
FROM products GROUP BY platform""")
def agg01(t):
    return stats.platform_stats(t.products)


@query("agg02_platform_performance", f"""
WITH recent AS (SELECT * FROM scraping_logs WHERE created_at >= {LOG_ASOF} - INTERVAL 30 DAY),
runs AS (SELECT platform, count(*) AS total_runs, {c("status = 'completed'")} AS successful_runs,
  {c("status = 'failed'")} AS failed_runs,
  round(avg(CASE WHEN status = 'completed' THEN duration_seconds END), 2) AS avg_duration,
  max(created_at) AS last_run FROM recent GROUP BY platform),
counts AS (SELECT platform, count(*) AS total_products FROM products GROUP BY platform)
SELECT p.platform, p.name,
 CASE WHEN coalesce(r.total_runs, 0) > 0 THEN round(100.0 * r.successful_runs / r.total_runs, 2) ELSE 0.0 END AS success_rate,
 coalesce(r.total_runs, 0) AS total_runs, coalesce(r.successful_runs, 0) AS successful_runs,
 coalesce(r.failed_runs, 0) AS failed_runs, r.avg_duration, r.last_run,
 coalesce(n.total_products, 0) AS total_products
FROM platforms p LEFT JOIN runs r ON p.platform = r.platform LEFT JOIN counts n ON p.platform = n.platform""")
def agg02(t):
    return stats.platform_performance(t.scraping_logs, t.products, t.platforms,
                                      latest(t.scraping_logs, "created_at"), 30)


@query("agg03_success_rate", f"""
SELECT platform, count(*) AS total_runs, {c("status = 'completed'")} AS successful_runs,
 round(100.0 * {c("status = 'completed'")} / count(*), 2) AS success_rate
FROM scraping_logs WHERE created_at >= {LOG_ASOF} - INTERVAL 30 DAY GROUP BY platform""")
def agg03(t):
    return stats.success_rate(t.scraping_logs, latest(t.scraping_logs, "created_at"), 30)


@query("agg04_overview", f"""
WITH recent AS (SELECT * FROM scraping_logs WHERE created_at >= {LOG_ASOF} - INTERVAL 7 DAY),
bc AS (SELECT brand, count(*) AS product_count FROM products WHERE is_active AND brand IS NOT NULL GROUP BY brand)
SELECT count(*) AS total_products, {c("is_active")} AS active_products,
 round(avg(price) FILTER (WHERE is_active), 2) AS avg_price, 8 AS total_platforms,
 (SELECT count(*) FROM recent) AS recent_scrapes,
 (SELECT count(*) FROM recent WHERE status = 'completed') AS successful_scrapes,
 (SELECT brand FROM bc ORDER BY product_count DESC, brand LIMIT 1) AS top_brand
FROM products""")
def agg04(t):
    return stats.overview(t.products, t.scraping_logs, latest(t.scraping_logs, "created_at"))


@query("agg05_top_brands", """
SELECT brand, count(*) AS product_count FROM products WHERE is_active AND brand IS NOT NULL
GROUP BY brand ORDER BY product_count DESC, brand LIMIT 10""")
def agg05(t):
    return stats.top_brands(t.products, 10)


@query("agg05b_top_brands_per_platform", """
SELECT * FROM (SELECT platform, brand, product_count,
  CAST(row_number() OVER (PARTITION BY platform ORDER BY product_count DESC, brand) AS INT) AS brand_rank
 FROM (SELECT platform, brand, count(*) AS product_count FROM products
       WHERE is_active AND brand IS NOT NULL GROUP BY platform, brand) x) y WHERE brand_rank <= 10""")
def agg05b(t):
    return stats.top_brands_per_platform(t.products, 10)


@query("agg06_platform_distribution", """
SELECT platform, count(*) AS product_count FROM products WHERE is_active GROUP BY platform""")
def agg06(t):
    return stats.platform_distribution(t.products)


@query("agg07_price_buckets", f"""
SELECT {c("price < 30000")} AS under_30k, {c("price BETWEEN 30000 AND 50000")} AS from_30k_to_50k,
 {c("price BETWEEN 50000 AND 80000")} AS from_50k_to_80k, {c("price BETWEEN 80000 AND 120000")} AS from_80k_to_120k,
 {c("price > 120000")} AS over_120k
FROM products WHERE is_active""")
def agg07(t):
    return stats.price_buckets(t.products)


@query("agg08_daily_activity", f"""
SELECT CAST(created_at AS DATE) AS activity_date, status, count(*) AS sessions
FROM scraping_logs WHERE created_at >= {LOG_ASOF} - INTERVAL 7 DAY
GROUP BY CAST(created_at AS DATE), status""")
def agg08(t):
    return stats.daily_activity(t.scraping_logs, latest(t.scraping_logs, "created_at"), 7)


@query("agg09_daily_outcomes", f"""
SELECT CAST(created_at AS DATE) AS activity_date, {c("status = 'completed'")} AS completed,
 {c("status = 'failed'")} AS failed
FROM scraping_logs WHERE created_at >= {LOG_ASOF} - INTERVAL 7 DAY GROUP BY CAST(created_at AS DATE)""")
def agg09(t):
    return stats.daily_outcomes(t.scraping_logs, latest(t.scraping_logs, "created_at"), 7)


@query("agg10_daily_changes", f"""
SELECT platform, CAST(created_at AS DATE) AS activity_date, CAST(sum(products_added) AS BIGINT) AS added,
 CAST(sum(products_updated) AS BIGINT) AS updated
FROM scraping_logs WHERE created_at >= {LOG_ASOF} - INTERVAL 30 DAY
GROUP BY platform, CAST(created_at AS DATE)""")
def agg10(t):
    return stats.daily_changes(t.scraping_logs, latest(t.scraping_logs, "created_at"), 30)


@query("agg11_duplicate_skus", """
SELECT sku, CAST(sum(n) AS BIGINT) AS product_count, string_agg(platform || ':' || n, ',' ORDER BY platform) AS platforms
FROM (SELECT sku, platform, count(*) AS n FROM products GROUP BY sku, platform) x GROUP BY sku HAVING sum(n) > 1""")
def agg11(t):
    return stats.duplicate_skus(t.products)


@query("agg12_run_status_counts", f"""
SELECT count(*) AS total, {c("status = 'completed'")} AS completed, {c("status = 'failed'")} AS failed,
 {c("status = 'running'")} AS running FROM scraper_runs""")
def agg12(t):
    return stats.run_status_counts(t.scraper_runs)


@query("agg13_run_totals", f"""
SELECT count(*) AS total_runs, {c("status = 'completed'")} AS completed_runs,
 {c("status = 'failed'")} AS failed_runs, CAST(sum(products_scraped) AS BIGINT) AS total_products
FROM scraper_runs""")
def agg13(t):
    return stats.run_totals(t.scraper_runs)


@query("agg14_config_statistics", f"""
WITH s AS (SELECT configuration_id AS id, count(*) AS total_runs, {c("status = 'completed'")} AS successful_runs,
  {c("status = 'failed'")} AS failed_runs, sum(products_scraped) AS total_products,
  sum(reviews_scraped) AS total_reviews, sum(rankings_scraped) AS total_rankings,
  round(avg(CASE WHEN status = 'completed' THEN duration_seconds END), 2) AS avg_duration,
  max(created_at) AS last_run_date FROM scraper_runs GROUP BY configuration_id)
SELECT g.id, g.platform, g.category, CAST(coalesce(s.total_runs, 0) AS BIGINT) AS total_runs,
 CAST(coalesce(s.successful_runs, 0) AS BIGINT) AS successful_runs, CAST(coalesce(s.failed_runs, 0) AS BIGINT) AS failed_runs,
 CAST(coalesce(s.total_products, 0) AS BIGINT) AS total_products, CAST(coalesce(s.total_reviews, 0) AS BIGINT) AS total_reviews,
 CAST(coalesce(s.total_rankings, 0) AS BIGINT) AS total_rankings, s.avg_duration, s.last_run_date
FROM scraper_configurations g LEFT JOIN s ON g.id = s.id""")
def agg14(t):
    return stats.config_statistics(t.scraper_runs, t.scraper_configurations)


@query("agg15_queue_counts", f"""
SELECT count(*) AS total, {c("status = 'pending'")} AS pending, {c("status = 'processing'")} AS processing,
 {c("status = 'completed'")} AS completed, {c("status = 'failed'")} AS failed FROM scraping_urls""")
def agg15(t):
    return stats.queue_counts(t.scraping_urls)


@query("agg16_queue_outcome", f"""
SELECT platform, {c("status = 'completed'")} AS processed, {c("status = 'failed'")} AS errors
FROM scraping_urls GROUP BY ROLLUP (platform)""")
def agg16(t):
    return stats.queue_outcome(t.scraping_urls)


@query("agg17_review_stats", f"""
SELECT count(*) AS total_reviews,
 {c("review_images IS NOT NULL AND review_images NOT IN ('[]', 'null')")} AS with_images,
 {c("verified_purchase")} AS verified, round(avg(rating), 2) AS avg_rating FROM reviews""")
def agg17(t):
    return stats.review_stats(t.reviews)


@query("agg18_keyword_stats", f"""
SELECT count(*) AS total_keywords, {c("status")} AS active_keywords, {c("NOT status")} AS inactive_keywords,
 (SELECT count(*) FROM rankings) AS total_rankings FROM keywords""")
def agg18(t):
    return stats.keyword_stats(t.keywords, t.rankings)


@query("agg19_rankings_per_keyword", """
SELECT k.id, k.platform, k.keyword, CAST(coalesce(r.n, 0) AS BIGINT) AS rankings_count
FROM keywords k LEFT JOIN (SELECT keyword_id, count(*) AS n FROM rankings GROUP BY keyword_id) r ON k.id = r.keyword_id""")
def agg19(t):
    return stats.rankings_per_keyword(t.keywords, t.rankings)


@query("agg20_keyword_summary", """
SELECT keyword_id, count(*) AS total_rankings, count(DISTINCT sku) AS distinct_products,
 round(avg(position), 1) AS avg_position, max(created_at) AS last_tracked
FROM rankings GROUP BY keyword_id""")
def agg20(t):
    return stats.keyword_summary(t.rankings)


_BUCKET = ("CASE WHEN position <= 10 THEN '1-10' WHEN position <= 20 THEN '11-20' WHEN position <= 30 THEN '21-30' "
           "WHEN position <= 40 THEN '31-40' WHEN position <= 50 THEN '41-50' ELSE '50+' END")


@query("agg21_position_histogram", f"""
SELECT keyword_id, bucket, rankings_count,
 round(100.0 * rankings_count / sum(rankings_count) OVER (PARTITION BY keyword_id), 1) AS share_pct
FROM (SELECT keyword_id, {_BUCKET} AS bucket, count(*) AS rankings_count FROM rankings GROUP BY keyword_id, {_BUCKET}) x""")
def agg21(t):
    return stats.position_histogram(t.rankings)


@query("agg22_platform_run_stats", f"""
SELECT platform, count(*) AS total_runs, {c("status = 'completed'")} AS completed_runs,
 {c("status = 'failed'")} AS failed_runs, {c("status = 'running'")} AS running_runs,
 round(100.0 * {c("status = 'completed'")} / count(*), 1) AS success_pct
FROM scraper_runs GROUP BY platform""")
def agg22(t):
    return stats.platform_run_stats(t.scraper_runs)


@query("agg23_platform_matrix", """
SELECT p.platform, p.name, coalesce(a.n, 0) AS products_count, coalesce(b.n, 0) AS reviews_count,
 coalesce(k.n, 0) AS rankings_count, a.last_scraped
FROM platforms p
LEFT JOIN (SELECT platform, count(*) AS n, max(scraped_date) AS last_scraped FROM products GROUP BY platform) a ON p.platform = a.platform
LEFT JOIN (SELECT platform, count(*) AS n FROM reviews GROUP BY platform) b ON p.platform = b.platform
LEFT JOIN (SELECT platform, count(*) AS n FROM rankings GROUP BY platform) k ON p.platform = k.platform""")
def agg23(t):
    return stats.platform_matrix(t.products, t.reviews, t.rankings, t.platforms)


@query("agg24_health", f"""
WITH f AS (SELECT count(*) FILTER (WHERE scraped_date >= {LOG_ASOF} - INTERVAL 3 DAY) AS fresh_products,
             count(*) AS total_products FROM products),
l AS (SELECT count(*) FILTER (WHERE created_at >= {LOG_ASOF} - INTERVAL 48 HOUR) AS logs_48h,
             count(*) FILTER (WHERE created_at >= {LOG_ASOF} - INTERVAL 7 DAY) AS logs_7d,
             count(*) FILTER (WHERE created_at >= {LOG_ASOF} - INTERVAL 7 DAY AND status = 'failed') AS failed_7d
      FROM scraping_logs),
m AS (SELECT f.*, l.*,
  CASE WHEN total_products > 0 THEN round(100.0 * fresh_products / total_products, 2) ELSE 0.0 END AS fresh_pct,
  CASE WHEN logs_7d > 0 THEN round(100.0 * failed_7d / logs_7d, 2) ELSE 0.0 END AS error_rate_pct FROM f, l)
SELECT *, CASE WHEN logs_48h = 0 THEN 'warning' ELSE 'healthy' END AS recent_activity,
 CASE WHEN fresh_pct < 50 THEN 'error' WHEN fresh_pct < 80 THEN 'warning' ELSE 'healthy' END AS data_freshness,
 CASE WHEN error_rate_pct > 30 THEN 'error' WHEN error_rate_pct > 10 THEN 'warning' ELSE 'healthy' END AS error_rate
FROM m""")
def agg24(t):
    return stats.health(t.products, t.scraping_logs, latest(t.scraping_logs, "created_at"))


@query("agg25_freshness_verdict", f"""
WITH f AS (SELECT count(*) FILTER (WHERE scraped_date >= {PROD_ASOF} - INTERVAL 3 DAY) AS fresh_products,
             count(*) AS total_products FROM products),
m AS (SELECT *, CASE WHEN total_products > 0 THEN round(100.0 * fresh_products / total_products, 1) ELSE 0.0 END AS fresh_pct FROM f)
SELECT *, CASE WHEN fresh_pct > 80 THEN 'ok' WHEN fresh_pct > 50 THEN 'warning' ELSE 'bad' END AS verdict FROM m""")
def agg25(t):
    return stats.freshness_verdict(t.products, latest(t.products, "scraped_date"))


@query("agg26_detailed_stats", f"""
SELECT count(*) AS total_products, {c("is_active")} AS active_products, 0::BIGINT AS with_images,
 {c("rating IS NOT NULL")} AS with_ratings, round(avg(price) FILTER (WHERE is_active), 2) AS avg_price,
 min(price) FILTER (WHERE is_active) AS min_price, max(price) FILTER (WHERE is_active) AS max_price
FROM products""")
def agg26(t):
    return stats.detailed_stats(t.products)


@query("agg27_storage_summary", f"""
SELECT count(*) AS total_products, {c("is_active")} AS active_products, {c("NOT is_active")} AS inactive_products,
 (SELECT count(*) FROM scraping_logs) AS total_logs,
 (SELECT count(*) FROM scraping_logs WHERE created_at >= {LOG_ASOF} - INTERVAL 7 DAY) AS recent_logs,
 count(*) * 2 + (SELECT count(*) FROM scraping_logs) AS estimated_kb
FROM products""")
def agg27(t):
    return stats.storage_summary(t.products, t.scraping_logs, latest(t.scraping_logs, "created_at"))


@query("agg28_scrape_dates", """
SELECT DISTINCT CAST(scraped_date AS DATE) AS scrape_date FROM products WHERE scraped_date IS NOT NULL""")
def agg28(t):
    return stats.scrape_dates(t.products)


@query("agg29_pick_list_brands", """
SELECT DISTINCT brand FROM products WHERE brand IS NOT NULL""")
def agg29(t):
    return stats.pick_list(t.products, "brand")


@query("agg29b_pick_list_categories", """
SELECT DISTINCT category FROM scraper_runs WHERE category IS NOT NULL""")
def agg29b(t):
    return stats.pick_list(t.scraper_runs, "category")


@query("agg30_is_running", """
SELECT platform, bool_or(status = 'running') AS is_running FROM scraper_runs GROUP BY platform""")
def agg30(t):
    return stats.is_running(t.scraper_runs)


@query("agg32_ranking_counters", f"""
SELECT keyword_id, count(*) AS items_found, {c("is_sponsored")} AS sponsored_skipped,
 {c("NOT is_sponsored")} AS rankings_saved FROM search_items GROUP BY keyword_id""")
def agg32(t):
    return stats.ranking_counters(t.search_items)


@query("agg33_platform_verdict", f"""
WITH r AS (SELECT platform, round(100.0 * {c("status = 'completed'")} / count(*), 2) AS success_rate
  FROM scraping_logs WHERE created_at >= {LOG_ASOF} - INTERVAL 30 DAY GROUP BY platform)
SELECT p.platform, coalesce(r.success_rate, 0.0) AS success_rate,
 CASE WHEN coalesce(r.success_rate, 0.0) >= 80 THEN 'healthy' WHEN coalesce(r.success_rate, 0.0) >= 60 THEN 'warning' ELSE 'error' END AS verdict
FROM platforms p LEFT JOIN r ON p.platform = r.platform""")
def agg33(t):
    return stats.platform_verdict(t.scraping_logs, t.platforms, latest(t.scraping_logs, "created_at"), 30)
