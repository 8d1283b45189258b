"""Catalogue entries for §2.7 run comparison."""

from __future__ import annotations

from shelfwise.operators import compare as cp
from shelfwise.plans.catalog import query

R1, R2 = "0000199601", "0000199602"


@query("set01_compare_skus", f"""
WITH a AS (SELECT sku FROM products WHERE scraper_id = '{R1}'), b AS (SELECT sku FROM products WHERE scraper_id = '{R2}')
SELECT (SELECT count(*) FROM a) AS total_run1, (SELECT count(*) FROM b) AS total_run2,
 (SELECT count(*) FROM a WHERE sku IN (SELECT sku FROM b)) AS common,
 (SELECT count(*) FROM a WHERE sku NOT IN (SELECT sku FROM b)) AS only_in_run1,
 (SELECT count(*) FROM b WHERE sku NOT IN (SELECT sku FROM a)) AS only_in_run2""")
def set01(t):
    return cp.compare_skus(t.products, R1, R2)


@query("set02_price_changes", f"""
WITH a AS (SELECT * FROM products WHERE scraper_id = '{R1}'), b AS (SELECT * FROM products WHERE scraper_id = '{R2}'),
head AS (SELECT product_id, sku FROM a WHERE sku IN (SELECT sku FROM b)),
fa AS (SELECT sku, title, price FROM (SELECT *, row_number() OVER (PARTITION BY sku ORDER BY product_id) AS rn FROM a) x WHERE rn = 1),
fb AS (SELECT sku, price FROM (SELECT *, row_number() OVER (PARTITION BY sku ORDER BY product_id) AS rn FROM b) x WHERE rn = 1)
SELECT h.product_id AS row_id, h.sku, fa.title, fa.price AS price_run1, fb.price AS price_run2,
 coalesce(fb.price, 0) - coalesce(fa.price, 0) AS difference,
 CASE WHEN fa.price > 0 THEN round(100.0 * (coalesce(fb.price, 0) - coalesce(fa.price, 0)) / fa.price, 2) ELSE 0.0 END AS percentage
FROM head h JOIN fa ON h.sku = fa.sku JOIN fb ON h.sku = fb.sku WHERE fa.price IS DISTINCT FROM fb.price""")
def set02(t):
    return cp.price_changes(t.products, R1, R2)


@query("set03_count_deltas", """
SELECT count(*) FILTER (WHERE scraper_id = '0020240110') AS total_run1,
 count(*) FILTER (WHERE scraper_id = '0020240111') AS total_run2,
 count(*) FILTER (WHERE scraper_id = '0020240111') - count(*) FILTER (WHERE scraper_id = '0020240110') AS difference
FROM rankings""")
def set03(t):
    return cp.count_deltas(t.rankings, "0020240110", "0020240111")


@query("set03b_review_deltas", """
SELECT count(*) FILTER (WHERE scraper_id = '0020240110') AS total_run1,
 count(*) FILTER (WHERE scraper_id = '0020240111') AS total_run2,
 count(*) FILTER (WHERE scraper_id = '0020240111') - count(*) FILTER (WHERE scraper_id = '0020240110') AS difference
FROM reviews""")
def set03b(t):
    return cp.count_deltas(t.reviews, "0020240110", "0020240111")
