"""Catalogue entries for §2.11 streaming twins.

Each entry lands the driver-derived rows as files that arrive oldest first (one write
job) under ``spark.checkpoint.dir``, runs the streaming query to completion
(``availableNow``) and returns its result table; the oracle is the batch twin.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfwise.plans.catalog import query
from shelfwise.plans.q_windows import _COOLDOWN_SQL
from shelfwise.streaming import jobs as st


def _logs_source(t):
    logs = t.scraping_logs
    path = st.scratch(t.spark, "logs-drops")
    st.land_files(logs, path, "created_at")
    return path, logs.schema


_P = ("title", "brand", "price", "sale_price", "rating", "review_count")


@query("stm01_stream_upsert", f"""
WITH y AS (SELECT *, year(scraped_date) AS yr, row_number() OVER (PARTITION BY platform, sku, year(scraped_date) ORDER BY scraped_date DESC, product_id DESC) AS rn FROM products),
a AS (SELECT yr, max(scraped_date) AS seen FROM y GROUP BY yr),
k AS (SELECT platform, sku, arg_min(product_id, yr) AS product_id, max(yr) AS yr,
  {', '.join(f"arg_max({c}, yr) FILTER ({c} IS NOT NULL) AS {c}" for c in _P)} FROM y WHERE rn = 1 GROUP BY platform, sku)
SELECT product_id, platform, sku, {', '.join(_P)}, seen AS scraped_date FROM k JOIN a USING (yr)""")
def stm01(t):
    p = t.products.select("product_id", "platform", "sku", *_P, "scraped_date")
    src = st.scratch(t.spark, "products-drops")
    files = st.land_files(p, src, "scraped_date", by=F.year("scraped_date"))
    last = st.stream_upsert(t.spark, src, p.schema, st.scratch(t.spark, "products-versions"), buckets=16, files=files)
    return st.read_version(t.spark, last, p.schema)


@query("stm02_stream_daily_activity", """
SELECT CAST(created_at AS DATE) AS activity_date, status, count(*) AS sessions FROM scraping_logs GROUP BY 1, 2""")
def stm02(t):
    src, schema = _logs_source(t)
    return st.stream_daily_activity(t.spark, src, schema)


@query("stm03_stream_cooldown", _COOLDOWN_SQL)
def stm03(t):
    attempts = t.search_items.select("platform", "created_at")
    path = st.scratch(t.spark, "attempts-drops")
    st.land_files(attempts, path, "created_at")
    st.close_stream(t.spark, path, attempts.schema)
    return st.stream_cooldown(t.spark, path, attempts.schema, 12).where("platform <> ''")


@query("stm04_stream_activity_48h", """
SELECT date_trunc('hour', created_at) - to_hours(CAST(r AS BIGINT)) AS window_start, count(*) AS sessions
FROM scraping_logs, range(48) t(r) GROUP BY 1""")
def stm04(t):
    src, schema = _logs_source(t)
    return st.stream_activity_48h(t.spark, src, schema)
