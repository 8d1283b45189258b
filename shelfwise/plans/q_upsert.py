"""Catalogue entries for §2.9 cleaning and upserts (and AGG31)."""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import functions as F

from shelfwise.functions import hashing as hs
from shelfwise.operators import filters as fl
from shelfwise.operators import upsert as up
from shelfwise.operators.common import ago, latest, lit
from shelfwise.plans.catalog import query
from shelfwise.plans.q_scalars import SAN_STR

CUT = "1998-06-01"
# days a stored row counts as current in ups01b: rows before CUT lie on both sides of it
LOOKBACK = 365
P_COLS = ["product_id", "title", "brand", "price", "sale_price", "rating", "review_count", "is_active",
          "include_exclude", "scraped_date", "scraper_id", "product_url"]
P_CHANGE = [f for f in up.PRODUCT_CHANGE_FIELDS if f in P_COLS]


def _dedup(src: str, part: str, order: str) -> str:
    return (f"SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY {part} ORDER BY {order}) AS rn "
            f"FROM {src}) x WHERE rn = 1")


def _merge_sql(keys: list[str], cols: list[str], change: list[str], touch: dict[str, str] | None,
               ident: tuple[str, ...] = ("product_id", "id")) -> str:
    """DuckDB twin of ``upsert._merge`` over CTEs ``inc`` and ``cur``."""
    allc = keys + cols
    proj = ", ".join([f"n.{c} AS n_{c}" for c in allc] + [f"o.{c} AS o_{c}" for c in allc])
    on = " AND ".join(f"n.{k} = o.{k}" for k in keys)
    k0 = keys[0]
    chg = " OR ".join(f"(n_{f} IS NOT NULL AND n_{f} IS DISTINCT FROM o_{f})" for f in change)
    action = (f"CASE WHEN o_{k0} IS NULL THEN 'created' WHEN n_{k0} IS NULL THEN 'unchanged' "
              f"WHEN {chg} THEN 'updated' ELSE '{'touched' if touch else 'unchanged'}' END")
    sel = [f"coalesce(n_{k}, o_{k}) AS {k}" for k in keys]
    for c in cols:
        if c in ident:
            v = f"CASE WHEN o_{k0} IS NOT NULL THEN o_{c} ELSE n_{c} END"
        else:
            v = f"CASE WHEN a = 'created' THEN n_{c} WHEN a = 'updated' THEN coalesce(n_{c}, o_{c}) ELSE o_{c} END"
        if touch and c in touch:
            v = f"CASE WHEN a IN ('created', 'updated', 'touched') THEN {touch[c]} ELSE o_{c} END"
        sel.append(f"{v} AS {c}")
    return (f"SELECT {', '.join(sel)}, a AS action FROM (SELECT *, {action} AS a FROM "
            f"(SELECT {proj} FROM inc n FULL JOIN cur o ON {on}) j) x")


def _ups1_sql() -> str:
    order = "scraped_date DESC NULLS LAST, product_id DESC"
    base = f"(SELECT platform, sku, {', '.join(P_COLS)} FROM products)"
    body = _merge_sql(["platform", "sku"], P_COLS, P_CHANGE, {"scraped_date": "(SELECT max(scraped_date) FROM inc)"})
    return f"""WITH cur AS ({_dedup(f"{base} b WHERE scraped_date < DATE '{CUT}'", 'platform, sku', order)}),
inc AS ({_dedup(f"{base} b WHERE scraped_date >= DATE '{CUT}'", 'platform, sku', order)})
{body}"""


UPS1_SQL = _ups1_sql()


def _ups1(t):
    p = t.products.select("platform", "sku", *P_COLS)
    cur = p.where(F.col("scraped_date") < F.lit(_dt.date.fromisoformat(CUT)))
    inc = p.where(F.col("scraped_date") >= F.lit(_dt.date.fromisoformat(CUT)))
    return up.upsert_products(cur, inc, latest(inc, "scraped_date"))


@query("ups01_upsert_products", UPS1_SQL)
def ups01(t):
    return _ups1(t)


def _ups1_lookback_sql() -> str:
    order = "scraped_date DESC NULLS LAST, product_id DESC"
    cols = f"platform, sku, {', '.join(P_COLS)}"
    base = f"(SELECT {cols} FROM products)"
    body = _merge_sql(["platform", "sku"], P_COLS, P_CHANGE, {"scraped_date": "(SELECT max(scraped_date) FROM inc)"})
    return f"""WITH inc AS ({_dedup(f"{base} b WHERE scraped_date >= DATE '{CUT}'", 'platform, sku', order)}),
old AS (SELECT *, scraped_date IS NULL OR scraped_date >= (SELECT max(scraped_date) FROM inc) - INTERVAL {LOOKBACK} DAY AS recent
  FROM {base} b WHERE scraped_date < DATE '{CUT}'),
ranked AS (SELECT *, row_number() OVER (PARTITION BY platform, sku, recent ORDER BY {order}) AS rn FROM old),
cur AS (SELECT {cols} FROM ranked WHERE recent AND rn = 1)
{body} UNION ALL SELECT {cols}, 'unchanged' AS action FROM ranked WHERE NOT (recent AND rn = 1)"""


@query("ups01b_upsert_products_lookback", _ups1_lookback_sql())
def ups01b(t):
    p = t.products.select("platform", "sku", *P_COLS)
    cur = p.where(F.col("scraped_date") < F.lit(_dt.date.fromisoformat(CUT)))
    inc = p.where(F.col("scraped_date") >= F.lit(_dt.date.fromisoformat(CUT)))
    return up.upsert_products(cur, inc, latest(inc, "scraped_date"), LOOKBACK)


@query("agg31_ingest_counters", f"""
WITH u AS ({UPS1_SQL}),
d AS (SELECT platform, count(*) FILTER (WHERE platform = 'amazon' AND is_active
   AND scraped_date < (SELECT max(scraped_date) FROM products) - INTERVAL 365 DAY) AS n FROM products GROUP BY platform),
e AS (SELECT platform, count(*) AS n FROM scraping_logs WHERE status = 'failed' GROUP BY platform),
c AS (SELECT platform, count(*) FILTER (WHERE action <> 'unchanged') AS products_found,
 count(*) FILTER (WHERE action = 'created') AS products_added, count(*) FILTER (WHERE action = 'updated') AS products_updated,
 count(*) FILTER (WHERE action = 'touched') AS products_touched FROM u GROUP BY platform)
SELECT platform, coalesce(products_found, 0) AS products_found, coalesce(products_added, 0) AS products_added,
 coalesce(products_updated, 0) AS products_updated, coalesce(products_touched, 0) AS products_touched,
 coalesce(d.n, 0) AS products_deactivated, coalesce(e.n, 0) AS errors_count
FROM c FULL JOIN d USING (platform) FULL JOIN e USING (platform)""")
def agg31(t):
    gone = up.deactivate(t.products, "amazon", ago(latest(t.products, "scraped_date"), 365))
    return up.ingest_counters(_ups1(t), gone, t.scraping_logs.where(F.col("status") == "failed"))


R_COLS = ["id", "reviewer_name", "rating", "review_title", "review_text", "verified_purchase", "helpful_count",
          "review_images"]
R_CHANGE = [f for f in up.REVIEW_CHANGE_FIELDS if f in R_COLS]
R_INC = "SELECT * REPLACE (CAST(helpful_count + id % 2 AS INT) AS helpful_count) FROM reviews WHERE id % 4 > 0"


def _reviews_split(t):
    r = t.reviews.select("platform", "sku", "review_id", *R_COLS)
    # a quarter of the reviews is stored, a quarter comes in, half is both
    cur = r.where(F.col("id") % 4 < 3)
    inc = r.where(F.col("id") % 4 > 0).withColumn("helpful_count", (F.col("helpful_count") + F.col("id") % 2).cast("int"))
    return cur, inc


def _ups2_sql() -> str:
    keys = ["platform", "sku", "review_id"]
    cols = ", ".join(keys + R_COLS)
    body = _merge_sql(keys, R_COLS, R_CHANGE, None, ident=("id",))
    return f"""WITH cur AS ({_dedup(f"(SELECT {cols} FROM reviews WHERE id % 4 < 3) b", 'platform, sku, review_id', 'id DESC')}),
inc AS ({_dedup(f"(SELECT {cols} FROM ({R_INC}) r0) b", 'platform, sku, review_id', 'id DESC')})
{body}"""


@query("ups02_upsert_reviews", _ups2_sql())
def ups02(t):
    cur, inc = _reviews_split(t)
    return up.upsert_reviews(cur, inc)


@query("ups03_upsert_reviews_by_hash", f"""
WITH h AS (SELECT *, md5(encode(coalesce(sku, '') || coalesce(reviewer_name, '') || coalesce(CAST(rating AS VARCHAR), ''))
   || encode(coalesce(review_text, ''))[1:50]) AS review_hash FROM reviews),
cur AS ({_dedup("(SELECT review_hash, id, helpful_count FROM h WHERE id % 4 < 3) b", "review_hash", "id DESC")}),
inc AS ({_dedup("(SELECT review_hash, id, CAST(helpful_count + id % 2 AS INT) AS helpful_count FROM h WHERE id % 4 > 0) b", "review_hash", "id DESC")})
SELECT coalesce(n.review_hash, o.review_hash) AS review_hash,
 CASE WHEN o.review_hash IS NULL THEN n.id ELSE o.id END AS id,
 CASE WHEN o.review_hash IS NULL THEN n.helpful_count
      WHEN n.review_hash IS NOT NULL AND n.helpful_count IS DISTINCT FROM o.helpful_count THEN n.helpful_count
      ELSE o.helpful_count END AS helpful_count,
 CASE WHEN o.review_hash IS NULL THEN 'created'
      WHEN n.review_hash IS NOT NULL AND n.helpful_count IS DISTINCT FROM o.helpful_count THEN 'updated'
      ELSE 'unchanged' END AS action
FROM inc n FULL JOIN cur o ON n.review_hash = o.review_hash""")
def ups03(t):
    r = t.reviews.withColumn("review_hash", hs.review_hash("sku", "reviewer_name", "rating", "review_text"))
    cur = r.where(F.col("id") % 4 < 3).select("review_hash", "id", "helpful_count")
    inc = r.where(F.col("id") % 4 > 0).select(
        "review_hash", "id", (F.col("helpful_count") + F.col("id") % 2).cast("int").alias("helpful_count"))
    return up.upsert_reviews_by_hash(cur, inc)


@query("ups04_last_write_wins", """
SELECT platform, review_id, id, CASE WHEN verified_purchase THEN helpful_count + 1 ELSE helpful_count END AS helpful_count
FROM reviews""")
def ups04(t):
    r = t.reviews.select("platform", "review_id", "id", "verified_purchase", "helpful_count")
    inc = r.where(F.col("verified_purchase")).withColumn("helpful_count", (F.col("helpful_count") + 1).cast("int"))
    return up.last_write_wins(r, inc, ["platform", "review_id"]).select("platform", "review_id", "id", "helpful_count")


_RK_CUT = "2024-01-25 00:00:00"


@query("ups05_upsert_rankings", f"""
WITH pd AS ({_dedup("products", "platform, sku", "scraped_date DESC NULLS LAST, product_id DESC")}),
inc0 AS (SELECT item_id AS id, keyword_id, platform, sku, page, created_at FROM search_items
  WHERE NOT is_sponsored AND created_at >= TIMESTAMP '{_RK_CUT}'),
stubs AS (SELECT md5(platform || '|' || sku) AS product_id, platform, sku FROM (SELECT DISTINCT platform, sku FROM inc0) x
  WHERE NOT EXISTS (SELECT 1 FROM products p WHERE p.platform = x.platform AND p.sku = x.sku)),
dim AS (SELECT platform, sku, product_id FROM pd UNION ALL SELECT platform, sku, product_id FROM stubs),
u AS (SELECT r.id, r.keyword_id, r.platform, r.sku, r.page, r.created_at, d.product_id, 0 AS load FROM rankings r
  LEFT JOIN dim d ON r.platform = d.platform AND r.sku = d.sku WHERE r.created_at < TIMESTAMP '{_RK_CUT}'
 UNION ALL SELECT i.*, d.product_id, 1 AS load FROM inc0 i LEFT JOIN dim d ON i.platform = d.platform AND i.sku = d.sku)
SELECT * EXCLUDE (rn, load) FROM (SELECT *, row_number() OVER (PARTITION BY keyword_id, product_id, platform
  ORDER BY load DESC, created_at DESC, id DESC) AS rn FROM u) x WHERE rn = 1""")
def ups05(t):
    cut = lit(_dt.datetime.fromisoformat(_RK_CUT))
    cur = t.rankings.where(F.col("created_at") < cut).select("id", "keyword_id", "platform", "sku", "page", "created_at")
    inc = (t.search_items.where(~F.col("is_sponsored") & (F.col("created_at") >= cut))
           .select(F.col("item_id").alias("id"), "keyword_id", "platform", "sku", "page", "created_at"))
    return up.upsert_rankings(cur, t.products, inc, ["created_at", "id"]).select(
        "id", "keyword_id", "platform", "sku", "page", "created_at", "product_id")


@query("ups06_append_rankings", """
SELECT item_id AS id, CAST(NULL AS VARCHAR) AS product_id, sku, keyword_id, platform, CAST(NULL AS VARCHAR) AS scraper_id,
 CAST(row_number() OVER (PARTITION BY keyword_id ORDER BY page, created_at, item_id) AS INT) AS position, page,
 created_at FROM search_items WHERE NOT is_sponsored""")
def ups06(t):
    from shelfwise.operators.ranking import organic_position
    pos = organic_position(t.search_items).withColumnRenamed("item_id", "id")
    return up.append_rankings(pos)


@query("ups07_deactivate", """
SELECT product_id, CASE WHEN hit THEN false ELSE is_active END AS is_active, hit AS deactivated FROM (
 SELECT product_id, is_active, coalesce(platform = 'amazon' AND is_active AND
   scraped_date < (SELECT max(scraped_date) FROM products) - INTERVAL 365 DAY, false) AS hit FROM products) x""")
def ups07(t):
    cutoff = ago(latest(t.products, "scraped_date"), 365)
    return up.deactivate(t.products, "amazon", cutoff).select("product_id", "is_active", "deactivated")


@query("ups08_retention", """
SELECT (SELECT count(*) FROM scraping_logs WHERE created_at < (SELECT max(created_at) FROM scraping_logs) - INTERVAL 30 DAY) AS logs_to_delete,
 (SELECT count(*) FROM products WHERE NOT is_active AND scraped_date < (SELECT max(created_at) FROM scraping_logs) - INTERVAL 90 DAY) AS products_to_delete""")
def ups08(t):
    _, _, counts = up.retention(t.scraping_logs, t.products, latest(t.scraping_logs, "created_at"), 30, 90)
    return counts


@query("ups08b_retained_logs", """
SELECT id, platform, status, created_at FROM scraping_logs
WHERE created_at >= (SELECT max(created_at) FROM scraping_logs) - INTERVAL 30 DAY""")
def ups08b(t):
    logs, _, _ = up.retention(t.scraping_logs, t.products, latest(t.scraping_logs, "created_at"), 30, 90)
    return logs.select("id", "platform", "status", "created_at")


@query("ups08c_retained_products", """
SELECT product_id, is_active, scraped_date FROM products
WHERE is_active OR scraped_date >= (SELECT max(created_at) FROM scraping_logs) - INTERVAL 90 DAY""")
def ups08c(t):
    _, products, _ = up.retention(t.scraping_logs, t.products, latest(t.scraping_logs, "created_at"), 30, 90)
    return products.select("product_id", "is_active", "scraped_date")


@query("ups09_bulk_set", """
SELECT id, keyword, CASE WHEN id IN (SELECT user_id FROM events WHERE event_type = 'purchase' AND value > 90) THEN false ELSE status END AS status
FROM keywords""")
def ups09(t):
    ids = t.events.where((F.col("event_type") == "purchase") & (F.col("value") > 90)).select("user_id")
    return up.bulk_set(t.keywords.select("id", "keyword", "status"), ids, "status", False)


@query("ups10_bulk_delete", """
SELECT id, platform FROM reviews WHERE id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)""")
def ups10(t):
    ids = t.labels.where(F.col("toxic") == 1).select("doc_id")
    return up.bulk_delete(t.reviews.select("id", "platform"), ids)


_AT = "2024-02-01 00:00:00"


def _outcomes(t):
    usable = fl.usable_pages(t.pages).select("page_id").withColumn("ok", F.lit(True))
    return (t.pages.select("page_id").join(usable, "page_id", "left")
            .select(F.col("page_id").alias("id"),
                    F.when(F.col("ok"), "completed").otherwise("failed").alias("outcome"),
                    F.when(F.col("ok"), F.lit(None)).otherwise(F.lit("unusable page")).cast("string").alias("message"),
                    lit(_dt.datetime.fromisoformat(_AT)).alias("at")))


@query("ups11_apply_url_outcomes", f"""
WITH ok AS (SELECT page_id FROM pages WHERE strlen(html) >= 1000 AND NOT (
 contains(lower(html), 'ap_signin_form') OR contains(lower(html), 'sign-in') OR contains(lower(html), 'sign in to continue')
 OR contains(lower(html), 'enter your email or mobile phone number') OR contains(lower(html), 'ap_email')
 OR contains(lower(html), 'ap_password')))
SELECT u.id, u.platform, u.url, CASE WHEN ok.page_id IS NOT NULL THEN 'completed' ELSE 'failed' END AS status,
 u.priority, CAST(u.retry_count + CASE WHEN ok.page_id IS NULL THEN 1 ELSE 0 END AS INT) AS retry_count,
 CASE WHEN ok.page_id IS NULL THEN 'unusable page' END AS error_message,
 CASE WHEN ok.page_id IS NOT NULL THEN TIMESTAMP '{_AT}' END AS last_scraped_at
FROM scraping_urls u LEFT JOIN ok ON u.id = ok.page_id""")
def ups11(t):
    return up.apply_url_outcomes(t.scraping_urls, _outcomes(t))


@query("ups12_close_runs", """
WITH o AS (SELECT scraper_id, configuration_id, created_at + to_minutes(products_scraped) AS finished_at FROM scraper_runs WHERE status = 'running'),
per AS (SELECT configuration_id AS id, count(*) AS n, max(finished_at) AS last_at,
  (array_agg(scraper_id ORDER BY finished_at DESC, scraper_id DESC))[1] AS last_id FROM o GROUP BY configuration_id)
SELECT c.id, c.platform, c.category, c.tag, c.status, CAST(c.total_runs + coalesce(per.n, 0) AS INT) AS total_runs,
 coalesce(per.last_at, c.last_run_at) AS last_run_at, coalesce(per.last_id, c.last_scraper_id) AS last_scraper_id
FROM scraper_configurations c LEFT JOIN per ON c.id = per.id""")
def ups12(t):
    return _closed(t)[1]


def _closed(t):
    runs = t.scraper_runs
    outcomes = runs.where(F.col("status") == "running").select(
        "scraper_id", F.when(F.col("errors_count") < 3, "completed").otherwise("failed").alias("status"),
        (F.col("created_at") + F.make_dt_interval(mins=F.col("products_scraped"))).alias("finished_at"))
    return up.close_runs(t.scraper_configurations, runs, outcomes)


@query("ups12b_closed_runs", """
SELECT scraper_id, CASE WHEN status <> 'running' THEN status WHEN errors_count < 3 THEN 'completed' ELSE 'failed' END AS status,
 CASE WHEN status = 'running' THEN created_at + to_minutes(products_scraped) END AS completed_at,
 CASE WHEN status = 'running' THEN products_scraped * 60 ELSE duration_seconds END AS duration_seconds FROM scraper_runs""")
def ups12b(t):
    return _closed(t)[0].select("scraper_id", "status", "completed_at", "duration_seconds")


@query("ups13_append_errors", """
WITH e AS (SELECT user_id AS session_id, 'error ' || CAST(event_id AS VARCHAR) AS message, ts FROM events WHERE event_type = 'error'),
per AS (SELECT session_id, count(*) AS n, arg_max(message, (ts, message)) AS last_msg,
  min(ts) AS first_error_at, max(ts) AS last_error_at FROM e GROUP BY session_id)
SELECT l.id, CAST(l.errors_count + coalesce(per.n, 0) AS INT) AS errors_count, per.last_msg AS error_message,
 per.first_error_at, per.last_error_at
FROM scraping_logs l LEFT JOIN per ON l.id = per.session_id""")
def ups13(t):
    out = up.append_errors(t.scraping_logs, _errors(t))
    return out.select("id", "errors_count", "error_message", "first_error_at", "last_error_at")


def _errors(t):
    return t.events.where(F.col("event_type") == "error").select(
        F.col("user_id").alias("session_id"), F.concat(F.lit("error "), F.col("event_id").cast("string")).alias("message"),
        F.col("props").alias("details"), F.col("ts").alias("timestamp"))


@query("ups13b_error_details", """
SELECT user_id AS id, 'error ' || CAST(event_id AS VARCHAR) AS message, props AS details, ts AS "timestamp"
FROM events WHERE event_type = 'error'""")
def ups13b(t):
    return up.error_details(_errors(t))


@query("cln01_clean_products", f"""
SELECT product_id, {SAN_STR.format(x='platform')} AS platform, {SAN_STR.format(x='sku')} AS sku,
 {SAN_STR.format(x='title')} AS title, {SAN_STR.format(x='brand')} AS brand,
 CAST(CASE WHEN price IS NULL THEN NULL WHEN p BETWEEN 2000 AND 1600000 THEN p END AS DECIMAL(10,2)) AS price,
 CAST(CASE WHEN v BETWEEN 0 AND 5 THEN v END AS DECIMAL(3,2)) AS rating,
 CAST(coalesce(TRY_CAST(nullif(regexp_replace(CAST(review_count AS VARCHAR), '[^0-9]', '', 'g'), '') AS BIGINT), 0) AS INT) AS review_count,
 coalesce(TRY_CAST(CAST(is_active AS VARCHAR) AS BOOLEAN), true) AS is_active, false AS bestseller
FROM (SELECT *, coalesce(TRY_CAST(nullif(regexp_extract(replace(regexp_replace(CAST(price AS VARCHAR), '[^0-9.,]', '', 'g'), ',', ''),
  '^\\s*([0-9]*\\.?[0-9]+|[0-9]+\\.?)', 1), '') AS DOUBLE), 0.0) AS p,
  TRY_CAST(nullif(regexp_extract(CAST(rating AS VARCHAR), '([0-9]+\\.?[0-9]*)', 1), '') AS DOUBLE) AS v FROM products) x""")
def cln01(t):
    raw = t.products.select("product_id", "platform", "sku", "title", "brand", F.col("price").cast("string").alias("price"),
                            F.col("rating").cast("string").alias("rating"), "review_count", "is_active")
    return up.clean_products(raw).select("product_id", "platform", "sku", "title", "brand", "price", "rating",
                                         "review_count", "is_active", "bestseller")
