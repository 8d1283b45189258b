"""Catalogue entries for §2.8 scalar functions, applied to whole table columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfwise.functions import arrays as ar
from shelfwise.functions import dates as dt
from shelfwise.functions import hashing as hs
from shelfwise.functions import numbers as nm
from shelfwise.functions import text as tx
from shelfwise.functions import urls as ul
from shelfwise.operators.common import latest
from shelfwise.plans.catalog import query


def _strip(x: str) -> str:
    return f"trim(regexp_replace(regexp_replace({x}, '<[^>]*>', '', 'g'), '\\s+', ' ', 'g'))"


def _falsy(x: str) -> str:
    return f"CASE WHEN {x} IS NULL OR {x} = '' OR {x} = '0' THEN NULL ELSE {x} END"


SAN_STR = _falsy("regexp_replace(" + _strip("{x}") + ", '[^\\p{{L}}\\p{{N}}\\s\\-_.,()&/]', '', 'g')")
SAN_TXT = _falsy(_strip("{x}"))


@query("str01_sanitize_string", f"""
SELECT id, {SAN_STR.format(x='review_text')} AS text_clean FROM reviews""")
def str01(t):
    return t.reviews.select("id", tx.sanitize_string("review_text").alias("text_clean"))


@query("str02_sanitize_text", f"""
SELECT id, {SAN_TXT.format(x='review_text')} AS text_clean FROM reviews""")
def str02(t):
    return t.reviews.select("id", tx.sanitize_text("review_text").alias("text_clean"))


@query("str03_clean_text", f"""
SELECT page_id, {_strip(_falsy('html'))} AS page_text FROM pages""")
def str03(t):
    return t.pages.select("page_id", tx.clean_text("html").alias("page_text"))


_BRAND_CASE = "CASE lower(s) " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in tx.BRAND_MAP.items()) + \
    " ELSE upper(substr(s, 1, 1)) || substr(s, 2) END"


@query("str04_normalize_brand", f"""
SELECT product_id, {_BRAND_CASE} AS brand_normalized
FROM (SELECT product_id, {SAN_STR.format(x='brand')} AS s FROM products) x""")
def str04(t):
    return t.products.select("product_id", tx.normalize_brand("brand").alias("brand_normalized"))


@query("str05_slug", """
SELECT product_id, regexp_replace(regexp_replace(lower(title), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS title_slug
FROM products""")
def str05(t):
    return t.products.select("product_id", tx.slug("title").alias("title_slug"))


@query("str06_truncate", """
SELECT id, left(review_text, 500) AS text_500 FROM reviews""")
def str06(t):
    return t.reviews.select("id", tx.truncate("review_text", 500).alias("text_500"))


@query("str07_spec_key", """
SELECT id, lower(replace(keyword, ' ', '_')) AS keyword_key FROM keywords""")
def str07(t):
    return t.keywords.select("id", tx.spec_key("keyword").alias("keyword_key"))


@query("str08_strip_label", """
SELECT id, trim(regexp_replace(reviewer_name, '(?i)USER', '', 'g')) AS reviewer_number FROM reviews""")
def str08(t):
    return t.reviews.select("id", tx.strip_label("reviewer_name", "USER").alias("reviewer_number"))


@query("str09_label", """
SELECT id, CASE WHEN status THEN 'Active' WHEN NOT status THEN 'Inactive' END AS status_label FROM keywords""")
def str09(t):
    return t.keywords.select("id", tx.label("status", {True: "Active", False: "Inactive"}).alias("status_label"))


@query("str10_brand_from_title", """
SELECT product_id, regexp_replace(title, '\\s+(?:\\d+.*)?$', '') AS brand_guess FROM products""")
def str10(t):
    return t.products.select("product_id", tx.brand_from_title("title").alias("brand_guess"))


_VALID = ul.VALID_URL.replace("\\", "\\\\") if False else ul.VALID_URL


@query("url01_sanitize_url", f"""
SELECT page_id, CASE WHEN trim(url) IS NULL OR trim(url) = '' THEN NULL
 WHEN regexp_matches(u, '{_VALID}') THEN u END AS url_clean
FROM (SELECT page_id, url, CASE WHEN regexp_matches(trim(url), '^https?://') THEN trim(url) ELSE 'https://' || trim(url) END AS u FROM pages) x""")
def url01(t):
    return t.pages.select("page_id", ul.sanitize_url("url").alias("url_clean"))


@query("url02_absolutize", """
SELECT page_id, CASE WHEN starts_with(h, 'http') THEN h ELSE 'https://www.example.com' || h END AS link
FROM (SELECT page_id, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS h FROM shop_pages) x""")
def url02(t):
    links = t.shop_pages.select("page_id", F.explode(F.regexp_extract_all("html", F.lit(r'href="([^"]*)"'), 1)).alias("h"))
    return links.select("page_id", ul.absolutize("h", "https://www.example.com").alias("link"))


@query("url03_strip_query", """
SELECT page_id, split_part(url, '?', 1) AS url_base FROM pages""")
def url03(t):
    return t.pages.select("page_id", ul.strip_query("url").alias("url_base"))


@query("url04_page_url", """
SELECT id, CASE WHEN priority + 1 <= 1 THEN url WHEN contains(url, '?') THEN url || '&page=' || CAST(priority + 1 AS VARCHAR)
 ELSE url || '?page=' || CAST(priority + 1 AS VARCHAR) END AS next_page_url FROM scraping_urls""")
def url04(t):
    return t.scraping_urls.select("id", ul.page_url("url", F.col("priority") + 1).alias("next_page_url"))


@query("url05_search_url", """
SELECT id, CASE WHEN id % 5 + 1 <= 1 THEN 'https://www.amazon.in/s?k=' || replace(url_encode(keyword), '%20', '+')
 ELSE 'https://www.amazon.in/s?k=' || replace(url_encode(keyword), '%20', '+') || '&page=' || CAST(id % 5 + 1 AS VARCHAR) END AS search_url
FROM keywords""")
def url05(t):
    return t.keywords.select("id", ul.search_url("https://www.amazon.in/s?k=", "keyword",
                                                 (F.col("id") % 5 + 1).cast("int")).alias("search_url"))


def _first(x: str, pats: list[str]) -> str:
    return "coalesce(" + ", ".join(f"nullif(regexp_extract({x}, '{p}', 1), '')" for p in pats) + ")"


@query("sku01_sku_from_url", f"""
SELECT product_id, CASE WHEN platform = 'amazon' THEN {_first('product_url', ul.SKU_PATTERNS['amazon'])}
 WHEN platform = 'flipkart' THEN {_first('product_url', ul.SKU_PATTERNS['flipkart'])}
 ELSE {_first('product_url', ul.SKU_PATTERNS['default'])} END AS url_sku FROM products""")
def sku01(t):
    return t.products.select("product_id", ul.sku_from_url("product_url", "platform").alias("url_sku"))


@query("num01_sanitize_price", """
SELECT product_id, CASE WHEN p BETWEEN 2000 AND 1600000 THEN p END AS price_clean
FROM (SELECT product_id, coalesce(TRY_CAST(nullif(regexp_extract(replace(regexp_replace(CAST(price AS VARCHAR), '[^0-9.,]', '', 'g'), ',', ''),
  '^\\s*([0-9]*\\.?[0-9]+|[0-9]+\\.?)', 1), '') AS DOUBLE), 0.0) AS p FROM products WHERE price IS NOT NULL) x
UNION ALL SELECT product_id, NULL FROM products WHERE price IS NULL""")
def num01(t):
    return t.products.select("product_id", nm.sanitize_price("price").alias("price_clean"))


@query("num02_extract_price", """
SELECT product_id, CASE WHEN regexp_matches(s, '^[0-9]*\\.?[0-9]+$|^[0-9]+\\.$') THEN TRY_CAST(s AS DOUBLE) END AS price_value
FROM (SELECT product_id, replace(regexp_replace('₹' || CAST(sale_price AS VARCHAR), '[^0-9.,]', '', 'g'), ',', '') AS s FROM products) x""")
def num02(t):
    return t.products.select("product_id", nm.extract_price(F.concat(F.lit("₹"), F.col("sale_price").cast("string")))
                             .alias("price_value"))


@query("num03_numeric_price", """
SELECT product_id, TRY_CAST(nullif(regexp_extract(replace(CAST(price AS VARCHAR), ',', ''), '([0-9]+)', 1), '') AS BIGINT) AS rupees
FROM products""")
def num03(t):
    return t.products.select("product_id", nm.numeric_price("price").alias("rupees"))


@query("num04_rating", """
SELECT id, CASE WHEN v BETWEEN 0 AND 5 THEN v END AS text_rating
FROM (SELECT id, TRY_CAST(nullif(regexp_extract(review_text, '([0-9]+\\.?[0-9]*)', 1), '') AS DOUBLE) AS v FROM reviews) x""")
def num04(t):
    return t.reviews.select("id", nm.rating("review_text").alias("text_rating"))


@query("num05_review_count", """
SELECT id, coalesce(TRY_CAST(nullif(regexp_extract(replace(review_text, ',', ''), '([0-9]+)', 1), '') AS BIGINT), 0) AS first_count,
 coalesce(TRY_CAST(nullif(regexp_replace(reviewer_name, '[^0-9]', '', 'g'), '') AS BIGINT), 0) AS name_digits
FROM reviews""")
def num05(t):
    return t.reviews.select("id", nm.review_count("review_text").alias("first_count"),
                            nm.digits("reviewer_name").alias("name_digits"))


@query("num06_effective_price", """
SELECT product_id, coalesce(sale_price, price) AS effective_price FROM products""")
def num06(t):
    return t.products.select("product_id", nm.effective_price().alias("effective_price"))


@query("num07_discount_pct", """
SELECT product_id, CASE WHEN price IS NOT NULL AND sale_price IS NOT NULL AND price <> 0 AND sale_price <> 0 AND sale_price < price
 THEN round(100.0 * (price - sale_price) / price, 2) END AS discount_pct FROM products""")
def num07(t):
    return t.products.select("product_id", nm.discount_pct().alias("discount_pct"))


@query("num08_run_success_pct", """
SELECT scraper_id, CASE WHEN products_scraped + reviews_scraped + rankings_scraped = 0 THEN 0.0
 ELSE round(100.0 * (products_scraped + reviews_scraped + rankings_scraped - errors_count)
   / (products_scraped + reviews_scraped + rankings_scraped), 2) END AS success_pct FROM scraper_runs""")
def num08(t):
    return t.scraper_runs.select("scraper_id", nm.run_success_pct().alias("success_pct"))


@query("num09_repair_prices", """
WITH a AS (SELECT product_id, platform,
  CASE WHEN platform IN ('amazon', 'reliancedigital', 'bigbasket', 'meesho') AND price IS NULL AND sale_price IS NOT NULL THEN sale_price ELSE price END AS p1,
  CASE WHEN platform = 'meesho' AND price IS NULL AND sale_price IS NOT NULL THEN NULL ELSE sale_price END AS s1 FROM products)
SELECT product_id, CASE WHEN platform = 'reliancedigital' AND s1 > p1 THEN s1 ELSE p1 END AS price_fixed,
 CASE WHEN platform = 'reliancedigital' AND s1 > p1 THEN p1 ELSE s1 END AS sale_fixed FROM a""")
def num09(t):
    p, s = nm.repair_prices()
    return t.products.select("product_id", p.alias("price_fixed"), s.alias("sale_fixed"))


# the first symbol of the whole text; where it has none, one that follows from the key
_SYM = "coalesce(nullif(regexp_extract(review_text, '([₹$£€¥₩])', 1), ''), CASE CAST(id % 7 AS INT) WHEN 0 THEN '₹' WHEN 1 THEN '$' WHEN 2 THEN ' £ ' WHEN 3 THEN '€' WHEN 4 THEN '¥' WHEN 5 THEN 'Rs' END)"
_CUR = f"CASE trim({_SYM}) " + " ".join(
    f"WHEN '{k}' THEN '{v}'" for k, v in nm.CURRENCY_MAP.items()) + f" ELSE trim({_SYM}) END"


@query("num10_currency_code", f"""
SELECT id, {_CUR} AS currency FROM reviews""")
def num10(t):
    return t.reviews.select("id", nm.currency_code(F.expr(_SYM)).alias("currency"))


_SESS = "SELECT keyword_id, min(created_at) AS started_at, max(created_at) AS completed_at FROM search_items GROUP BY keyword_id"


@query("dat01_duration_seconds", f"""
SELECT keyword_id, abs(epoch_us(completed_at) - epoch_us(started_at)) // 1000000 AS duration_seconds FROM ({_SESS}) x""")
def dat01(t):
    s = t.search_items.groupBy("keyword_id").agg(F.min("created_at").alias("started_at"),
                                                 F.max("created_at").alias("completed_at"))
    return s.select("keyword_id", dt.duration_seconds("started_at", "completed_at").alias("duration_seconds"))


@query("dat02_duration_label", """
SELECT id, CASE WHEN duration_seconds IS NULL OR duration_seconds = 0 THEN 'N/A'
 WHEN duration_seconds // 3600 > 0 THEN printf('%02d:%02d:%02d', duration_seconds // 3600, (duration_seconds % 3600) // 60, duration_seconds % 60)
 ELSE printf('%02d:%02d', (duration_seconds % 3600) // 60, duration_seconds % 60) END AS clock_label,
 CASE WHEN duration_seconds IS NULL OR duration_seconds = 0 THEN 'N/A'
 WHEN duration_seconds // 3600 > 0 THEN printf('%dh %dm %ds', duration_seconds // 3600, (duration_seconds % 3600) // 60, duration_seconds % 60)
 WHEN (duration_seconds % 3600) // 60 > 0 THEN printf('%dm %ds', (duration_seconds % 3600) // 60, duration_seconds % 60)
 ELSE printf('%ds', duration_seconds % 60) END AS units_label
FROM scraping_logs""")
def dat02(t):
    return t.scraping_logs.select("id", dt.duration_label("duration_seconds", "clock").alias("clock_label"),
                                  dt.duration_label("duration_seconds", "units").alias("units_label"))


@query("dat03_review_date", """
SELECT event_id, CASE event_id % 4 WHEN 0 THEN CAST(ts AS DATE) WHEN 1 THEN CAST(ts AS DATE)
 WHEN 2 THEN CAST(CAST((SELECT max(ts) FROM events) AS DATE) - CAST(event_id % 30 AS INT) AS DATE)
 ELSE CAST(date_trunc('month', ts) AS DATE) END AS review_date FROM events""")
def dat03(t):
    e = t.events
    text = (F.when(F.col("event_id") % 4 == 0, F.concat(F.lit("Reviewed in India on "), F.date_format("ts", "d MMMM yyyy")))
            .when(F.col("event_id") % 4 == 1, F.date_format("ts", "dd/MM/yyyy"))
            .when(F.col("event_id") % 4 == 2, F.concat((F.col("event_id") % 30).cast("string"), F.lit(" days ago")))
            .otherwise(F.date_format("ts", "MMM, yyyy")))
    return e.select("event_id", dt.review_date(text, latest(e, "ts")).alias("review_date"))


@query("dat04_release_date", """
SELECT event_id, CAST(ts AS DATE) AS release_date FROM events""")
def dat04(t):
    e = t.events
    text = (F.when(F.col("event_id") % 3 == 0, F.date_format("ts", "d MMMM yyyy"))
            .when(F.col("event_id") % 3 == 1, F.date_format("ts", "MMMM d, yyyy"))
            .otherwise(F.date_format("ts", "yyyy-MM-dd")))
    return e.select("event_id", dt.release_date(text).alias("release_date"))


@query("dat05_hours_since", """
SELECT id, (epoch_us((SELECT max(created_at) FROM scraping_logs)) - epoch_us(created_at)) // 3600000000 AS hours_since,
 (epoch_us((SELECT max(created_at) FROM scraping_logs)) - epoch_us(created_at)) // 3600000000 < 12 AS in_cooldown
FROM scraping_logs""")
def dat05(t):
    a = latest(t.scraping_logs, "created_at")
    return t.scraping_logs.select("id", dt.hours_since("created_at", a).alias("hours_since"),
                                  dt.within_cooldown("created_at", a, 12).alias("in_cooldown"))


@query("dat05b_elapsed_label", """
WITH s AS (SELECT id, created_at AS a, (SELECT max(created_at) FROM scraping_logs) AS b FROM scraping_logs),
m AS (SELECT id, (epoch_us(b) - epoch_us(a)) // 1000000 AS secs,
 (year(b) - year(a)) * 12 + month(b) - month(a) - CASE WHEN (day(b), CAST(b AS TIME)) < (day(a), CAST(a AS TIME)) THEN 1 ELSE 0 END AS months FROM s),
u AS (SELECT id, CASE WHEN months >= 12 THEN months // 12 WHEN months >= 1 THEN months WHEN secs >= 604800 THEN secs // 604800 WHEN secs >= 86400 THEN secs // 86400
  WHEN secs >= 3600 THEN secs // 3600 WHEN secs >= 60 THEN secs // 60 ELSE secs END AS n,
 CASE WHEN months >= 12 THEN 'year' WHEN months >= 1 THEN 'month' WHEN secs >= 604800 THEN 'week' WHEN secs >= 86400 THEN 'day'
  WHEN secs >= 3600 THEN 'hour' WHEN secs >= 60 THEN 'minute' ELSE 'second' END AS unit FROM m)
SELECT id, concat(CAST(n AS VARCHAR), ' ', unit, CASE WHEN n = 1 THEN '' ELSE 's' END, ' ago') AS last_run FROM u""")
def dat05b(t):
    return t.scraping_logs.select("id", dt.elapsed_label("created_at", latest(t.scraping_logs, "created_at")).alias("last_run"))


@query("arr01_sanitize_urls", f"""
SELECT id, CASE WHEN len(l) > 0 THEN array_to_string(l, ',') END AS image_urls FROM (
 SELECT id, list_filter(list_transform(CAST(json(review_images) AS VARCHAR[]),
   lambda u: CASE WHEN regexp_matches(CASE WHEN regexp_matches(trim(u), '^https?://') THEN trim(u) ELSE 'https://' || trim(u) END, '{_VALID}')
     THEN CASE WHEN regexp_matches(trim(u), '^https?://') THEN trim(u) ELSE 'https://' || trim(u) END END), lambda x: x IS NOT NULL) AS l
 FROM reviews WHERE review_images IS NOT NULL AND review_images <> 'null') x
UNION ALL SELECT id, NULL FROM reviews WHERE review_images IS NULL OR review_images = 'null'""")
def arr01(t):
    arr = ar.parse_json_list("review_images")
    return t.reviews.select("id", F.array_join(ar.sanitize_urls(arr), ",").alias("image_urls"))


def _arr02_sql() -> str:
    san_k = SAN_STR.format(x="e.key")
    san_v = SAN_STR.format(x="e.value")
    split = ("map_from_entries(list_transform(string_split_regex(props, '[,;|]'), "
             "lambda x, i: {'key': CAST(i - 1 AS VARCHAR), 'value': x}))")
    return f"""
WITH m AS (SELECT event_id, CASE WHEN starts_with(trim(props), '{{') AND TRY_CAST(json(props) AS MAP(VARCHAR, VARCHAR)) IS NOT NULL
   THEN TRY_CAST(json(props) AS MAP(VARCHAR, VARCHAR)) WHEN props IS NOT NULL THEN {split} END AS mp FROM events),
c AS (SELECT event_id, list_filter(list_transform(map_entries(mp), lambda e: {{'k': coalesce({san_k}, e.key), 'v': {san_v}}}),
   lambda e: e.v IS NOT NULL) AS kept FROM m),
l AS (SELECT event_id, list_filter(kept, lambda p, i: NOT list_bool_or(list_transform(kept, lambda q, j: q.k = p.k AND j > i))) AS last FROM c)
SELECT event_id, CASE WHEN len(last) > 0 THEN array_to_string(list_sort(list_transform(last, lambda p: p.k || '=' || p.v)), ';') END AS props_clean
FROM l"""


@query("arr02_sanitize_array", _arr02_sql())
def arr02(t):
    m = ar.sanitize_array(F.col("props"))
    return t.events.select("event_id", F.array_join(F.sort_array(F.transform(
        F.map_entries(m), lambda e: F.concat(e["key"], F.lit("="), e["value"]))), ";").alias("props_clean"))


# objects and lists within objects; what cleans to nothing is on every level
_NESTED = ("""concat('{"Title <i>":"  Lot <b>', CAST(event_id AS STRING), '</b> * ","specs":{"Ram#":"', CAST(user_id AS STRING), ' GB","gone":"<p></p>","parts":["one  ",', """
           """CASE WHEN event_id % 2 = 0 THEN '"",' ELSE '' END, '" two <u>', event_type, '</u>",null],"deep":[[{"x":["0",{"y":"', event_type, '"}]}]]},"flag":true,"off":false,"n":', CAST(event_id % 3 AS STRING), '}')""")


@query("arr02b_sanitize_nested", """
SELECT event_id, '{"Title":"Lot ' || event_id || ' ","specs":{"Ram":"' || user_id || ' GB","parts":' ||
 CASE WHEN event_id % 2 = 0 THEN '{"0":"one","2":"two ' || event_type || '"}' ELSE '["one","two ' || event_type || '"]' END ||
 ',"deep":[[{"x":{"1":{"y":"' || event_type || '"}}}]]},"flag":"1"' || CASE WHEN event_id % 3 > 0 THEN ',"n":"' || (event_id % 3) || '"' ELSE '' END || '}' AS props_clean
FROM events""")
def arr02b(t):
    return t.events.select("event_id", ar.sanitize_nested(F.expr(_NESTED)).alias("props_clean"))


@query("arr03_first_distinct", """
SELECT product_id, array_to_string(list_slice(list_filter(w, lambda x, i: list_position(w, x) = i), 1, 2), ' ') AS first_words
FROM (SELECT product_id, string_split(title, ' ') AS w FROM products) x""")
def arr03(t):
    return t.products.select("product_id", F.array_join(ar.first_distinct(F.split("title", " "), 2), " ")
                             .alias("first_words"))


@query("arr04_join_list", """
SELECT product_id, array_to_string(string_split(title, ' '), ' | ') AS title_joined FROM products""")
def arr04(t):
    return t.products.select("product_id", ar.join_list(F.split("title", " "), "flipkart").alias("title_joined"))


@query("arr05_primary_image", """
SELECT id, CASE WHEN review_images IS NULL OR review_images = 'null' THEN NULL
 ELSE CAST(json(review_images) AS VARCHAR[])[1] END AS primary_image FROM reviews""")
def arr05(t):
    return t.reviews.select("id", ar.primary_image(ar.parse_json_list("review_images")).alias("primary_image"))


@query("jsn01_parse_json", """
SELECT id, CASE WHEN review_images IS NULL OR review_images = 'null' THEN NULL ELSE CAST(json_array_length(review_images) AS INTEGER) END AS image_count
FROM reviews""")
def jsn01(t):
    return t.reviews.select("id", F.size(ar.parse_json_list("review_images")).alias("image_count"))


_CID = "CASE platform " + " ".join(f"WHEN '{k}' THEN '{p}' || left(md5(review_text), {n})"
                                   for k, (p, n) in hs.CONTENT_ID.items()) + " END"


@query("hsh01_content_id", f"""
SELECT id, {_CID} AS content_review_id FROM reviews""")
def hsh01(t):
    return t.reviews.select("id", hs.content_id_for("review_text", "platform").alias("content_review_id"))


@query("hsh02_reviewer_id", """
SELECT id, 'FD_' || regexp_replace(CASE WHEN lower(trim(reviewer_name)) IS NULL OR lower(trim(reviewer_name)) IN ('', '0') THEN 'anonymous'
 ELSE lower(trim(reviewer_name)) END, '[^a-z0-9]+', '-', 'gi') || '_' || strftime(CAST((SELECT max(ts) FROM events) AS DATE), '%Y%m%d') AS reviewer_review_id
FROM reviews""")
def hsh02(t):
    return t.reviews.select("id", hs.reviewer_id("reviewer_name", F.lit(None).cast("date"), latest(t.events, "ts"))
                            .alias("reviewer_review_id"))


@query("hsh03_review_hash", """
SELECT id, md5(encode(coalesce(sku, '') || coalesce(reviewer_name, '') || coalesce(CAST(rating AS VARCHAR), ''))
 || encode(coalesce(review_text, ''))[1:50]) AS review_hash FROM reviews""")
def hsh03(t):
    return t.reviews.select("id", hs.review_hash("sku", "reviewer_name", "rating", "review_text").alias("review_hash"))


# product texts that name their memory in several ways, or not at all
_SPEC_TEXT = "CASE review_count % 4 WHEN 0 THEN concat(title, ' ', CAST(review_count AS STRING), 'GB RAM, fast') WHEN 1 THEN concat(title, ' with ', CAST(review_count AS STRING), '  gb Memory') WHEN 2 THEN concat(title, ' 512 GB disk') END"


@query("ext01_specs_from_text", f"""
SELECT product_id, CASE WHEN regexp_extract(x, '(?i)(\\d+)\\s*GB\\s*(RAM|Memory)', 1) <> ''
 THEN regexp_extract(x, '(?i)(\\d+)\\s*GB\\s*(RAM|Memory)', 1) || 'GB' END AS ram FROM (SELECT product_id, {_SPEC_TEXT} AS x FROM products) y""")
def ext01(t):
    return t.products.select("product_id", hs.specs_from_text(F.expr(_SPEC_TEXT)).alias("ram"))
