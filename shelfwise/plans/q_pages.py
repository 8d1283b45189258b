"""Catalogue entries for §2.10 page jobs, run over every page of the driver's ``pages`` table.

The driver pages carry titles, nav links, ad blocks and articles; the view
``shop_pages`` appends each platform's own markup (prices, JSON-LD, cards, reviews), whose
values follow from the page's key.  What the page reader yields (PAG1b, 3b, 5, 6, 15, 19, 21,
28) is compared with those values themselves; the other twins read the markup with
expressions of their own engine.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfwise.functions import text as tx
from shelfwise.operators import page_reader as rd
from shelfwise.operators import pages as pg
from shelfwise.plans.catalog import query
from shelfwise.sources.views import LIST, SALE, _PLATFORM_OF

_PLAT = _PLATFORM_OF.format(k="page_id")


def _pages(t):
    return t.shop_pages.select("page_id", "url", "html", F.expr(_PLAT).alias("platform"))


@query("pag01_product_links", """
WITH l AS (SELECT page_id, list_transform(regexp_extract_all(html, 'href="([^"]+)"', 1),
   lambda h: CASE WHEN starts_with(h, 'http') THEN h ELSE regexp_extract(url, '^(https?://[^/?#]+)', 1) || h END) AS a FROM shop_pages),
d AS (SELECT page_id, list_filter(a, lambda x, i: list_position(a, x) = i) AS links FROM l)
SELECT page_id, CAST(generate_subscripts(links, 1) AS INT) AS ordinal, unnest(links) AS link FROM d""")
def pag01(t):
    return pg.product_links(t.shop_pages, path_pattern=None)


def _by_platform(cases: dict[str, str], other: str = "NULL") -> str:
    return "CASE platform " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in cases.items()) + f" ELSE {other} END"


_ID = "CAST(page_id AS VARCHAR)"
_ASIN = f"lpad({_ID}, 9, '0')"
# the links of the first and of the second card (an ad) by platform
_LINK = {"amazon": (f"'https://www.amazon.in/dp/B' || {_ASIN}", "NULL"),
         "flipkart": (f"'https://www.flipkart.com/thing/p/itm' || {_ID} || 'A?fm=organic'", f"'https://www.flipkart.com/thing/p/itm' || {_ID} || 'B?fm=search'"),
         "vijaysales": (f"'https://www.vijaysales.com/p/' || {_ID}", "NULL"),
         "reliancedigital": (f"'https://www.reliancedigital.in/x/p/R' || {_ID} || 'A'", f"'https://www.reliancedigital.in/x/p/R' || {_ID} || 'B'"),
         **{p: (f"'{site}' || {_ID} || '1{tail}'", f"'{site}' || {_ID} || '2{tail}'") for p, site, tail in (
             ("croma", "https://www.croma.com/x/p/", ""), ("bigbasket", "https://www.bigbasket.com/pd/", "/x"), ("meesho", "https://www.meesho.com/x/p/", ""))}}


@query("pag01b_platform_links", f"""
WITH p AS (SELECT page_id, {_PLAT} AS platform FROM pages),
l AS (SELECT page_id, 1 AS ordinal, {_by_platform({k: v[0] for k, v in _LINK.items()})} AS link FROM p
  UNION ALL SELECT page_id, 2, {_by_platform({k: v[1] for k, v in _LINK.items()})} FROM p WHERE page_id % 3 <> 0)
SELECT page_id, CAST(ordinal AS INT) AS ordinal, link FROM l WHERE link IS NOT NULL""")
def pag01b(t):
    return rd.product_links(_pages(t))


def _pag02_sql() -> str:
    slug = "regexp_replace(regexp_replace(lower(name), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g')"
    return f"""
WITH m AS (SELECT page_id, string_split(regexp_replace(html, '(<div tabindex="0" role="button")', chr(1) || '\\1', 'g'), chr(1)) AS parts FROM shop_pages),
c AS (SELECT page_id, unnest(list_slice(parts, 2, len(parts))) AS card, generate_subscripts(list_slice(parts, 2, len(parts)), 1) AS i FROM m),
v AS (SELECT page_id, i, regexp_extract(card, '^<div[^>]*id="([^"]+)"', 1) AS id,
  replace(regexp_extract(card, 'tw-line-clamp-2">([^<]*)<', 1), '&amp;', '&') AS name FROM c),
l AS (SELECT page_id, min(i) AS i, 'https://blinkit.com/prn/' || {slug} || '/prid/' || id AS link FROM v
  WHERE id <> '' AND name <> '' GROUP BY ALL)
SELECT page_id, CAST(row_number() OVER (PARTITION BY page_id ORDER BY i) AS INT) AS ordinal, link FROM l"""


@query("pag02_card_links", _pag02_sql())
def pag02(t):
    return pg.card_links(t.shop_pages)


def _txt(x: str) -> str:
    inner = f"trim(regexp_replace(regexp_replace(CASE WHEN {x} IN ('', '0') THEN NULL ELSE {x} END, '<[^>]*>', '', 'g'), '\\s+', ' ', 'g'))"
    for ent, ch in (("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&nbsp;", " ")):
        inner = f"replace({inner}, '{ent}', '{ch}')"
    return f"nullif(trim({inner}), '')"


_TITLE_RX = ["(?is)<h1\\b[^>]*>(.*?)</h1", "(?is)<title\\b[^>]*>(.*?)</title",
             '(?is)<meta\\b[^>]*\\b(?:name|property)="og:title"[^>]*\\bcontent="([^"]*)"',
             '(?is)<meta\\b[^>]*\\b(?:name|property)="title"[^>]*\\bcontent="([^"]*)"']


@query("pag03_title_cascade", "SELECT page_id, coalesce(" + ", ".join(
    f"CASE WHEN length({_txt(f'regexp_extract(html, {chr(39)}{r}{chr(39)}, 1)')}) > 3 "
    f"THEN {_txt(f'regexp_extract(html, {chr(39)}{r}{chr(39)}, 1)')} END" for r in _TITLE_RX) + ") AS title FROM shop_pages")
def pag03(t):
    return t.shop_pages.select("page_id", pg.cascade("html", pg.TITLE_RULES, 3).alias("title"))


def _price_sql(x: str) -> str:
    c = f"replace(regexp_replace({x}, '[^0-9.,]', '', 'g'), ',', '')"
    return f"CASE WHEN regexp_matches({c}, '^[0-9]*\\.?[0-9]+$|^[0-9]+\\.$') THEN TRY_CAST({c} AS DOUBLE) END"


def _pag04_sql() -> str:
    j = "json_extract_string(ld, '{}')"
    rating_raw = f"TRY_CAST(nullif(regexp_extract({j.format('$.aggregateRating.ratingValue')}, '([0-9]+\\.?[0-9]*)', 1), '') AS DOUBLE)"
    count_raw = (f"coalesce({j.format('$.aggregateRating.reviewCount')}, {j.format('$.aggregateRating.ratingCount')})")
    img = j.format("$.image")
    return f"""
WITH b AS (SELECT page_id, list_filter(regexp_extract_all(html, '(?is)<script\\b[^>]*type="application/ld\\+json"[^>]*>(.*?)</script>', 1),
   lambda x: json_valid(x)) AS bs FROM shop_pages),
n AS (SELECT page_id, flatten(list_transform(bs, lambda x: CASE WHEN json_extract(x, '$."@graph"') IS NOT NULL
   THEN CAST(json_extract(x, '$."@graph"') AS JSON[]) WHEN json_type(x) = 'ARRAY' THEN CAST(CAST(x AS JSON) AS JSON[])
   ELSE [CAST(x AS JSON)] END)) AS nodes FROM b),
p AS (SELECT page_id, list_filter(nodes, lambda x: json_extract_string(x, '$."@type"') = 'Product')[1] AS ld FROM n)
SELECT page_id, {j.format('$.name')} AS title, {j.format('$.description')} AS description,
 coalesce({j.format('$.brand.name')}, CASE WHEN NOT starts_with(coalesce({j.format('$.brand')}, ''), '{{') THEN {j.format('$.brand')} END) AS brand,
 CASE WHEN starts_with({img}, '[') THEN array_to_string(CAST(json({img}) AS VARCHAR[]), ' ') ELSE {img} END AS image_urls,
 {_price_sql("coalesce(" + j.format('$.offers.price') + ", " + j.format('$.offers[0].price') + ", " + j.format('$.offers.lowPrice') + ")")} AS sale_price,
 {_price_sql(j.format('$.offers.highPrice'))} AS list_price,
 CASE WHEN {rating_raw} BETWEEN 0 AND 5 THEN {rating_raw} END AS rating,
 coalesce(TRY_CAST(nullif(regexp_extract(replace({count_raw}, ',', ''), '([0-9]+)', 1), '') AS BIGINT), 0) AS review_count
FROM p WHERE ld IS NOT NULL"""


@query("pag04_jsonld_product", _pag04_sql())
def pag04(t):
    return pg.jsonld_product(t.shop_pages).withColumn("image_urls", F.array_join("image_urls", " "))


_LD_FIRST = "platform IN ('croma', 'reliancedigital', 'bigbasket', 'blinkit')"


@query("pag06_price_pair", f"""
WITH v AS (SELECT page_id, {_PLAT} AS platform, {SALE} AS sale, CASE WHEN page_id % 3 < 2 THEN {SALE} + 1 END AS ld_sale,
  CASE WHEN page_id % 5 <> 0 THEN {LIST} END AS list, CASE WHEN page_id % 3 = 1 THEN {LIST} + 1 END AS ld_list FROM pages),
w AS (SELECT page_id, platform, CASE WHEN {_LD_FIRST} THEN coalesce(ld_sale, sale) ELSE sale END AS s,
  CASE WHEN {_LD_FIRST} THEN coalesce(ld_list, list) ELSE coalesce(list, ld_list) END AS l FROM v),
f AS (SELECT page_id, platform, CASE WHEN l IS NULL AND platform IN ('amazon', 'reliancedigital', 'bigbasket', 'meesho') THEN s ELSE l END AS l,
  CASE WHEN l IS NULL AND platform = 'meesho' THEN NULL ELSE s END AS s FROM w)
SELECT page_id, CAST(CASE WHEN platform = 'reliancedigital' AND s > l THEN s ELSE l END AS DOUBLE) AS list_price,
 CAST(CASE WHEN platform = 'reliancedigital' AND s > l THEN l ELSE s END AS DOUBLE) AS sale_price FROM f""")
def pag06(t):
    return rd.with_price_pair(_pages(t))


_H1 = _txt("regexp_extract(html, '(?is)<h1\\b[^>]*>(.*?)</h1', 1)")
_STOCK = _by_platform({"blinkit": "CASE WHEN page_id % 7 <> 0 THEN 'In Stock' ELSE 'Out of Stock' END",
                       "vijaysales": "CASE WHEN page_id % 21 = 0 THEN 'Out of Stock' ELSE 'In Stock' END",
                       **{p: f"CASE WHEN page_id % 7 <> 0 THEN 'Only ' || CAST(page_id % 9 + 1 AS VARCHAR) || ' left in stock' ELSE '{d}' END" for p, d in (
                           ("amazon", "Unknown"), ("flipkart", "In Stock"), ("reliancedigital", "Available"), ("croma", "Available"),
                           ("bigbasket", "Unknown"), ("meesho", "In Stock"))}})
_SELLER = "CASE WHEN platform IN ('amazon', 'flipkart', 'reliancedigital', 'meesho') THEN 'Shop ' || CAST(page_id % 17 AS VARCHAR) END"


@query("pag03b_platform_title", f"""
SELECT page_id, CASE WHEN platform = 'blinkit' THEN {_H1} ELSE 'Item ' || CAST(page_id % 101 AS VARCHAR) || ' of the shelf' END AS title
FROM (SELECT page_id, html, {_PLAT} AS platform FROM pages) x""")
def pag03b(t):
    return rd.with_page(_pages(t), "fields").select("page_id", rd.value("title").alias("title"))


@query("pag05_page_products", f"""
WITH x AS (SELECT page_id, {_PLAT} AS platform, {_H1} AS h1, page_id % 3 AS k, {SALE} AS sale, {LIST} AS list FROM pages),
y AS (SELECT *, {_LD_FIRST} AS ld_first, CASE WHEN k < 2 THEN sale + 1 END AS ld_sale, CASE WHEN k = 1 THEN list + 1 END AS ld_list,
  CASE WHEN page_id % 5 <> 0 THEN list END AS m_list, CASE WHEN platform = 'blinkit' THEN regexp_replace(h1, '{tx.NOT_ALLOWED}', '', 'g') ELSE 'Item ' || (page_id % 101) || ' of the shelf' END AS m_title,
  CASE k WHEN 0 THEN 'Ld item ' || (page_id % 97) WHEN 1 THEN 'Graph item ' || (page_id % 97) END AS ld_title FROM x),
z AS (SELECT *, CASE WHEN ld_first THEN coalesce(ld_sale, sale) ELSE sale END AS s,
  CASE WHEN ld_first THEN coalesce(ld_list, m_list) ELSE coalesce(m_list, ld_list) END AS l FROM y),
f AS (SELECT *, CASE WHEN l IS NULL AND platform IN ('amazon', 'reliancedigital', 'bigbasket', 'meesho') THEN s ELSE l END AS l2,
  CASE WHEN l IS NULL AND platform = 'meesho' THEN NULL ELSE s END AS s2 FROM z)
SELECT page_id, platform, CASE WHEN ld_first THEN coalesce(ld_title, m_title) ELSE m_title END AS title,
 CASE WHEN ld_first AND k < 2 THEN 'Maker ' || (page_id % 7) ELSE 'Maker ' || (page_id % 11) END AS brand,
 CAST(coalesce(CASE WHEN platform = 'reliancedigital' AND s2 > l2 THEN s2 ELSE l2 END, ld_sale) AS DOUBLE) AS price,
 CAST(CASE WHEN platform = 'reliancedigital' AND s2 > l2 THEN l2 ELSE s2 END AS DOUBLE) AS sale_price,
 CAST(CASE WHEN ld_first AND k = 1 THEN 3 ELSE 4 END + (page_id % 10) / 10 AS DOUBLE) AS rating,
 CAST(CASE WHEN ld_first AND k = 0 THEN page_id % 500 WHEN ld_first AND k = 1 THEN page_id % 300 ELSE page_id % 700 + 1 END AS BIGINT) AS review_count,
 {_STOCK} AS inventory_status, {_SELLER} AS seller_name,
 CASE WHEN platform = 'amazon' THEN '-' || (page_id % 60 + 1) || '%' ELSE (page_id % 60 + 1) || '% off' END AS offers,
 CASE WHEN platform = 'blinkit' THEN 'M' || (page_id % 53) END AS model_name,
 CASE platform WHEN 'amazon' THEN 'Shelf ' || (page_id % 12) || ', All' WHEN 'flipkart' THEN 'Shelf ' || (page_id % 12) || ', All'
  WHEN 'reliancedigital' THEN 'Shelf ' || (page_id % 12) || ' ,All' WHEN 'croma' THEN 'Shelf ' || (page_id % 12) || ' , All'
  WHEN 'bigbasket' THEN 'Shelf ' || (page_id % 12) || '  All' WHEN 'meesho' THEN 'All' END AS category,
 CASE WHEN platform = 'amazon' THEN 'Sixteen GB of memory, lot ' || (page_id % 31) END AS highlights, 'INR' AS currency_code
FROM f""")
def pag05(t):
    d = rd.page_products(_pages(t))
    return d.select("page_id", "platform", "title", "brand", *[F.col(c).cast("double").alias(c) for c in ("price", "sale_price", "rating")],
                    F.col("review_count").cast("bigint").alias("review_count"), "inventory_status", "seller_name", "offers", "model_name", "category",
                    "highlights", "currency_code")





def _spec_entries_sql() -> str:
    """DuckDB twin of ``spec_map``'s entry list (cleaned, blanks dropped, later duplicate wins)."""
    k = _txt(f"regexp_extract(r, '{pg.SPEC_ROW}', 1)")
    v = _txt(f"regexp_extract(r, '{pg.SPEC_ROW}', 2)")
    return f"""
s0 AS (SELECT page_id, html, {_PLAT} AS platform, list_filter(list_transform(regexp_extract_all(html, '{pg.SPEC_ROW}', 0),
   lambda r: {{'k': {k}, 'v': {v}}}), lambda e: e.k IS NOT NULL AND e.v IS NOT NULL) AS kept FROM shop_pages),
s1 AS (SELECT page_id, html, platform, list_filter(kept, lambda p, i: NOT list_bool_or(list_transform(kept,
   lambda q, j: q.k = p.k AND j > i))) AS specs FROM s0)"""


def _named_sql(label: str) -> str:
    return f"list_filter(specs, lambda e: regexp_matches(e.k, '(?i){label}'))[1].v"


def _pag07_sql() -> str:
    return """
WITH x AS (SELECT page_id,
  regexp_extract_all(regexp_extract(html, '(?is)<table\\b[^>]*id="histogramTable".*?</table>', 0), '(\\d+(?:\\.\\d+)?)\\s*%', 1) AS texts,
  regexp_extract_all(html, '(?i)width:\\s*(\\d+(?:\\.\\d+)?)%', 1) AS widths,
  list_transform(regexp_extract_all(html, '(?is)class="[^"]*\\bstar-count\\b[^"]*"[^>]*>\\s*([\\d,]+)\\s*<', 1),
    lambda c: CAST(replace(c, ',', '') AS DOUBLE)) AS nums FROM shop_pages),
y AS (SELECT *, list_sum(nums) AS total FROM x),
z AS (SELECT page_id, CASE WHEN len(texts) >= 5 THEN list_slice(texts, len(texts) - 4, len(texts))
  WHEN len(widths) >= 5 THEN list_slice(widths, 1, 5)
  WHEN len(nums) >= 5 AND total > 0 THEN list_slice(list_transform(nums, lambda n: CAST(round(n * 100.0 / total, 2) AS VARCHAR)), 1, 5)
  END AS pick FROM y)
SELECT page_id, array_to_string(list_transform(pick, lambda v: CAST(CAST(CAST(v AS DOUBLE) AS DECIMAL(5,2)) AS VARCHAR)), ',') AS star_percents
FROM z"""


@query("pag07_star_histogram", _pag07_sql())
def pag07(t):
    h = pg.star_histogram("html")
    return t.shop_pages.select("page_id", F.array_join(F.transform(h, lambda x: x.cast("string")), ",").alias("star_percents"))


@query("pag08_spec_map", f"""
WITH {_spec_entries_sql()}
SELECT page_id, array_to_string(list_sort(list_transform(specs, lambda e: e.k || '=' || e.v)), ';') AS specs FROM s1""")
def pag08(t):
    m = pg.spec_map("html")
    return t.shop_pages.select("page_id", F.array_join(F.sort_array(F.transform(
        F.map_entries(m), lambda e: F.concat(e["key"], F.lit("="), e["value"]))), ";").alias("specs"))


@query("pag09_named_attr", f"""
WITH {_spec_entries_sql()}
SELECT page_id, {_named_sql('^brand')} AS brand, {_named_sql('^model')} AS model_name, {_named_sql('^colou?r')} AS color,
 {_named_sql('weight')} AS weight, {_named_sql('^manufacturer')} AS manufacturer
FROM s1""")
def pag09(t):
    labels = {"brand": "^brand", "model_name": "^model", "color": "^colou?r", "weight": "weight", "manufacturer": "^manufacturer"}
    return t.shop_pages.select("page_id", pg.named_attrs(pg.spec_map("html"), labels).alias("a")).select("page_id", *[f"a.{n}" for n in labels])


@query("pag10_dimensions", f"""
WITH {_spec_entries_sql()}
SELECT page_id, nullif(CASE WHEN platform = 'flipkart'
 THEN concat_ws(' x ', {_named_sql('^width')}, {_named_sql('^depth')}, {_named_sql('^height')})
 ELSE concat_ws(' x ', {_named_sql('^length')}, {_named_sql('^width')}, {_named_sql('^height')}) END, '') AS dimensions
FROM s1""")
def pag10(t):
    p = _pages(t)
    return p.select("page_id", pg.dimensions(pg.spec_map("html"), F.col("platform")).alias("dimensions"))


def _pag11_sql() -> str:
    items = ("list_filter(list_transform(regexp_extract_all(html, '(?is)<(?:li|a)\\b[^>]*class=\"[^\"]*\\bbreadcrumb[^\"]*\"[^>]*>(.*?)</', 1), "
             f"lambda x: {_txt('x')}), lambda y: y IS NOT NULL)")
    return f"""
WITH b AS (SELECT page_id, platform, {items} AS it FROM (SELECT page_id, html, {_PLAT} AS platform FROM shop_pages) p),
c AS (SELECT page_id, CASE WHEN platform = 'amazon' THEN list_filter(it, lambda x, i: list_position(it, x) = i)
   WHEN platform = 'flipkart' AND lower(it[1]) = 'home' THEN list_slice(it, 2, len(it)) ELSE it END AS it FROM b)
SELECT page_id, nullif(array_to_string(it, ' > '), '') AS category FROM c"""


@query("pag11_breadcrumb", _pag11_sql())
def pag11(t):
    p = _pages(t)
    return p.select("page_id", pg.breadcrumb("html", F.col("platform")).alias("category"))


def _pag12_sql() -> str:
    def attr(n):
        return f"nullif(regexp_extract(g, '(?is)\\b{n}=\"([^\"]*)\"', 1), '')"
    first = (f"coalesce({attr('data-old-hires')}, {attr('data-a-hires')}, {attr('data-src')}, "
             f"nullif(trim(split_part(coalesce({attr('srcset')}, ''), ' ', 1)), ''), {attr('src')})")
    return f"""
WITH u AS (SELECT page_id, list_filter(list_transform(regexp_extract_all(html, '(?is)<img\\b[^>]*>', 0), lambda g: {first}),
   lambda x: regexp_matches(x, '^https?://')) AS l FROM shop_pages)
SELECT page_id, array_to_string(list_filter(l, lambda x, i: list_position(l, x) = i), ' ') AS image_urls FROM u"""


@query("pag12_image_urls", _pag12_sql())
def pag12(t):
    return t.shop_pages.select("page_id", F.array_join(pg.image_urls("html"), " ").alias("image_urls"))


def _pag13_sql() -> str:
    return """
WITH v AS (SELECT page_id, regexp_extract_all(html, '(?i)(https?://[^"\\s]+\\.(?:mp4|m3u8|webm))', 1) AS direct,
  regexp_extract_all(html, '(?i)(?:i\\.ytimg\\.com/vi/|youtube\\.com/embed/)([A-Za-z0-9_\\-]{11})', 1) AS ids FROM shop_pages),
d AS (SELECT page_id, direct, list_filter(ids, lambda x, i: list_position(ids, x) = i) AS ids FROM v),
m AS (SELECT page_id, list_concat(direct, flatten(list_transform(ids, lambda i: ['https://www.youtube.com/watch?v=' || i,
  'https://www.youtube.com/embed/' || i]))) AS l FROM d)
SELECT page_id, array_to_string(list_filter(l, lambda x, i: list_position(l, x) = i), ' ') AS video_urls FROM m"""


@query("pag13_video_urls", _pag13_sql())
def pag13(t):
    return t.shop_pages.select("page_id", F.array_join(pg.video_urls("html"), " ").alias("video_urls"))


def _pag14_sql() -> str:
    li = '(?is)<li\\b[^>]*data-(?:defaultasin|asin)="[A-Z0-9]+"[^>]*>.*?</li>'
    name = "coalesce(nullif(regexp_extract(v, '(?is)\\btitle=\"([^\"]*)\"', 1), ''), '')"
    img = "coalesce(nullif(regexp_extract(v, '(?is)<img\\b[^>]*\\bsrc=\"([^\"]*)\"', 1), ''), '')"
    asin = "regexp_extract(v, 'data-(?:defaultasin|asin)=\"([A-Z0-9]+)\"', 1)"
    return (f"SELECT page_id, array_to_string(list_transform(regexp_extract_all(html, '{li}', 0), "
            f"lambda v: {name} || '|' || {img} || '|' || {asin}), ';') AS variants FROM shop_pages")


@query("pag14_variants", _pag14_sql())
def pag14(t):
    v = pg.variants("html")
    return t.shop_pages.select("page_id", F.array_join(F.transform(v, lambda e: F.concat_ws(
        "|", F.coalesce(e["name"], F.lit("")), F.coalesce(e["image"], F.lit("")), e["asin"])), ";").alias("variants"))


@query("pag15_availability", f"SELECT page_id, platform, {_STOCK} AS inventory_status FROM (SELECT page_id, {_PLAT} AS platform FROM pages) x")
def pag15(t):
    return rd.with_page(_pages(t), "fields").select("page_id", "platform", rd.availability().alias("inventory_status"))


_OFFER_RX = '(?is)class="[^"]*\\b(?:savingsPercentage|offer[^"]*)\\b[^"]*"[^>]*>(.*?)</'


@query("pag16_offers", f"""
WITH b AS (SELECT page_id, flatten(list_transform(regexp_extract_all(html, '{_OFFER_RX}', 1),
   lambda x: regexp_extract_all(x, '(\\d+\\s?%)', 1))) AS p FROM shop_pages)
SELECT page_id, nullif(array_to_string(list_filter(p, lambda x, i: list_position(p, x) = i), '; '), '') AS offers FROM b""")
def pag16(t):
    return t.shop_pages.select("page_id", pg.offers("html").alias("offers"))


def _pag17_sql() -> str:
    blk = _txt("regexp_extract(html, '(?is)class=\"[^\"]*\\bdelivery[^\"]*\"[^>]*>(.*?)</div>', 1)")
    price = (f"CASE WHEN contains(lower({blk}), 'free') THEN 'Free' "
             f"ELSE nullif(regexp_extract({blk}, '(₹\\s?[\\d,]+(?:\\.\\d+)?)', 1), '') END")
    by = ("'(?i)\\bby\\s+([A-Za-z]{3,9},?\\s+[A-Za-z]{3,9}\\s+\\d{1,2}|[A-Za-z]{3,9}\\s+\\d{1,2})'")
    date = (f"coalesce(nullif(regexp_extract({blk}, {by}, 1), ''), "
            f"nullif(regexp_extract({blk}, '(?i)\\b(in\\s+\\d+\\s+days?)', 1), ''))")
    return f"SELECT page_id, {price} AS delivery_price, {date} AS delivery_date FROM shop_pages"


@query("pag17_delivery", _pag17_sql())
def pag17(t):
    price, date = pg.delivery("html")
    return t.shop_pages.select("page_id", price.alias("delivery_price"), date.alias("delivery_date"))


@query("pag18_badges_and_rank", """
SELECT page_id, CAST(page_id % 900 + 1 AS INT) AS best_seller_rank, page_id % 2 = 0 AS amazon_choice, page_id % 3 = 0 AS bestseller,
 'Sixteen GB of memory, lot ' || (page_id % 31) || '. A second list of points' AS highlights,
 'Buyers like the screen of lot ' || (page_id % 31) || '.' AS customers_say,
 'Deal ends in ' || (page_id % 48) || ' hours' AS countdown FROM pages""")
def pag18(t):
    f = pg.badges_and_rank("html")
    return t.shop_pages.select("page_id", *[v.alias(k) for k, v in f.items()])


# (sku, title) of the first card, sku of the second one
_CARD = {"amazon": (f"'B' || {_ASIN}", f"'C' || {_ASIN}"), "flipkart": (f"'itm' || {_ID} || 'A'", f"'itm' || {_ID} || 'B'"),
         "vijaysales": (f"'V' || {_ID} || 'A'", f"'second-' || {_ID}"), "reliancedigital": (f"'R' || {_ID} || 'A'", f"'R' || {_ID} || 'B'")}


@query("pag19_search_items", f"""
WITH p AS (SELECT page_id, {_PLAT} AS platform FROM pages),
b AS (SELECT page_id, platform, 1 AS n, CAST(page_id % 400 + 100 AS VARCHAR) AS sku, 'Milk & Bread ' || (page_id % 25) || '!' AS title, false AS is_sponsored FROM p
  UNION ALL SELECT page_id, platform, 2, '7', NULL, false FROM p UNION ALL SELECT page_id, platform, 3, '9', 'Rice', false FROM p),
c AS (SELECT page_id, platform, 4 AS n, {_by_platform({k: v[0] for k, v in _CARD.items()}, f"{_ID} || '1'")} AS sku, 'Card no ' || (page_id % 77) AS title, false AS is_sponsored FROM p
  UNION ALL SELECT page_id, platform, 5, {_by_platform({k: v[1] for k, v in _CARD.items()}, f"{_ID} || '2'")}, 'Second', platform NOT IN ('vijaysales', 'blinkit') FROM p WHERE page_id % 3 <> 0)
SELECT page_id, platform, CAST(CASE WHEN platform = 'blinkit' THEN n ELSE n - 3 END AS INT) AS ordinal, sku, title, is_sponsored
FROM (SELECT * FROM c UNION ALL SELECT * FROM b WHERE platform = 'blinkit') u""")
def pag19(t):
    return rd.search_items(_pages(t))


def _pag20_sql() -> str:
    markers = " OR ".join(f"regexp_matches(c, '(?i){m}')" for m in pg.SPONSORED_MARKERS)
    return f"""
WITH b AS (SELECT page_id, string_split_regex(html, '<div\\b') AS parts FROM shop_pages),
x AS (SELECT page_id, list_slice(parts, 2, len(parts)) AS blocks FROM b)
SELECT page_id, CAST(len(blocks) AS INT) AS blocks, CAST(len(list_filter(blocks, lambda c:
  (regexp_matches(c, '(?i){pg.AD_URL_FLAG}') AND NOT regexp_matches(c, '(?i){pg.ORGANIC_URL_FLAG}'))
  OR {markers})) AS INT) AS sponsored_blocks FROM x"""


@query("pag20_is_sponsored", _pag20_sql())
def pag20(t):
    blocks = pg._blocks(F.col("html"), r"<div\b")
    return t.shop_pages.select("page_id", F.size(blocks).cast("int").alias("blocks"),
                          F.size(F.filter(blocks, lambda c: pg.is_sponsored(c))).cast("int").alias("sponsored_blocks"))


@query("pag21_page_reviews", f"""
WITH p AS (SELECT page_id, {_PLAT} AS platform, CAST(page_id % 5 + 1 AS INT) AS score, 'User ' || (page_id % 19) AS who, 'Title ' || (page_id % 23) AS head,
  'Good screen and keys of lot ' || (page_id % 31) || '.' AS say, page_id % 28 + 1 AS d FROM pages),
r AS (SELECT *, CASE platform WHEN 'reliancedigital' THEN 2 WHEN 'bigbasket' THEN 3 ELSE score END AS r FROM p WHERE platform <> 'blinkit')
SELECT page_id, platform, 1 AS ordinal, {_by_platform({
    "amazon": f"'RV' || {_ID} || 'A'", "flipkart": f"'RV' || {_ID} || 'A'", "croma": f"'CROMA_RV' || {_ID} || 'A'", "reliancedigital": f"'RD_RV' || {_ID} || 'A'",
    "bigbasket": f"'BB_RV' || {_ID} || 'A'", "vijaysales": "'VS_' || left(md5(who || score || ' of 5' || head || say || d || '/01/2024'), 16)"})} AS review_id,
 who AS reviewer_name, CAST(r AS DECIMAL(3,2)) AS rating, head AS review_title, say AS review_text,
 CASE WHEN platform = 'flipkart' THEN make_date(2024, 1, 1) ELSE make_date(2024, 1, d) END AS review_date, platform <> 'vijaysales' AS verified_purchase,
 CAST(CASE WHEN platform = 'vijaysales' THEN 0 ELSE page_id % 40 + 2 END AS INT) AS helpful_count,
 CASE WHEN platform = 'amazon' THEN 'Colour: Shade ' || (page_id % 9) END AS variant_info,
 CASE WHEN r >= 4 THEN 'positive' WHEN r >= 3 THEN 'neutral' ELSE 'negative' END AS sentiment FROM r
UNION ALL
SELECT page_id, platform, 2, 'RV' || {_ID} || 'B', 'Silent', NULL, NULL, NULL, NULL, false, 0, NULL, NULL
FROM p WHERE page_id % 5 = 1 AND platform IN ('amazon', 'flipkart')""")
def pag21(t):
    from shelfwise.operators.common import latest
    return rd.page_reviews(_pages(t), asof=latest(t.events, "ts"))


def _pag22_sql() -> str:
    from shelfwise.functions.hashing import CONTENT_ID
    t = _txt("html")
    hashed = "CASE platform " + " ".join(f"WHEN '{k}' THEN '{p}' || left(md5({t}), {n})"
                                         for k, (p, n) in CONTENT_ID.items()) + " END"
    return f"""
SELECT page_id, coalesce(nullif(regexp_extract(html, '^\\S*<div\\b[^>]*\\bid="([A-Za-z0-9_\\-]+)"', 1), ''),
 nullif(regexp_extract(html, '/(?:gp/customer-reviews|reviews?)/([A-Za-z0-9]{{8,}})', 1), ''), {hashed}) AS review_id
FROM (SELECT page_id, html, {_PLAT} AS platform FROM shop_pages) x"""


@query("pag22_review_id", _pag22_sql())
def pag22(t):
    p = _pages(t)
    return p.select("page_id", pg.review_id("html", F.col("platform")).alias("review_id"))


@query("pag23_star_rating", """
WITH r AS (SELECT page_id, TRY_CAST(nullif(regexp_extract(html, '(?i)(\\d(?:\\.\\d)?)\\s*(?:out of 5|stars?|★)', 1), '') AS DOUBLE) AS num,
  len(regexp_extract_all(html, '(?i)class="[^"]*\\bstar(?:-filled|--filled| filled)\\b')) AS filled FROM shop_pages)
SELECT page_id, coalesce(CASE WHEN num BETWEEN 0 AND 5 THEN num END, CASE WHEN filled > 0 THEN CAST(filled AS DOUBLE) END) AS rating
FROM r""")
def pag23(t):
    return t.shop_pages.select("page_id", pg.star_rating("html").alias("rating"))


@query("pag24_verified", """
SELECT page_id, contains(lower(html), 'verified purchase') OR contains(lower(html), 'certified buyer') AS verified_purchase FROM shop_pages""")
def pag24(t):
    return t.shop_pages.select("page_id", pg.verified("html").alias("verified_purchase"))


def _pag25_sql() -> str:
    t = _txt("regexp_extract(html, '(?is)class=\"[^\"]*\\b(?:helpful[^\"]*|cr-vote-text)\\b[^\"]*\"[^>]*>(.*?)</', 1)")
    n = f"TRY_CAST(nullif(regexp_extract(replace({t}, ',', ''), '(\\d+)', 1), '') AS INTEGER)"
    return (f"SELECT page_id, coalesce({n}, CASE WHEN starts_with(lower({t}), 'one') THEN 1 END, 0) AS helpful_count "
            "FROM shop_pages")


@query("pag25_helpful_count", _pag25_sql())
def pag25(t):
    return t.shop_pages.select("page_id", pg.helpful_count("html").alias("helpful_count"))


def _pag26_sql() -> str:
    a = _txt("regexp_extract(html, '(?is)<[a-z]+\\b[^>]*data-hook=\"format-strip\"[^>]*>(.*?)</a>', 1)")
    b = _txt("regexp_extract(html, '(?is)>((?:Colou?r|Size|Style)\\s*(?:Name)?\\s*:[^<]*)<', 1)")
    v = f"trim(regexp_replace(coalesce({a}, {b}), '(?i)Verified Purchase', '', 'g'))"
    return (f"SELECT page_id, CASE WHEN regexp_matches({v}, '(?i)(colou?r|size|style)') AND length({v}) > 3 "
            f"AND length({v}) < 255 THEN {v} END AS variant_info FROM shop_pages")


@query("pag26_variant_info", _pag26_sql())
def pag26(t):
    return t.shop_pages.select("page_id", pg.variant_info("html").alias("variant_info"))


@query("pag27_sentiment_label", """
SELECT id, CASE WHEN rating IS NULL THEN NULL WHEN rating >= 4 THEN 'positive' WHEN rating >= 3 THEN 'neutral'
 ELSE 'negative' END AS sentiment FROM reviews""")
def pag27(t):
    return t.reviews.select("id", pg.sentiment_label("rating").alias("sentiment"))


@query("pag28_seller_and_badge", f"""
SELECT page_id, {_SELLER} AS seller_name, CASE WHEN platform = 'meesho' AND page_id % 5 < 4 THEN page_id % 5 + 1.5::DOUBLE END AS seller_rating,
 CASE WHEN platform = 'vijaysales' AND page_id % 9 < 3 THEN 'Badge no ' || (page_id % 5) END AS product_badge
FROM (SELECT page_id, {_PLAT} AS platform FROM pages) x""")
def pag28(t):
    return rd.with_page(_pages(t), "fields", "specs").select("page_id", *[v.alias(k) for k, v in rd.seller_and_badge().items()])
