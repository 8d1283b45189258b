"""Page fragments as Column expressions (§2.10): patterns that are local enough for regular expressions.

What depends on a platform's own markup (records, cards, reviews, links) is read by
``page_reader`` in one tokenising pass; its entry points are re-exported here.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfwise.functions import hashing as hs
from shelfwise.functions import numbers as nm
from shelfwise.functions import text as tx
from shelfwise.functions.arrays import last_of_key
from shelfwise.operators.common import bind, col
from shelfwise.operators.page_reader import page_products, page_reviews, search_items  # noqa: F401

TAG = "[a-zA-Z][a-zA-Z0-9]*"
NESTING = 12


def _inner(depth: int) -> str:
    """Regex for the inner HTML (group 2) of an element whose tag is group 1, up to its own closing tag.

    Same-name elements inside are skipped as balanced pairs down to ``depth``;
    past that, and in markup that never closes them, the text ends at the first
    closing tag of that name.  Every repetition is possessive, so long elements
    need neither backtracking nor stack.
    """
    other = r"[^<]++|<(?!/?\1\b)"
    body = rf"(?:{other})*+"
    for _ in range(depth):
        body = rf"(?:{other}|<\1\b[^>]*+>{body}</\1\s*+>)*+"
    return rf"({body}(?=</\1\b)|.*?(?=</\1\b))"


INNER = _inner(NESTING)


def sel(selector: str, attr: str | None = None) -> str:
    """Regex for the whole inner HTML (or ``attr`` value), as group 2, of the element matched by a
    simple selector: ``tag``, ``#id``, ``.class``, ``tag#id``, ``tag.class``,
    ``[name="value"]`` (combinations of one tag, one id, classes, attributes)."""
    m_tag = re.match(r"^([a-zA-Z][a-zA-Z0-9]*)", selector)
    tag = m_tag.group(1) if m_tag else TAG
    conds = []
    for kind, name in re.findall(r"([#.])([A-Za-z0-9_\-]+)", selector):
        if kind == "#":
            conds.append(rf'(?=[^>]*\bid="{re.escape(name)}")')
        else:
            conds.append(rf'(?=[^>]*\bclass="(?:[^"]*\s)?{re.escape(name)}(?:\s[^"]*)?")')
    for name, value in re.findall(r'\[([A-Za-z0-9_\-:]+)="([^"]*)"\]', selector):
        conds.append(rf'(?=[^>]*\b{re.escape(name)}="{re.escape(value)}")')
    if len(conds) == 1 and not attr:
        # for inner text one condition needs no lookahead (an attribute read keeps
        # it so the two attributes may come in either order)
        conds = [conds[0][len("(?="):-1]]
    opening = rf"<({tag})\b{''.join(conds)}[^>]*"
    if attr:
        return rf'(?is){opening}\b{re.escape(attr)}="([^"]*)"'
    return rf"(?is){opening}>{INNER}"


def element(condition: str, tag: str = TAG) -> str:
    """Regex for the whole inner HTML (group 2) of an element whose opening tag holds ``condition``."""
    return rf"(?is)<({tag})\b[^>]*{condition}[^>]*>{INNER}"


def meta(name: str) -> str:
    """Regex for ``<meta name|property="name" content="...">``."""
    return rf'(?is)<(meta)\b(?=[^>]*\b(?:name|property)="{re.escape(name)}")[^>]*\bcontent="([^"]*)"'


# ---- fixed values: markup that is the same everywhere ----
TITLE_RULES = [sel("h1"), sel("title"), meta("og:title"), meta("title")]
# markers of a sponsored search card (regular expressions, matched case-insensitively)
SPONSORED_MARKERS = ["sponsored", "AdHolder", 'data-is-sponsored="true"', "IxWX8O", r'\bis-ad="true"',
                     r'class="[^"]*\bad\b[^"]*"', r"\bAd\b</"]
# a url flag fm=<value> marks an ad unless the value is organic
AD_URL_FLAG, ORGANIC_URL_FLAG = r"[?&]fm=", r"[?&]fm=organic"
# a product card that is a button, and the node of its name
CARD_BUTTON = r'<div\b(?=[^>]*\btabindex="0")(?=[^>]*\brole="button")'
CARD_NAME = sel("div.tw-text-300.tw-font-semibold.tw-line-clamp-2")
# platforms whose pages are read from JSON-LD first, markup second
JSONLD_FIRST = ["croma", "reliancedigital", "bigbasket", "blinkit"]
VERIFIED_PHRASES = ["Verified Purchase", "Certified Buyer"]
# ---- end of fixed values ----


def host(url) -> Column:
    """scheme://host of a page url."""
    return F.regexp_extract(col(url), r"^(https?://[^/?#]+)", 1)


def _text(c: Column) -> Column:
    """Inner HTML → clean text (tags stripped, entities for & < > " ' and nbsp)."""
    t = tx.clean_text(c)
    for ent, ch in (("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " ")):
        t = F.replace(t, F.lit(ent), F.lit(ch))
    return F.nullif(F.trim(t), F.lit(""))


_ENTITIES = (("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "))


def _sql_lit(pattern: str) -> str:
    """A Spark SQL raw string literal for a regular expression."""
    if "'" not in pattern:
        return f"r'{pattern}'"
    if '"' not in pattern:
        return f'r"{pattern}"'
    raise ValueError(f"pattern needs one quote style: {pattern}")


def _text_sql(x: str) -> str:
    """SQL of ``_text``: falsy → null, strip tags, collapse spaces, trim, entities."""
    t = (f"trim(regexp_replace(regexp_replace(CASE WHEN {x} IN ('', '0') THEN NULL ELSE {x} END, "
         f"r'<[^>]*>', ''), r'\\s+', ' '))")
    for ent, ch in _ENTITIES:
        t = f"replace({t}, '{ent}', {_sql_lit(ch) if ch != chr(39) else chr(34) + ch + chr(34)})"
    return f"nullif(trim({t}), '')"


def cascade_sql(source: str, patterns: list[str], min_len: int = 0, group: int = 2) -> str:
    """SQL of the first-match cascade over column ``source``."""
    if not patterns:
        return "CAST(NULL AS STRING)"
    raws = ", ".join(f"regexp_extract({source}, {_sql_lit(p)}, {group})" for p in patterns)
    return (f"try_element_at(filter(transform(array({raws}), x -> {_text_sql('x')}), "
            f"y -> length(y) > {int(min_len)}), 1)")


def cascade(html, patterns: list[str], min_len: int = 0, group: int = 2) -> Column:
    """PAG3: first pattern whose cleaned match is longer than ``min_len`` wins.

    Written as ``filter(transform(array(raw matches), clean), long enough)[1]``
    so the cleaning expression appears once however many rules there are.  With
    a column *name* the whole cascade is one SQL expression (one call to build,
    however many rules).
    """
    if isinstance(html, str):
        return F.expr(cascade_sql(html, patterns, min_len, group))
    if not patterns:
        return F.lit(None).cast("string")
    raws = F.array(*[F.regexp_extract(html, p, group) for p in patterns])
    kept = F.filter(F.transform(raws, lambda x: _text(x)), lambda y: F.length(y) > min_len)
    return F.try_element_at(kept, F.lit(1))


# ---------------------------------------------------------------- links (PAG1–2)
def _links(pages: DataFrame, links: Column, limit: int | None) -> DataFrame:
    """Distinct links in page order as (page_id, ordinal, link), all of them unless ``limit`` is given."""
    out = F.array_distinct(links)
    out = F.slice(out, 1, limit) if limit is not None else out
    return pages.select("page_id", F.posexplode(out).alias("ordinal", "link")) \
        .withColumn("ordinal", (F.col("ordinal") + 1).cast("int"))


def product_links(pages: DataFrame, path_pattern: str | None = r"/dp/|/p/|\.html", limit: int | None = None) -> DataFrame:
    """PAG1: product links of listing pages — every href, made absolute with the
    page host, kept when its path passes ``path_pattern``, de-duplicated in page
    order, the first ``limit`` if one is given.  One row per (page, link) with its ordinal."""
    hrefs = F.regexp_extract_all("html", F.lit(r'href="([^"]+)"'), 1)
    absolute = F.transform(hrefs, lambda h: F.when(h.startswith("http"), h).otherwise(F.concat(host("url"), h)))
    if path_pattern:
        absolute = F.filter(absolute, lambda h: h.rlike(path_pattern))
    return _links(pages, absolute, limit)


def card_links(pages: DataFrame, base: str = "https://blinkit.com", limit: int | None = None) -> DataFrame:
    """PAG2: links built from a card's product id and title slug
    (``base/prn/<slug>/prid/<id>``), distinct, the first ``limit`` if one is given.

    A card is a ``role="button"`` element with ``tabindex="0"``; its ``id`` is the
    product id and its name node the title.  Cards without either are skipped.
    """
    cards = _blocks(F.col("html"), CARD_BUTTON)
    links = F.transform(cards, lambda c: F.concat(
        F.lit(base + "/prn/"), tx.slug(_text(F.regexp_extract(c, CARD_NAME, 2))), F.lit("/prid/"),
        F.nullif(F.regexp_extract(c, r'(?is)^<div\b[^>]*\bid="([^"]+)"', 1), F.lit(""))))
    return _links(pages, F.filter(links, lambda x: x.isNotNull()), limit)


# ---------------------------------------------------------------- JSON-LD (PAG4)
JSONLD = r'(?is)<script\b[^>]*type="application/ld\+json"[^>]*>(.*?)</script>'


def _ld_nodes(block: Column) -> Column:
    """Top-level nodes of a JSON-LD block: those of ``@graph``, of a list, or the object itself."""
    graph = F.get_json_object(block, "$.@graph")
    listed = F.when(graph.isNotNull(), graph).when(F.ltrim(block).startswith("["), block) \
        .otherwise(F.concat(F.lit("["), block, F.lit("]")))
    return F.coalesce(F.from_json(listed, "array<string>"), F.array().cast("array<string>"))


def _is_product(node: Column) -> Column:
    kind = F.get_json_object(node, "$.@type")
    return F.coalesce((kind == "Product") | kind.rlike(r'^\[.*"Product"'), F.lit(False))


def jsonld_product_block(html) -> Column:
    """The first JSON-LD node whose own @type is Product (an object, a list entry or one of @graph)."""
    return jsonld_node(F.regexp_extract_all(col(html), F.lit(JSONLD), 1))


def jsonld_node(blocks: Column) -> Column:
    """The first Product node of an array of JSON-LD texts."""
    return F.try_element_at(F.filter(F.flatten(F.transform(blocks, _ld_nodes)), _is_product), F.lit(1))


def by_platform(platform, ld: Column, markup: Column) -> Column:
    """JSON-LD before markup on ``JSONLD_FIRST`` platforms, after it on the others."""
    return F.when(col(platform).isin(*JSONLD_FIRST), F.coalesce(ld, markup)).otherwise(F.coalesce(markup, ld))


def jsonld_fields(html=None, block=None) -> dict[str, Column]:
    """PAG4: title, description, brand (object or string), images (string or
    list), sale price (offers.price or lowPrice), list price (highPrice),
    rating, review count.  Pass ``block`` when the Product block is already a column."""
    b = col(block) if block is not None else jsonld_product_block(html)

    def g(path):
        return F.get_json_object(b, path)
    brand = F.coalesce(g("$.brand.name"), F.when(~F.coalesce(g("$.brand"), F.lit("")).startswith("{"), g("$.brand")))
    img = g("$.image")
    images = F.when(img.startswith("["), F.from_json(img, "array<string>")).when(img.isNotNull(), F.array(img))
    return {
        "title": g("$.name"), "description": g("$.description"), "brand": brand, "image_urls": images,
        "sale_price": nm.extract_price(F.coalesce(g("$.offers.price"), g("$.offers[0].price"), g("$.offers.lowPrice"))),
        "list_price": nm.extract_price(g("$.offers.highPrice")),
        "rating": nm.rating(g("$.aggregateRating.ratingValue")),
        "review_count": nm.review_count(F.coalesce(g("$.aggregateRating.reviewCount"),
                                                   g("$.aggregateRating.ratingCount"))),
    }


def jsonld_product(pages: DataFrame) -> DataFrame:
    """PAG4 as a job: one row per page that carries a Product block."""
    blocks = pages.select("page_id", jsonld_product_block("html").alias("__ld")).where(F.col("__ld").isNotNull())
    f = jsonld_fields(block="__ld")
    return blocks.select("page_id", *[v.alias(k) for k, v in f.items()])


# ---------------------------------------------------------------- product parts
def star_histogram(html) -> Column:
    """PAG7: star shares 5→1 as percents.

    Tried in order: the last five ``n%`` texts of a histogram table; five
    ``width: x%`` bars; five raw counts (normalised to percents of their sum).
    """
    h = col(html)
    table = F.regexp_extract(h, r'(?is)<table\b[^>]*id="histogramTable".*?</table>', 0)
    texts = F.regexp_extract_all(table, F.lit(r"(\d+(?:\.\d+)?)\s*%"), 1)
    widths = F.regexp_extract_all(h, F.lit(r"(?i)width:\s*(\d+(?:\.\d+)?)%"), 1)
    counts = F.regexp_extract_all(h, F.lit(r'(?is)class="[^"]*\bstar-count\b[^"]*"[^>]*>\s*([\d,]+)\s*<'), 1)
    nums = F.transform(counts, lambda x: F.replace(x, F.lit(","), F.lit("")).cast("double"))
    total = F.aggregate(nums, F.lit(0.0), lambda a, x: a + x)
    as_pct = F.transform(nums, lambda x: F.round(x * 100.0 / total, 2).cast("string"))
    pick = (F.when(F.size(texts) >= 5, F.slice(texts, -5, 5))
            .when(F.size(widths) >= 5, F.slice(widths, 1, 5))
            .when((F.size(counts) >= 5) & (total > 0), F.slice(as_pct, 1, 5)))
    return F.transform(pick, lambda x: x.cast("double").cast("decimal(5,2)"))


SPEC_ROW = r'(?is)<tr\b[^>]*>\s*<t[hd]\b[^>]*>(.*?)</t[hd]>\s*<td\b[^>]*>(.*?)</td>'


def spec_map(html) -> Column:
    """PAG8: specification table rows → map(label → value); blank cells dropped,
    the last duplicate label wins."""
    rows = F.regexp_extract_all(col(html), F.lit(SPEC_ROW), 0)
    pairs = F.transform(rows, lambda r: F.struct(
        _text(F.regexp_extract(r, SPEC_ROW, 1)).alias("k"), _text(F.regexp_extract(r, SPEC_ROW, 2)).alias("v")))
    kept = F.filter(pairs, lambda p: p["k"].isNotNull() & p["v"].isNotNull())
    # last key wins: keep an entry only if no later entry has the same key
    return bind(kept, lambda held: F.map_from_entries(last_of_key(held)))


def named_attr(specs, label_regex: str) -> Column:
    """PAG9: value of the first spec whose label matches ``label_regex``."""
    hits = F.map_filter(col(specs), lambda k, v: k.rlike("(?i)" + label_regex))
    return F.try_element_at(F.map_values(hits), F.lit(1))


def named_attrs(specs, labels: dict[str, str]) -> Column:
    """PAG9 for several labels: a struct of the values by name, the map made once."""
    return bind(col(specs), lambda s: F.struct(*[named_attr(s, rx).alias(name) for name, rx in labels.items()]))


def dimensions(specs, platform) -> Column:
    """PAG10: 'a x b x c' from labelled parts, missing parts skipped — width x
    depth x height for flipkart, length x width x height otherwise."""
    p = col(platform)

    def go(s):
        w, d, h, ln = (named_attr(s, "^width"), named_attr(s, "^depth"), named_attr(s, "^height"),
                       named_attr(s, "^length"))
        out = F.when(p == "flipkart", F.concat_ws(" x ", w, d, h)).otherwise(F.concat_ws(" x ", ln, w, h))
        return F.nullif(out, F.lit(""))
    return bind(col(specs), go)


def breadcrumb(html, platform, sep: str | None = None) -> Column:
    """PAG11: breadcrumb texts in order, joined (amazon distinct; flipkart drops a leading Home)."""
    h, p = col(html), col(platform)
    items = F.regexp_extract_all(h, F.lit(element(r'class="[^"]*\bbreadcrumb[^"]*"', "li|a")), 2)
    items = F.filter(F.transform(items, lambda x: _text(x)), lambda x: x.isNotNull())
    items = F.when(p == "amazon", F.array_distinct(items)) \
        .when((p == "flipkart") & (F.lower(F.try_element_at(items, F.lit(1))) == "home"), F.slice(items, F.lit(2), F.size(items))) \
        .otherwise(items)
    out = F.array_join(items, sep) if sep else F.when(p == "bigbasket", F.array_join(items, " > ")) \
        .otherwise(F.array_join(items, " > "))
    return F.nullif(out, F.lit(""))


def image_urls(html) -> Column:
    """PAG12: per <img>: high-res attribute, then lazy attribute, then src; the
    first candidate of a srcset; http(s) only; distinct."""
    imgs = F.regexp_extract_all(col(html), F.lit(r"(?is)<img\b[^>]*>"), 0)

    def attr(tag, name):
        return F.nullif(F.regexp_extract(tag, rf'(?is)\b{name}="([^"]*)"', 1), F.lit(""))
    urls = F.transform(imgs, lambda t: F.coalesce(
        attr(t, "data-old-hires"), attr(t, "data-a-hires"), attr(t, "data-src"),
        F.nullif(F.trim(F.substring_index(F.coalesce(attr(t, "srcset"), F.lit("")), " ", 1)), F.lit("")),
        attr(t, "src")))
    return F.array_distinct(F.filter(urls, lambda u: u.rlike("^https?://")))


def video_urls(html) -> Column:
    """PAG13: video links, plus watch and embed urls for each video thumbnail id."""
    h = col(html)
    direct = F.regexp_extract_all(h, F.lit(r'(?i)(https?://[^"\s]+\.(?:mp4|m3u8|webm))'), 1)
    ids = F.regexp_extract_all(h, F.lit(r'(?i)(?:i\.ytimg\.com/vi/|youtube\.com/embed/)([A-Za-z0-9_\-]{11})'), 1)
    made = F.flatten(F.transform(F.array_distinct(ids), lambda i: F.array(
        F.concat(F.lit("https://www.youtube.com/watch?v="), i), F.concat(F.lit("https://www.youtube.com/embed/"), i))))
    return F.array_distinct(F.concat(direct, made))


def variants(html) -> Column:
    """PAG14: variant options as {name, image, asin} (asin from data-defaultasin / data-asin)."""
    items = F.regexp_extract_all(col(html), F.lit(r'(?is)<li\b[^>]*data-(?:defaultasin|asin)="[A-Z0-9]+"[^>]*>.*?</li>'), 0)
    return F.transform(items, lambda s: F.struct(
        F.nullif(F.regexp_extract(s, r'(?is)\btitle="([^"]*)"', 1), F.lit("")).alias("name"),
        F.nullif(F.regexp_extract(s, r'(?is)<img\b[^>]*\bsrc="([^"]*)"', 1), F.lit("")).alias("image"),
        F.regexp_extract(s, r'data-(?:defaultasin|asin)="([A-Z0-9]+)"', 1).alias("asin")))


def offers(html) -> Column:
    """PAG16: discount / offer percents found in offer blocks, joined by '; '."""
    blocks = F.regexp_extract_all(col(html), F.lit(element(r'class="[^"]*\b(?:savingsPercentage|offer[^"]*)\b[^"]*"')), 2)
    pcts = F.flatten(F.transform(blocks, lambda b: F.regexp_extract_all(b, F.lit(r"(\d+\s?%)"), 1)))
    return F.nullif(F.array_join(F.array_distinct(pcts), "; "), F.lit(""))


def delivery(html) -> tuple[Column, Column]:
    """PAG17: (price, date) — 'Free' or the first ₹ amount; the date after 'by'
    or 'in N days'."""
    block = _text(F.regexp_extract(col(html), element(r'class="[^"]*\bdelivery[^"]*"'), 2))
    price = F.when(F.lower(block).contains("free"), F.lit("Free")) \
        .otherwise(F.nullif(F.regexp_extract(block, r"(₹\s?[\d,]+(?:\.\d+)?)", 1), F.lit("")))
    date = F.coalesce(F.nullif(F.regexp_extract(block, r"(?i)\bby\s+([A-Za-z]{3,9},?\s+[A-Za-z]{3,9}\s+\d{1,2}|[A-Za-z]{3,9}\s+\d{1,2})", 1), F.lit("")),
                      F.nullif(F.regexp_extract(block, r"(?i)\b(in\s+\d+\s+days?)", 1), F.lit("")))
    return price, date


def badges_and_rank(html) -> dict[str, Column]:
    """PAG18: best-seller rank (#n,nnn → int), badges, highlights (> 10 chars),
    customers-say (> 20 chars), countdown text.  Choice and best-seller badges
    each go to their own column."""
    h = col(html)
    rank = F.regexp_extract(h, r"#\s?([\d,]+)\s+in\b", 1)
    bullets = F.regexp_extract_all(h, F.lit(element(r'id="feature-bullets"', "div")), 2)
    lis = F.transform(F.regexp_extract_all(F.array_join(bullets, " "), F.lit(r"(?is)<li\b[^>]*>(.*?)</li>"), 1),
                      lambda x: _text(x))
    say = cascade("html", [sel('[data-hook="cr-insights-widget-summary"]'), sel("#product-summary")], 20)
    return {
        "best_seller_rank": F.nullif(F.replace(rank, F.lit(","), F.lit("")), F.lit("")).try_cast("int"),
        "amazon_choice": h.rlike(r"(?i)mvt-ac-badge|Amazon's\s+Choice"),
        "bestseller": h.rlike(r"(?i)mvt-best-seller-badge|#1 Best Seller"),
        "highlights": F.nullif(F.array_join(F.filter(lis, lambda x: F.length(x) > 10), ". "), F.lit("")),
        "customers_say": say,
        "countdown": cascade("html", [r'(?is)<(span)\b[^>]*>([^<]*(?:Deal|ends in)[^<]*)</span>'], 0),
    }


# ---------------------------------------------------------------- search pages (PAG19–20)
def _blocks(html: Column, start_pattern: str) -> Column:
    """Blocks of a page: the text from each block start to the next one."""
    marked = F.regexp_replace(html, f"({start_pattern})", "\u0001$1")
    parts = F.split(marked, "\u0001")
    return F.slice(parts, F.lit(2), F.size(parts))


def is_sponsored(block, platform=None) -> Column:
    """PAG20: a card is sponsored when it carries any ad marker (badge text,
    sponsored attribute, ad class, ``fm=`` flag other than organic)."""
    b = col(block)
    out = b.rlike("(?i)" + AD_URL_FLAG) & ~b.rlike("(?i)" + ORGANIC_URL_FLAG)
    for m in SPONSORED_MARKERS:
        out = out | b.rlike("(?i)" + m)
    return out


# ---------------------------------------------------------------- reviews (PAG21–27)
def review_id(block, platform) -> Column:
    """PAG22: id attribute, else the permalink id, else a content hash (HSH1)."""
    b = col(block)
    attr = F.nullif(F.regexp_extract(b, r'^\S*<div\b[^>]*\bid="([A-Za-z0-9_\-]+)"', 1), F.lit(""))
    link = F.nullif(F.regexp_extract(b, r'/(?:gp/customer-reviews|reviews?)/([A-Za-z0-9]{8,})', 1), F.lit(""))
    return F.coalesce(attr, link, hs.content_id_for(_text(b), platform))


def star_rating(block) -> Column:
    """PAG23: the rating number in the text, else the number of filled stars."""
    b = col(block)
    num = F.regexp_extract(b, r"(?i)(\d(?:\.\d)?)\s*(?:out of 5|stars?|★)", 1).try_cast("double")
    filled = F.regexp_count(b, F.lit(r'(?i)class="[^"]*\bstar(?:-filled|--filled| filled)\b'))
    return F.coalesce(F.when(num.between(0, 5), num), F.when(filled > 0, filled.cast("double")))


def verified(block) -> Column:
    """PAG24: 'Verified Purchase' / 'Certified Buyer' present."""
    b = col(block)
    out = F.lit(False)
    for ph in VERIFIED_PHRASES:
        out = out | F.lower(b).contains(ph.lower())
    return out


def helpful_count(block) -> Column:
    """PAG25: first integer of the 'n people found this helpful' text ('One' = 1)."""
    t = _text(F.regexp_extract(col(block), element(r'class="[^"]*\b(?:helpful[^"]*|cr-vote-text)\b[^"]*"'), 2))
    n = F.nullif(F.regexp_extract(F.replace(t, F.lit(","), F.lit("")), r"(\d+)", 1), F.lit("")).try_cast("int")
    return F.coalesce(n, F.when(F.lower(t).startswith("one"), F.lit(1)), F.lit(0))


def variant_info(block) -> Column:
    """PAG26: 'Colour / Size / Style' text between 3 and 255 characters, verified phrase removed."""
    t = _text(F.regexp_extract(col(block), r'(?is)<[a-z]+\b[^>]*data-hook="format-strip"[^>]*>(.*?)</a>', 1))
    t = F.coalesce(t, _text(F.regexp_extract(col(block), r'(?is)>((?:Colou?r|Size|Style)\s*(?:Name)?\s*:[^<]*)<', 1)))
    t = F.trim(F.regexp_replace(t, r"(?i)Verified Purchase", ""))
    return F.when(t.rlike(r"(?i)(colou?r|size|style)") & (F.length(t) > 3) & (F.length(t) < 255), t)


def sentiment_label(rating) -> Column:
    """PAG27: positive (>= 4), neutral (>= 3), negative, null without a rating."""
    r = col(rating)
    return F.when(r.isNull(), F.lit(None)).when(r >= 4, "positive").when(r >= 3, "neutral").otherwise("negative")
