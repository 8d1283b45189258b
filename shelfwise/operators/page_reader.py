"""Pages read in one pass: the rule table of each platform against the page's elements.

``with_page`` adds one struct per page: the values of every field, the specification rows,
product links, search cards and reviews.  It is the only step that sees markup; the page is
tokenised once (``functions.selectors``), however many rules there are, and text runs to an
element's own end at any depth.  All that follows (prices, dates, joins, cleaning) is Spark.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfwise.functions import hashing as hs
from shelfwise.functions import numbers as nm
from shelfwise.functions import text as tx
from shelfwise.functions.dates import review_date
from shelfwise.functions.selectors import Automaton, Element, Page
from shelfwise.operators import page_rules as pr
from shelfwise.operators.common import col
from shelfwise.operators.page_rules import Rule

_FIELDS = "map<string, array<string>>"
PARTS = {
    "fields": _FIELDS,
    "specs": "map<string, string>",
    "links": "array<string>",
    "cards": f"array<struct<fields: {_FIELDS}, sponsored: boolean, text: string>>",
    "reviews": f"array<struct<fields: {_FIELDS}, text: string>>",
}
#: Pages whose values a task holds at a time.
SLICE = 128


def _split(selector: str) -> tuple[str, list[str | None]]:
    css, at, attrs = selector.partition("@")
    return css.strip(), attrs.split("|") if at else [None]


@lru_cache(64)
def _plan(platform: str | None, parts: tuple[str, ...]):
    """(fields, specs, links, cards, reviews, sponsored) of a platform and the automaton of their selectors."""
    fields = pr.GENERIC | pr.FIELDS.get(platform, {}) if "fields" in parts else {}
    # the generic rule follows the platform's own
    fields = {k: Rule(r.selectors + (pr.GENERIC[k].selectors if k in pr.GENERIC and r is not pr.GENERIC[k] and r.pick == "first" else ()), r.pick, r.accept)
              for k, r in fields.items()}
    specs = pr.SPECS.get(platform, []) if "specs" in parts else []
    links = pr.LINKS.get(platform) if "links" in parts else None
    cards = pr.CARDS.get(platform) if "cards" in parts else None
    reviews = pr.REVIEWS.get(platform) if "reviews" in parts else None
    marks = pr.SPONSORED.get(platform, ()) if cards else ()
    used = [s for r in fields.values() for s in r.selectors] + [s for row in specs for s in row if s] + list(links[0] if links else ()) + list(marks)
    for block in (cards, reviews):
        if block:
            used += [*block[0], *(s for r in block[1].values() for s in r.selectors)]
    return fields, specs, links, cards, reviews, marks, Automaton(list(dict.fromkeys(css for css in (_split(s)[0] for s in used) if css)))


def _values(page: Page, r: Rule, scope: Element | None = None) -> list[str]:
    """What a rule yields, on the page or within an element."""
    out: list[str] = []
    for selector in r.selectors:
        css, attrs = _split(selector)
        found = [scope] if not css else page.find(css) if scope is None else page.inside(scope, css)
        if r.pick == "count":
            if found:
                return [str(len(found))]
            continue
        found = found[:1] if r.pick == "first" else found
        for e in found:
            v = next((v for v in (page.value(e, a) for a in attrs) if v), "")
            if v and re.search(r.accept, v) and (r.pick == "each" or v not in out):
                out.append(v)
                if r.pick in ("first", "any"):
                    return out
        if out and r.pick in ("all", "each"):
            return out
    return out


def _blocks(page: Page, containers: tuple[str, ...]) -> list[Element]:
    return next((found for found in (page.find(c) for c in containers) if found), [])


def read_page(html: str | None, platform: str | None, parts: tuple[str, ...]) -> dict:
    """The parts of one page; a null page is an empty one."""
    fields, specs, links, cards, reviews, marks, automaton = _plan(platform, parts)
    page = Page(html or "", automaton)
    many = lambda rules, scope=None: {k: v for k, v in ((k, _values(page, r, scope)) for k, r in rules.items()) if v}
    out: dict = {}
    if "fields" in parts:
        out["fields"] = many(fields)
    if "specs" in parts:
        table: dict[str, str] = {}
        for row, label, value in specs:
            rows = page.find(row) if row else list({id(e.parent): e.parent for e in page.find(label)}.values())
            for r in rows:
                name = next(iter(page.inside(r, label)), None)
                text = next((e for e in page.inside(r, value) if e is not name), None) if name else None
                if text is not None and page.text(name) and page.text(text):
                    table.pop(page.text(name), None)
                    table[page.text(name)] = page.text(text)
        out["specs"] = table
    if "links" in parts:
        hrefs: list[str] = []
        for css in links[0] if links else ():
            for e in page.find(css):
                href = e.attrs.get("href", "")
                href = href if not href or href.startswith("http") else pr.SITES[platform] + href
                if href and re.search(links[1], href):
                    hrefs.append(href.split("?")[0] if platform in pr.BARE_LINKS else href)
            if hrefs and links[2]:
                break
        out["links"] = list(dict.fromkeys(hrefs))
    if "cards" in parts:
        out["cards"] = [{"fields": many(cards[1], e), "text": page.text(e), "sponsored": any(page.inside(e, m) for m in marks)
                         or platform in pr.SPONSORED_TEXT and "sponsored" in page.text(e).lower()} for e in (_blocks(page, cards[0]) if cards else [])]
    if "reviews" in parts:
        out["reviews"] = [{"fields": many(reviews[1], e), "text": page.text(e)} for e in (_blocks(page, reviews[0]) if reviews else [])]
    return out


def read_in_slices(batches: Iterator[tuple[pd.Series, pd.Series]], wanted: tuple[str, ...]) -> Iterator[pd.DataFrame]:
    """The wanted parts of batches of (html, platform), at most ``SLICE`` pages at a time."""
    for pages, platforms in batches:
        for at in range(0, len(pages), SLICE):
            rows = [read_page(h if isinstance(h, str) else None, p if isinstance(p, str) else None, wanted)
                    for h, p in zip(pages.iloc[at:at + SLICE], platforms.iloc[at:at + SLICE])]
            yield pd.DataFrame({p: [r[p] for r in rows] for p in wanted}, columns=list(wanted), dtype=object)


def with_page(pages: DataFrame, *parts: str, html: str = "html", platform: str = "platform", out: str = "page") -> DataFrame:
    """``pages`` with a struct of the wanted parts (all of PARTS if none is named); unknown platforms have the generic fields only."""
    wanted = parts or tuple(PARTS)
    schema = "struct<" + ", ".join(f"{p}: {PARTS[p]}" for p in wanted) + ">"

    @F.pandas_udf(schema)
    def read(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        yield from read_in_slices(batches, wanted)

    return pages.withColumn(out, read(F.col(html), F.col(platform)))


def values(name: str, fields="page.fields") -> Column:
    """All values of a field, in page order; null if there is none."""
    return F.try_element_at(col(fields), F.lit(name))


def value(name: str, fields="page.fields") -> Column:
    """The first value of a field."""
    return F.try_element_at(values(name, fields), F.lit(1))


def joined(name: str, platform: str = "platform") -> Column:
    """The values of a field joined as its platform does (the first one where none is stated)."""
    p, out = F.col(platform), None
    for code, sep in pr.JOIN[name].items():
        e = F.array_join(values(name), sep)
        out = F.when(p == code, e) if out is None else out.when(p == code, e)
    return out.otherwise(value(name))


def _chosen(table: dict[str, str], platform: str = "platform") -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), F.col(platform))


def product_links(pages: DataFrame, limit: int | None = None) -> DataFrame:
    """PAG1: (page_id, ordinal, link) of a listing page by its platform's link rules, distinct, the first ``limit`` if one is given."""
    links = F.col("page.links")
    links = links if limit is None else F.slice(links, 1, limit)
    return with_page(pages, "links").select("page_id", F.posexplode(links).alias("ordinal", "link")).withColumn("ordinal", (F.col("ordinal") + 1).cast("int"))


def availability(platform: str = "platform") -> Column:
    """PAG15 over ``page``: stock marks, then the status text ('add to cart' means in stock), then the platform's default."""
    text, p = value("availability"), F.col(platform)
    button = p.isin("croma", "reliancedigital") & text.rlike("(?i)add|cart") | (p == "bigbasket") & text.rlike("(?i)add")
    return (F.when(value("in_stock").isNotNull(), "In Stock").when(value("out_of_stock").isNotNull(), "Out of Stock")
            .when(button, "In Stock").otherwise(F.coalesce(text, _chosen(pr.AVAILABILITY_DEFAULT, platform), F.lit("Unknown"))))


def price_columns(df: DataFrame, ld_sale: Column, ld_list: Column, platform: str = "platform") -> DataFrame:
    """PAG6 over ``page``: list and sale price, JSON-LD first on the platforms that print it, then the NUM9 repair."""
    from shelfwise.operators.pages import by_platform
    both = df.withColumns({"__sale": by_platform(platform, ld_sale, nm.extract_price(value("sale_price"))),
                           "__list": by_platform(platform, ld_list, nm.extract_price(value("list_price")))})
    lst, sale = nm.repair_prices("__list", "__sale", platform)
    return both.withColumns({"list_price": lst, "sale_price": sale}).drop("__sale", "__list")


def review_total(text: Column) -> Column:
    """Number of reviews in 'a | 1,234 Reviews', '4 Ratings & 4 Reviews' or plain text."""
    t = F.replace(text, F.lit(","), F.lit(""))
    pick = lambda rx: F.nullif(F.regexp_extract(t, rx, 1), F.lit(""))
    return F.coalesce(pick(r"\|\s*(\d+)"), pick(r"(?i)(\d+)\s+Reviews?"), pick(r"(\d+)")).try_cast("bigint")


def with_star_shares(df: DataFrame, out: str = "stars") -> DataFrame:
    """PAG7 over ``page``: percents for 5 to 1 stars from percent texts, bar widths, or counts (as shares of their sum)."""
    number = lambda x: F.regexp_extract(F.replace(x, F.lit(","), F.lit("")), r"(\d+(?:\.\d+)?)", 1).try_cast("double")
    texts, bars, counts, rows = (values(n) for n in ("star_texts", "star_bars", "star_counts", "star_rows"))
    # a row reads "5 ... 1,234": the star, then how many
    said = F.map_from_entries(F.transform(rows, lambda r: F.struct(
        F.regexp_extract(r, r"^\D*(\d)", 1), F.regexp_extract(F.replace(r, F.lit(","), F.lit("")), r"^\D*\d\D+(\d+)", 1).try_cast("double"))))
    by_star = F.array(*[F.coalesce(F.try_element_at(said, F.lit(str(i))), F.lit(0.0)) for i in (5, 4, 3, 2, 1)])
    staged = df.withColumn("__counts", F.when(F.size(counts) >= 5, F.transform(F.slice(counts, 1, 5), number)).when(F.size(rows) > 0, by_star))
    staged = staged.withColumn("__total", F.aggregate("__counts", F.lit(0.0), lambda a, x: a + x))
    shares = (F.when(F.size(texts) >= 5, F.transform(F.slice(texts, -5, 5), number))
              .when(F.size(bars) >= 5, F.transform(F.slice(bars, 1, 5), lambda b: F.regexp_extract(b, r"width:\s*([\d.]+)%", 1).try_cast("double")))
              .when(F.col("__total") > 0, F.transform("__counts", lambda x: F.round(x * 100.0 / F.col("__total"), 2))))
    return staged.withColumn(out, shares).drop("__counts", "__total")


def delivery() -> tuple[Column, Column]:
    """PAG17 over ``page``: (price, date)."""
    text, price, date = value("delivery"), value("delivery_price"), F.element_at(values("delivery_date"), -1)
    price = F.coalesce(price, text)
    said = F.coalesce(date, text)
    rule = F.coalesce(F.nullif(F.regexp_extract(said, r"(?i)\bby\s+([A-Za-z0-9][A-Za-z0-9 ,]*)", 1), F.lit("")),
                      F.nullif(F.regexp_extract(said, r"(?i)\b(in\s+\d+\s+days?)", 1), F.lit("")), date)
    return (F.when(price.rlike("(?i)free"), "Free").otherwise(F.nullif(F.regexp_extract(price, r"(₹\s?[\d,]+(?:\.\d+)?)", 1), F.lit(""))), F.trim(rule))


def with_price_pair(pages: DataFrame) -> DataFrame:
    """PAG6 as a job: (page_id, list_price, sale_price) of every page."""
    from shelfwise.operators import pages as pg
    read = with_page(pages.select("page_id", "platform", "html"), "fields").withColumn("__ld", pg.jsonld_node(values("jsonld")))
    ld = pg.jsonld_fields(block="__ld")
    return price_columns(read, ld["sale_price"], ld["list_price"]).select("page_id", "list_price", "sale_price")


def seller_and_badge(platform: str = "platform") -> dict[str, Column]:
    """PAG28 over ``page`` (fields and specs): seller name (label 'Fulfilled by' removed), seller rating up to 5, badge if it is visible."""
    from shelfwise.operators.pages import named_attr
    stars = F.regexp_extract(value("seller_rating"), r"(\d+(?:\.\d+)?)", 1).try_cast("double")
    name = F.nullif(tx.strip_label(value("seller"), "Fulfilled by"), F.lit(""))
    return {"seller_name": F.coalesce(name, F.when(F.col(platform) == "reliancedigital", named_attr("page.specs", "seller"))),
            "seller_rating": F.when(stars <= 5, stars), "product_badge": value("badge")}


def page_products(pages: DataFrame) -> DataFrame:
    """PAG5: a full product record per product page, cleaned (CLN1).

    ``pages``: page_id, url, html, platform.  One pass over each page, then columns only.
    """
    from shelfwise.functions.urls import sku_from_url
    from shelfwise.operators import pages as pg
    from shelfwise.operators.upsert import clean_products
    read = with_page(pages.select("page_id", "url", "platform", "html"), "fields", "specs")
    read = read.select("page_id", "url", "platform", "page", pg.jsonld_node(values("jsonld")).alias("__ld"))
    # without a node there is no count (a node without one counts 0)
    ld = {k: F.when(F.col("__ld").isNotNull(), c) for k, c in pg.jsonld_fields(block="__ld").items()}
    specs = F.col("page.specs")
    first = lambda name, markup: pg.by_platform("platform", ld[name], markup).alias(name)
    named = lambda *labels: F.coalesce(*[pg.named_attr(specs, x) for x in labels])
    price, date = delivery()
    seller = seller_and_badge()
    images = F.array_distinct(F.filter(F.transform(values("images"), lambda u: F.substring_index(u, " ", 1)), lambda u: u.rlike("^https?://")))
    ids = F.transform(values("thumbnails"), lambda u: F.regexp_extract(u, r"/vi/([^/]+)/", 1))
    watch = F.flatten(F.transform(F.filter(ids, lambda i: i != ""), lambda i: F.array(
        F.concat(F.lit("https://www.youtube.com/watch?v="), i), F.concat(F.lit("https://www.youtube.com/embed/"), i))))
    videos = F.array_distinct(F.concat(F.coalesce(values("videos"), F.array().cast("array<string>")), F.coalesce(watch, F.array().cast("array<string>"))))
    shelf = values("category")
    shelf = F.when((F.col("platform") == "flipkart") & (F.lower(shelf[0]) == "home"), F.slice(shelf, 2, F.size(shelf))).otherwise(shelf)
    shelves = None
    for code, sep in pr.JOIN["category"].items():
        e = F.nullif(F.array_join(shelf, sep), F.lit(""))
        shelves = F.when(F.col("platform") == code, e) if shelves is None else shelves.when(F.col("platform") == code, e)
    staged = with_star_shares(price_columns(read, ld["sale_price"], ld["list_price"]), "__stars")
    raw = staged.select(
        F.col("page_id").alias("product_id"), "platform", F.col("url").alias("product_url"),
        first("title", value("title")), first("description", joined("description")),
        first("brand", F.coalesce(value("brand"), named("^brand"))),
        named("^manufacturer").alias("manufacturer"),
        F.coalesce(value("model_name"), named("^model")).alias("model_name"),
        F.coalesce(value("color"), named("^colou?r")).alias("color"),
        F.coalesce(value("weight"), named("weight")).alias("weight"),
        F.coalesce(value("dimensions"), pg.dimensions(specs, "platform")).alias("dimensions"),
        F.coalesce("list_price", ld["sale_price"]).cast("string").alias("price"), F.col("sale_price").cast("string").alias("sale_price"),
        first("rating", nm.rating(value("rating"))).cast("string").alias("rating"),
        first("review_count", review_total(value("review_count"))).cast("string").alias("review_count"),
        *[F.col("__stars")[5 - i].cast("decimal(5,2)").cast("string").alias(f"rating_{i}_star_percent") for i in range(1, 6)],
        first("image_urls", F.when(F.size(images) > 0, images)), F.when(F.size(videos) > 0, videos).alias("video_urls"),
        F.to_json(specs).alias("technical_details"), F.coalesce(shelves, F.nullif(F.array_join(shelf, ", "), F.lit(""))).alias("category"),
        availability().alias("inventory_status"), joined("offers").alias("offers"), price.alias("delivery_price"), date.alias("delivery_date"),
        joined("highlights").alias("highlights"), value("customers_say").alias("customers_say"),
        value("amazon_choice").isNotNull().alias("amazon_choice"), value("bestseller").isNotNull().alias("bestseller"),
        seller["seller_name"].alias("seller_name"), seller["product_badge"].alias("product_badge"),
        F.coalesce(nm.currency_code(value("currency")), F.lit("INR")).alias("currency_code"),
        F.coalesce(sku_from_url(F.col("url"), F.col("platform")), value("page_sku"), hs.content_id(F.col("url"), "", 12)).alias("sku"))
    return clean_products(raw).withColumnRenamed("product_id", "page_id")


def search_items(pages: DataFrame) -> DataFrame:
    """PAG19: search-result cards → (page_id, platform, ordinal, sku, title, is_sponsored), the first container rule of the platform that occurs."""
    cards = with_page(pages.select("page_id", "platform", "html"), "cards").select("page_id", "platform", F.posexplode("page.cards").alias("ordinal", "card"))
    href = value("href", "card.fields")
    found = F.coalesce(value("sku", "card.fields"), *[F.nullif(F.regexp_extract(href, rx, 1), F.lit("")) for rx in (
        r"/p/(itm[a-zA-Z0-9]+)", r"/dp/([A-Z0-9]{10})", r"/(?:p|pd|product)/([A-Za-z0-9_\-]+)", r"/([a-zA-Z0-9\-]+)\.html")])
    organic = (F.col("platform") == "flipkart") & href.contains("fm=organic")
    flagged = (F.col("platform") == "flipkart") & href.rlike(r"[?&]fm=")
    badge = (F.col("platform") == "flipkart") & F.col("card.sponsored") & ~F.col("card.text").rlike("(?i)sponsored")
    sponsored = F.when(badge, True).when(organic, False).otherwise(F.col("card.sponsored") | F.coalesce(flagged, F.lit(False)))
    return cards.select("page_id", "platform", (F.col("ordinal") + 1).cast("int").alias("ordinal"), found.alias("sku"),
                        value("title", "card.fields").alias("title"), sponsored.alias("is_sponsored"))


def page_reviews(pages: DataFrame, asof=None) -> DataFrame:
    """PAG21: the reviews of a page, read in the first container rule of its platform that occurs, FIL15 applied."""
    from shelfwise.operators.filters import accept_reviews
    from shelfwise.operators.pages import sentiment_label
    blocks = with_page(pages.select("page_id", "platform", "html"), "reviews").select(
        "page_id", "platform", F.posexplode("page.reviews").alias("ordinal", "review"))
    v = lambda name: value(name, "review.fields")
    linked = F.nullif(F.regexp_extract(v("link"), r"reviewId=([A-Za-z0-9\-]+)", 1), F.lit(""))
    own = F.regexp_replace(v("id"), "^review-", "")
    prefix = F.coalesce(_chosen(pr.REVIEW_PREFIX), F.lit(""))
    rid = F.coalesce(F.concat(prefix, own), linked, hs.content_id_for("review.text", F.col("platform")))
    stars = F.coalesce(F.regexp_extract(v("rating"), r"(\d+(?:\.\d+)?)", 1).try_cast("double"), v("filled").try_cast("double"))
    stars = F.when(stars.between(0, 5), stars)
    when = F.coalesce(v("date"), F.element_at(values("dates", "review.fields"), -1))
    helpful = F.regexp_extract(F.replace(v("helpful"), F.lit(","), F.lit("")), r"(\d+)", 1).try_cast("int")
    variant = F.trim(F.regexp_replace(v("variant"), "(?i)Verified Purchase", ""))
    out = blocks.select(
        "page_id", "platform", (F.col("ordinal") + 1).cast("int").alias("ordinal"), rid.alias("review_id"), v("name").alias("reviewer_name"),
        stars.cast("decimal(3,2)").alias("rating"), v("title").alias("review_title"),
        F.nullif(F.trim(F.replace(v("text"), F.lit("READ MORE"), F.lit(""))), F.lit("")).alias("review_text"),
        (review_date(when, asof) if asof is not None else F.lit(None).cast("date")).alias("review_date"),
        v("verified").isNotNull().alias("verified_purchase"),
        F.coalesce(helpful, F.when(F.lower(v("helpful")).startswith("one"), 1), F.lit(0)).alias("helpful_count"),
        F.when(variant.rlike("(?i)(colou?r|size|style)") & (F.length(variant) > 3) & (F.length(variant) < 255), variant).alias("variant_info"),
        sentiment_label(stars).alias("sentiment"))
    return accept_reviews(out)
