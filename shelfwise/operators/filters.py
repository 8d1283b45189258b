"""Projections, filters and predicates (§2.2).

All predicates are native Column expressions, so Catalyst pushes the simple ones
(equality, ranges, null tests) into the parquet scan and keeps the rest inside
whole-stage codegen.
"""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfwise import schemas
from shelfwise.operators.common import col, lit, since


def blank(v) -> bool:
    """A request parameter that is absent or empty is skipped (``filled()``)."""
    return v is None or (isinstance(v, str) and v.strip() == "")


def apply_filters(df: DataFrame, filters: dict) -> DataFrame:
    """FIL1: chained equality filters, each skipped when its value is blank."""
    for name, value in filters.items():
        if not blank(value):
            df = df.where(F.col(name) == F.lit(value))
    return df


def search(df: DataFrame, columns: list[str], term: str | None) -> DataFrame:
    """FIL2: case-insensitive contains-search ORed over ``columns``.

    Like the reference, ``%`` and ``_`` in the term are wildcards (LIKE), not
    escaped; the comparison folds case as the unicode_ci collation does.
    """
    if blank(term):
        return df
    pattern = f"%{term}%"
    cond = None
    for c in columns:
        one = F.col(c).ilike(pattern)
        cond = one if cond is None else cond | one
    return df.where(cond)


def contains(df: DataFrame, column: str, term: str | None) -> DataFrame:
    """FIL3: single-column contains (category, tag, keyword)."""
    return search(df, [column], term)


def date_between(df: DataFrame, column: str, lo=None, hi=None) -> DataFrame:
    """FIL4: ``DATE(column) >= lo`` and ``<= hi``, each end optional.

    Written as ``column >= lo AND column < hi + 1 day`` so both ends stay plain
    range predicates that the scan can push down.
    """
    if not blank(lo):
        df = df.where(F.col(column) >= F.lit(lo).cast("date"))
    if not blank(hi):
        hi_next = (date.fromisoformat(hi) if isinstance(hi, str) else hi) + timedelta(days=1)
        df = df.where(F.col(column) < F.lit(hi_next))
    return df


def date_range(df: DataFrame, column: str, a, b) -> DataFrame:
    """FIL5: inclusive BETWEEN."""
    return df.where(F.col(column).between(lit(a), lit(b)))


def recent(df: DataFrame, column: str, asof, n: int, unit: str = "DAYS") -> DataFrame:
    """FIL6: trailing window ``column >= asof - n unit``."""
    return df.where(since(column, asof, n, unit))


def has_items(c) -> Column:
    """FIL7: a JSON-array column holds at least one item.

    Works on arrays (non-empty) and on JSON text (not null, not ``[]``, not ``null``).
    """
    c = col(c)
    return c.isNotNull() & ~c.cast("string").isin("[]", "null")


def has_no_items(c) -> Column:
    """FIL7 negated: null, ``[]`` or ``null`` — exactly the rows that :func:`has_items` refuses."""
    return ~F.coalesce(has_items(c), F.lit(False))


def has_items_array(c) -> Column:
    return F.coalesce(F.size(col(c)), F.lit(0)) > 0


def sentiment_filter(df: DataFrame, band: str | None) -> DataFrame:
    """FIL8: positive (>= 4), critical (<= 2), neutral (BETWEEN 2.1 AND 3.9).

    Ratings strictly between 2.0 and 2.1 or between 3.9 and 4.0 fall in no band,
    exactly as in the reference.
    """
    r = F.col("rating")
    bands = {"positive": r >= 4, "critical": r <= 2, "neutral": r.between(2.1, 3.9)}
    if blank(band):
        return df
    return df.where(bands[band])


def curated(df: DataFrame, choice: str | None = None) -> DataFrame:
    """FIL9: only ``include`` rows unless another choice is asked for."""
    return df.where(F.col("include_exclude") == (choice or "include"))


def incomplete_products(df: DataFrame, platform: str | None = None) -> DataFrame:
    """FIL10: active products missing price, brand or title, or with an empty title
    or description (a NULL description is *not* incomplete)."""
    cond = (F.col("price").isNull() | F.col("brand").isNull() | F.col("title").isNull()
            | (F.col("title") == "") | (F.col("description") == ""))
    out = df.where(F.coalesce(cond, F.lit(False)))
    if platform:
        out = out.where(F.col("platform") == platform)
    return out.where(F.col("is_active"))


def active(df: DataFrame) -> DataFrame:
    """FIL11 scopes."""
    return df.where(F.col("is_active"))


def on_platform(df: DataFrame, platform: str) -> DataFrame:
    return df.where(F.col("platform") == platform)


def by_brand(df: DataFrame, brand: str) -> DataFrame:
    return df.where(F.col("brand") == brand)


def completed(df: DataFrame) -> DataFrame:
    return df.where(F.col("status") == "completed")


def in_category(df: DataFrame, category: str) -> DataFrame:
    return df.where(F.col("category") == category)


def by_ids(df: DataFrame, ids: DataFrame, key: str = "id", ids_key: str | None = None) -> DataFrame:
    """FIL12: membership in an id list, as a semi join.

    The id list is user input and may be large; Spark broadcasts it only when
    its measured size is under the broadcast threshold, else sort-merges.
    """
    ids_key = ids_key or key
    right = ids.select(F.col(ids_key).alias("__id")).distinct()
    return df.join(right, F.col(key) == F.col("__id"), "left_semi")


# fixed value: sku validity pattern (case-insensitive)
SKU_PATTERN = r"(?i)^[A-Z0-9\-_]{3,50}$"


def valid_sku(c) -> Column:
    """FIL13: sku matches ``^[A-Z0-9\\-_]{3,50}$`` ignoring case."""
    return F.coalesce(col(c).rlike(SKU_PATTERN), F.lit(False))


def valid_price(c, lo=schemas.PRICE_MIN, hi=schemas.PRICE_MAX) -> Column:
    """FIL13: numeric and within [lo, hi]."""
    v = F.expr(f"try_cast({c} AS DOUBLE)") if isinstance(c, str) else c.try_cast("double")
    return F.coalesce(v.between(lo, hi), F.lit(False))


def valid_rating(c) -> Column:
    v = F.expr(f"try_cast({c} AS DOUBLE)") if isinstance(c, str) else c.try_cast("double")
    return F.coalesce(v.between(0, 5), F.lit(False))


def php_empty(c) -> Column:
    """PHP ``empty()`` on a string: null, '' or '0'."""
    c = col(c)
    return c.isNull() | (c.cast("string") == "") | (c.cast("string") == "0")


def validate_products(df: DataFrame, lo=schemas.PRICE_MIN, hi=schemas.PRICE_MAX) -> tuple[DataFrame, DataFrame]:
    """FIL14: split into (good, rejects).

    Missing sku / title / platform (PHP ``empty``: ``'0'`` counts as empty)
    rejects the row with a reason list; a price outside [lo, hi] only warns.
    Both outputs come from one tagged projection.
    """
    reasons = F.filter(F.array(
        F.when(php_empty("sku"), F.lit("missing sku")),
        F.when(php_empty("title"), F.lit("missing title")),
        F.when(php_empty("platform"), F.lit("missing platform")),
    ), lambda x: x.isNotNull())
    warn = F.when(F.col("price").isNotNull() & ~F.col("price").between(lo, hi), F.lit("price out of range"))
    tagged = df.withColumn("reject_reasons", reasons).withColumn("warning", warn)
    good = tagged.where(F.size("reject_reasons") == 0).drop("reject_reasons")
    bad = tagged.where(F.size("reject_reasons") > 0)
    return good, bad


def accept_reviews(df: DataFrame) -> DataFrame:
    """FIL15: platform-dependent review acceptance (PHP truthiness: '' and '0'
    are false, a rating of 0 is false).

    amazon needs a review id; flipkart an id or text; vijaysales text;
    croma, reliancedigital and bigbasket text or a rating; meesho name, rating
    and text; any other platform text.
    """
    def has(c):
        return F.col(c).isNotNull() & ~F.col(c).cast("string").isin("", "0")
    rated = F.col("rating").isNotNull() & (F.col("rating") != 0)
    p = F.col("platform")
    rule = (F.when(p == "amazon", has("review_id"))
            .when(p == "flipkart", has("review_id") | has("review_text"))
            .when(p == "meesho", has("reviewer_name") & rated & has("review_text"))
            .when(p.isin("croma", "reliancedigital", "bigbasket"), has("review_text") | rated)
            .otherwise(has("review_text")))
    return df.where(F.coalesce(rule, F.lit(False)))


def reviewable(df: DataFrame, platform: str, limit: int | None = None) -> DataFrame:
    """FIL16: active products of a platform with a url (croma also needs a sku)."""
    out = df.where((F.col("platform") == platform) & F.col("is_active") & F.col("product_url").isNotNull())
    if platform == "croma":
        out = out.where(F.col("sku").isNotNull())
    return out.limit(limit) if limit else out


def rankable(keywords: DataFrame, platform: str, category: str | None = None,
             ids: DataFrame | None = None) -> DataFrame:
    """FIL17: active keywords of a platform, optionally by category and id list."""
    out = keywords.where((F.col("platform") == platform) & F.col("status"))
    if category:
        out = out.where(F.col("category") == category)
    if ids is not None:
        out = by_ids(out, ids)
    return out


# fixed values: markers of a sign-in page (matched case-insensitively)
SIGN_IN_PHRASES = [
    "ap_signin_form",
    "Sign-In",
    "Sign in to continue",
    "Enter your email or mobile phone number",
    "ap_email",
    "ap_password",
]


# fixed values: platforms whose pages must be longer than the general minimum (least bytes: over 5,000)
PLATFORM_MIN_CHARS = {"reliancedigital": 5001}


def usable_pages(pages: DataFrame, min_chars: int = 1000, phrases=None, platform: str | None = None) -> DataFrame:
    """FIL18: pages of at least ``min_chars`` bytes that are not a sign-in page.

    ``platform``: column that names the platform; those of ``PLATFORM_MIN_CHARS``
    have a minimum of their own.
    """
    low = F.lower(F.col("html"))
    hit = None
    for p in (phrases or SIGN_IN_PHRASES):
        one = F.contains(low, F.lit(p.lower()))
        hit = one if hit is None else hit | one
    least = F.lit(min_chars)
    if platform:
        for code, n in PLATFORM_MIN_CHARS.items():
            least = F.when(F.col(platform) == code, F.lit(n)).otherwise(least)
    return pages.where((F.octet_length("html") >= least) & ~hit)
