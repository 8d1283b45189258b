"""URL and SKU scalars (URL1–URL5, SKU1)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from shelfwise.operators.common import bind, col

# fixed value: accepted absolute URL shape (scheme, host, optional port, rest without spaces)
VALID_URL = r"^https?://[A-Za-z0-9]([A-Za-z0-9.-]*[A-Za-z0-9])?(:[0-9]+)?([/?#][^\s]*)?$"

# fixed values: sku patterns per platform, tried in order; 'default' for the others
SKU_PATTERNS = {
    "amazon": [r"/dp/([A-Z0-9]{10})", r"/product/([A-Z0-9]+)", r"(?i)asin[=:]([A-Z0-9]{10})"],
    "flipkart": [r"/p/([a-zA-Z0-9]+)", r"pid=([A-Z0-9]+)", r"/([A-Z0-9]{16})"],
    "default": [r"(?i)product[_-]?id[=:]([A-Z0-9]+)", r"(?i)sku[=:]([A-Z0-9]+)", r"(?i)id[=:]([A-Z0-9]+)"],
}


def sanitize_url(c) -> Column:
    """URL1: trim; add ``https://`` when no http(s) scheme; null unless a valid URL."""
    def go(t):
        full = F.when(t.rlike("^https?://"), t).otherwise(F.concat(F.lit("https://"), t))
        return bind(full, lambda u: F.when(t == "", F.lit(None).cast("string")).when(u.rlike(VALID_URL), u))
    return bind(F.trim(col(c)), go)


def absolutize(c, host: str | Column) -> Column:
    """URL2: prefix the host when the link does not start with http."""
    c = col(c)
    h = host if isinstance(host, Column) else F.lit(host)
    return F.when(c.startswith("http"), c).otherwise(F.concat(h, c))


def strip_query(c) -> Column:
    """URL3: drop the query string."""
    return F.substring_index(col(c), "?", 1)


def page_url(base, n, param: str = "page") -> Column:
    """URL4: page 1 is the base url; later pages append ``param=n`` with ? or &."""
    b = col(base)
    n = col(n) if not isinstance(n, int) else F.lit(n)
    sep = F.when(b.contains("?"), F.lit("&")).otherwise(F.lit("?"))
    return F.when(n <= 1, b).otherwise(F.concat(b, sep, F.lit(f"{param}="), n.cast("string")))


def search_url(base: str, keyword, n, param: str = "page") -> Column:
    """URL5: search url = base + url-encoded keyword (+ page for n > 1)."""
    first = F.concat(F.lit(base), F.url_encode(col(keyword)))
    n = col(n) if not isinstance(n, int) else F.lit(n)
    return F.when(n <= 1, first).otherwise(F.concat(first, F.lit(f"&{param}="), n.cast("string")))


def _first_match(text: Column, patterns: list[str]) -> Column:
    return F.coalesce(*[F.nullif(F.regexp_extract(text, p, 1), F.lit("")) for p in patterns])


def sku_from_url(c, platform) -> Column:
    """SKU1: first matching pattern of the platform's list wins."""
    from shelfwise.schemas import PLATFORM_CODES
    text = col(c)
    if isinstance(platform, str):
        plat = F.lit(platform) if platform in PLATFORM_CODES else F.col(platform)
    else:
        plat = platform
    out = F.when(plat == "amazon", _first_match(text, SKU_PATTERNS["amazon"]))
    out = out.when(plat == "flipkart", _first_match(text, SKU_PATTERNS["flipkart"]))
    return out.otherwise(_first_match(text, SKU_PATTERNS["default"]))


def sanitize_url_sql(x: str) -> str:
    """SQL of URL1."""
    full = "CASE WHEN ut RLIKE r'^https?://' THEN ut ELSE concat('https://', ut) END"
    inner = f"element_at(transform(array({full}), uf -> CASE WHEN uf RLIKE r'{VALID_URL}' THEN uf END), 1)"
    return f"element_at(transform(array(trim({x})), ut -> CASE WHEN ut = '' THEN NULL ELSE {inner} END), 1)"
