"""Numeric scalars (NUM1–NUM10)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from shelfwise import schemas
from shelfwise.operators.common import bind, col

# fixed values: currency symbol -> ISO code
CURRENCY_MAP = {"₹": "INR", "$": "USD", "£": "GBP", "€": "EUR", "¥": "JPY", "₩": "KRW"}


def _php_float(s: Column) -> Column:
    """PHP ``(float)`` of a string: its leading number, 0 when there is none."""
    lead = F.regexp_extract(s, r"^\s*([0-9]*\.?[0-9]+|[0-9]+\.?)", 1)
    return F.coalesce(F.nullif(lead, F.lit("")).try_cast("double"), F.lit(0.0))


def extract_price(c) -> Column:
    """NUM2: keep digits, '.' and ','; drop commas; the number, or null."""
    s = F.replace(F.regexp_replace(col(c).cast("string"), r"[^0-9.,]", ""), F.lit(","), F.lit(""))
    return bind(s, lambda x: F.when(x.rlike(r"^[0-9]*\.?[0-9]+$|^[0-9]+\.$"), x.try_cast("double")))


def sanitize_price(c, lo=schemas.PRICE_MIN, hi=schemas.PRICE_MAX) -> Column:
    """NUM1: as NUM2 with PHP float semantics; null outside [lo, hi] (or on blank input)."""
    def go(raw):
        s = F.replace(F.regexp_replace(raw, r"[^0-9.,]", ""), F.lit(","), F.lit(""))
        return bind(_php_float(s), lambda v: F.when(raw == "", F.lit(None).cast("double"))
                    .when(v.between(lo, hi), v))
    return bind(col(c).cast("string"), go)


def numeric_price(c) -> Column:
    """NUM3: first run of digits after comma removal."""
    s = F.replace(col(c).cast("string"), F.lit(","), F.lit(""))
    return F.nullif(F.regexp_extract(s, r"([0-9]+)", 1), F.lit("")).try_cast("bigint")


def rating(c) -> Column:
    """NUM4: first decimal number in the text; null outside 0–5."""
    v = F.nullif(F.regexp_extract(col(c).cast("string"), r"([0-9]+\.?[0-9]*)", 1), F.lit("")).try_cast("double")
    return bind(v, lambda x: F.when(x.between(0, 5), x))


def review_count(c) -> Column:
    """NUM5 (extractReviewCount): first integer after comma removal, 0 default."""
    s = F.replace(col(c).cast("string"), F.lit(","), F.lit(""))
    return F.coalesce(F.nullif(F.regexp_extract(s, r"([0-9]+)", 1), F.lit("")).try_cast("bigint"), F.lit(0))


def digits(c) -> Column:
    """NUM5 (sanitizeInteger): all digits joined, 0 default."""
    s = F.regexp_replace(col(c).cast("string"), r"[^0-9]", "")
    return F.coalesce(F.nullif(s, F.lit("")).try_cast("bigint"), F.lit(0))


def effective_price(price="price", sale="sale_price") -> Column:
    """NUM6: sale price, else price."""
    return F.coalesce(col(sale), col(price))


def discount_pct(price="price", sale="sale_price") -> Column:
    """NUM7: round((p - s) / p * 100, 2); null when either is missing or 0, or s >= p."""
    p, s = col(price), col(sale)
    ok = p.isNotNull() & s.isNotNull() & (p != 0) & (s != 0) & (s < p)
    return F.when(ok, F.round(F.lit(100.0) * (p - s) / p, 2))


def run_success_pct(products="products_scraped", reviews="reviews_scraped", rankings="rankings_scraped",
                    errors="errors_count") -> Column:
    """NUM8: round((total - errors) / total * 100, 2), total = products + reviews
    + rankings; 0 when the total is 0 (can be negative)."""
    total = col(products) + col(reviews) + col(rankings)
    return F.when(total == 0, F.lit(0.0)).otherwise(
        F.round(F.lit(100.0) * (total - col(errors)) / total, 2))


def repair_prices(price="price", sale="sale_price", platform="platform") -> tuple[Column, Column]:
    """NUM9: fix the (list, sale) pair.

    No list price → use the sale price (amazon, reliancedigital, bigbasket);
    meesho also clears the sale price then; reliancedigital swaps a sale price
    above the list price.  Returns (price, sale_price).
    """
    p, s, pl = col(price), col(sale), col(platform)
    fill = pl.isin("amazon", "reliancedigital", "bigbasket", "meesho") & p.isNull() & s.isNotNull()
    p1 = F.when(fill, s).otherwise(p)
    s1 = F.when(fill & (pl == "meesho"), F.lit(None)).otherwise(s)
    swap = (pl == "reliancedigital") & p1.isNotNull() & s1.isNotNull() & (s1 > p1)
    return F.when(swap, s1).otherwise(p1), F.when(swap, p1).otherwise(s1)


def currency_code(c) -> Column:
    """NUM10: symbol → ISO code; unknown symbols pass through (trimmed)."""
    t = F.trim(col(c))
    mapping = F.create_map(*[F.lit(x) for kv in CURRENCY_MAP.items() for x in kv])
    return F.coalesce(F.element_at(mapping, t), t)


# ---- SQL-text forms used by the bulk cleaning projection ----
def sanitize_price_sql(x: str, lo=schemas.PRICE_MIN, hi=schemas.PRICE_MAX) -> str:
    """SQL of NUM1."""
    num = (r"coalesce(try_cast(nullif(regexp_extract(replace(regexp_replace(pr, r'[^0-9.,]', ''), ',', ''), "
           r"r'^\s*([0-9]*\.?[0-9]+|[0-9]+\.?)', 1), '') AS DOUBLE), 0.0D)")
    inner = f"element_at(transform(array({num}), pv -> CASE WHEN pv BETWEEN {lo} AND {hi} THEN pv END), 1)"
    return f"element_at(transform(array(CAST({x} AS STRING)), pr -> CASE WHEN pr = '' THEN NULL ELSE {inner} END), 1)"


def rating_sql(x: str) -> str:
    """SQL of NUM4."""
    v = f"try_cast(nullif(regexp_extract(CAST({x} AS STRING), r'([0-9]+\\.?[0-9]*)', 1), '') AS DOUBLE)"
    return f"element_at(transform(array({v}), rv -> CASE WHEN rv BETWEEN 0 AND 5 THEN rv END), 1)"


def digits_sql(x: str) -> str:
    """SQL of NUM5 (sanitizeInteger)."""
    return f"coalesce(try_cast(nullif(regexp_replace(CAST({x} AS STRING), r'[^0-9]', ''), '') AS BIGINT), 0)"
