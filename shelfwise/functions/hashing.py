"""Content-derived identifiers and spec extraction (HSH1–HSH3, EXT1)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from shelfwise.operators.common import col, lit

# fixed values: review id prefix and md5 hex length per platform
CONTENT_ID = {"flipkart": ("FK_", 16), "vijaysales": ("VS_", 16), "reliancedigital": ("RD_", 12),
              "croma": ("CROMA_", 12), "bigbasket": ("BB_", 12)}


def content_id(c, prefix: str, n: int) -> Column:
    """HSH1: prefix + first ``n`` hex digits of md5(text)."""
    return F.concat(F.lit(prefix), F.left(F.md5(col(c)), F.lit(n)))


def content_id_for(c, platform) -> Column:
    """HSH1 by platform (null for platforms that do not hash)."""
    p = col(platform)
    out = None
    for code, (prefix, n) in CONTENT_ID.items():
        e = content_id(c, prefix, n)
        out = F.when(p == code, e) if out is None else out.when(p == code, e)
    return out


def reviewer_id(name, review_date, asof) -> Column:
    """HSH2: 'FD_' + reviewer (lower-cased, trimmed, runs of other characters
    than [a-z0-9] → '-', 'anonymous' when blank) + '_' + yyyymmdd (asof when the
    date is missing)."""
    n = F.lower(F.trim(col(name)))
    n = F.when(n.isNull() | (n == "") | (n == "0"), F.lit("anonymous")).otherwise(n)
    d = F.coalesce(col(review_date).cast("date"), F.to_date(lit(asof)))
    return F.concat(F.lit("FD_"), F.regexp_replace(n, "(?i)[^a-z0-9]+", "-"), F.lit("_"),
                    F.date_format(d, "yyyyMMdd"))


def review_hash(product_id, name, rating, text) -> Column:
    """HSH3: md5(product_id ‖ name ‖ rating ‖ first 50 *bytes* of the text).

    The byte cut can split a character; the hash is taken over the raw bytes.
    """
    head = F.substring(F.encode(F.coalesce(col(text), F.lit("")), "UTF-8"), 1, 50)
    prefix = F.encode(F.concat(F.coalesce(col(product_id).cast("string"), F.lit("")),
                               F.coalesce(col(name), F.lit("")),
                               F.coalesce(col(rating).cast("string"), F.lit(""))), "UTF-8")
    return F.md5(F.concat(prefix, head))


def specs_from_text(c) -> Column:
    """EXT1: '(n) GB RAM|Memory' → ram = 'nGB' (case-insensitive)."""
    n = F.regexp_extract(col(c), r"(?i)(\d+)\s*GB\s*(RAM|Memory)", 1)
    return F.when(n != "", F.concat(n, F.lit("GB")))
