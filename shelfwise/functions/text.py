"""Text scalars (STR1–STR10) as native Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from shelfwise.operators.common import bind, col

# fixed values: tag and whitespace patterns, allowed characters of sanitize_string
TAG = r"<[^>]*>"
SPACES = r"\s+"
NOT_ALLOWED = r"[^\p{L}\p{N}\s\-_.,()&/]"

# fixed values: brand spellings (lower-case key -> canonical form)
BRAND_MAP = {
    "hp": "HP", "dell": "Dell", "lenovo": "Lenovo", "asus": "ASUS", "acer": "Acer", "apple": "Apple",
    "msi": "MSI", "samsung": "Samsung", "lg": "LG", "sony": "Sony", "toshiba": "Toshiba",
    "fujitsu": "Fujitsu", "alienware": "Alienware", "razer": "Razer",
}


def falsy_to_null(c: Column) -> Column:
    """PHP truthiness on strings: '' and '0' are false → null."""
    return bind(c, lambda x: F.when(x.isin("", "0"), F.lit(None).cast("string")).otherwise(x))


def byte_cut(c: Column, max_bytes: int | None) -> Column:
    """Cut to at most ``max_bytes`` UTF-8 bytes without splitting a character:
    count how many whole characters of the first ``max_bytes`` fit, keep those."""
    if not max_bytes:
        return c

    def go(x):
        chars = F.regexp_extract_all(F.left(x, F.lit(max_bytes)), F.lit("(?s)."), 0)
        fit = F.aggregate(
            F.transform(chars, lambda ch: F.octet_length(ch)),
            F.struct(F.lit(0).alias("b"), F.lit(0).alias("k")),
            lambda a, n: F.when(a["b"] + n <= max_bytes,
                                F.struct((a["b"] + n).alias("b"), (a["k"] + 1).alias("k")))
            .otherwise(F.struct(F.lit(max_bytes + 1).alias("b"), a["k"].alias("k"))))
        return F.when(F.octet_length(x) > max_bytes, F.left(x, fit["k"])).otherwise(x)
    return bind(c, go)


def strip_tags(c) -> Column:
    return F.regexp_replace(col(c), TAG, "")


def clean_text(c) -> Column:
    """STR3: strip tags, collapse whitespace, trim; null on falsy input."""
    c = falsy_to_null(col(c))
    return F.trim(F.regexp_replace(strip_tags(c), SPACES, " "))


def sanitize_text(c, max_bytes: int | None = None) -> Column:
    """STR2: strip tags, collapse whitespace, trim, optional byte cut; falsy → null."""
    c = col(c)
    out = F.trim(F.regexp_replace(strip_tags(c), SPACES, " "))
    return falsy_to_null(byte_cut(out, max_bytes))


def sanitize_string(c, max_bytes: int | None = None) -> Column:
    """STR1: as STR2, then drop characters outside letters, digits, whitespace
    and ``-_.,()&/`` (after the trim, as the reference does)."""
    c = col(c)
    out = F.trim(F.regexp_replace(strip_tags(c), SPACES, " "))
    out = F.regexp_replace(out, NOT_ALLOWED, "")
    return falsy_to_null(byte_cut(out, max_bytes))


def ucfirst(c: Column) -> Column:
    return F.concat(F.upper(F.substring(c, 1, 1)), F.substring(c, 2, 1 << 30))


def normalize_brand(c) -> Column:
    """STR4: sanitize, then canonical spelling for known brands, else upper-case
    the first letter (not ``initcap``: the rest is kept as is)."""
    mapping = F.create_map(*[F.lit(x) for kv in BRAND_MAP.items() for x in kv])
    return bind(sanitize_string(c), lambda s: F.coalesce(F.element_at(mapping, F.lower(s)), ucfirst(s)))


def slug(c) -> Column:
    """STR5: lower-case, runs of non ``[a-z0-9]`` → '-', trimmed of '-'."""
    s = F.regexp_replace(F.lower(col(c)), "[^a-z0-9]+", "-")
    return F.regexp_replace(s, "^-+|-+$", "")


def truncate(c, n: int) -> Column:
    """STR6: keep the first ``n`` characters (the reference meant to; its copy was discarded)."""
    return F.left(col(c), F.lit(n))


def spec_key(c) -> Column:
    """STR7: snake_case key: lower-case, spaces → '_'."""
    return F.lower(F.replace(col(c), F.lit(" "), F.lit("_")))


def strip_label(c, label: str = "Fulfilled by") -> Column:
    """STR8: remove a label (case-insensitive) and trim."""
    import re
    return F.trim(F.regexp_replace(col(c), "(?i)" + re.escape(label), ""))


def label(c, mapping: dict) -> Column:
    """STR9: value → display label (e.g. True→'Active'); unknown values pass through."""
    c = col(c)
    out = None
    for k, v in mapping.items():
        out = (F.when(c == F.lit(k), F.lit(v)) if out is None else out.when(c == F.lit(k), F.lit(v)))
    return out.otherwise(c.cast("string"))


def brand_from_title(c) -> Column:
    """STR10: brand guess — drop trailing whitespace and anything from the first
    number of the tail on."""
    return F.regexp_replace(col(c), r"\s+(?:\d+.*)?$", "")


# ---- SQL-text forms (one parse on the JVM instead of many Python→JVM calls) ----
def bind_sql(value: str, var: str, body: str) -> str:
    """SQL of :func:`shelfwise.operators.common.bind`."""
    return f"element_at(transform(array({value}), {var} -> {body}), 1)"


def falsy_sql(x: str) -> str:
    return bind_sql(x, "fv", "CASE WHEN fv IN ('', '0') THEN NULL ELSE fv END")


def _collapse_sql(x: str) -> str:
    return f"trim(regexp_replace(regexp_replace({x}, r'{TAG}', ''), r'{SPACES}', ' '))"


def sanitize_string_sql(x: str) -> str:
    """SQL of STR1 over column / expression ``x``."""
    return falsy_sql(f"regexp_replace({_collapse_sql(x)}, r'{NOT_ALLOWED}', '')")


def sanitize_text_sql(x: str) -> str:
    """SQL of STR2 over column / expression ``x``."""
    return falsy_sql(_collapse_sql(x))
