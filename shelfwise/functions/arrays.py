"""Array, map and JSON scalars (ARR1–ARR5, JSN1)."""

from __future__ import annotations

import json
import re as plain
from collections.abc import Iterator

import pandas as pd
import regex as re
from pyspark.sql import Column
from pyspark.sql import functions as F

from shelfwise.functions.text import NOT_ALLOWED, SPACES, TAG, sanitize_string
from shelfwise.functions.urls import sanitize_url
from shelfwise.operators.common import bind, col

# fixed values: list separators per platform
JOIN_SEPARATORS = {"amazon": "; ", "flipkart": " | ", "bigbasket": " > ", "default": ", "}


def sanitize_urls(c) -> Column:
    """ARR1: sanitize each url, drop the invalid ones, null when none is left."""
    out = F.filter(F.transform(col(c), lambda u: sanitize_url(u)), lambda u: u.isNotNull())
    return F.when(F.size(out) > 0, out)


def last_of_key(entries: Column) -> Column:
    """Of an array of (k, v) entries, those whose key does not come again later.

    ``entries`` should be a bound value: a lambda evaluates what it refers to once per element.
    """
    later = lambda i: F.slice(entries, i + 2, F.size(entries))
    return F.filter(entries, lambda e, i: ~F.exists(later(i), lambda q: q["k"] == e["k"]))


def sanitize_array(c) -> Column:
    """ARR2: text → map of cleaned key/values.

    A JSON object is parsed as such; other text is split on , ; or | into
    items, each kept under its position.  Keys and values go through
    sanitize_string (a key that cleans to nothing keeps its raw text); entries
    whose value cleans to nothing are dropped; when two keys clean to the same
    text the later entry wins; null when nothing is left.
    """
    t = col(c)
    as_map = F.from_json(t, "map<string,string>")
    parts = F.split(t, r"[,;|]")
    split_map = F.map_from_arrays(
        F.transform(F.sequence(F.lit(0), F.greatest(F.size(parts) - 1, F.lit(0))), lambda i: i.cast("string")),
        F.slice(F.concat(parts, F.array(F.lit(None).cast("string"))), 1, F.greatest(F.size(parts), F.lit(1))))
    chosen = F.when(F.trim(t).startswith("{") & as_map.isNotNull(), as_map).when(t.isNotNull(), split_map)
    cleaned = F.transform(F.map_entries(chosen), lambda e: F.struct(
        F.coalesce(sanitize_string(e["key"]), e["key"]).alias("k"), sanitize_string(e["value"]).alias("v")))
    kept = F.filter(cleaned, lambda e: e["v"].isNotNull())
    return bind(kept, lambda held: F.when(F.size(held) > 0, F.map_from_entries(last_of_key(held))))


_SPACES, _NOT_ALLOWED = re.compile(SPACES), re.compile(NOT_ALLOWED)
#: The same for ASCII text, in the faster engine with the classes spelled out.
_TAG, _SPACES_ASCII, _NOT_ALLOWED_ASCII = (plain.compile(p) for p in (TAG, "[ \t\n\r\f\v]+", r"[^A-Za-z0-9 \t\n\r\f\v\-_.,()&/]"))
#: Text that sanitize_string leaves as it is: allowed ASCII characters, single spaces inside.
_CLEAN = plain.compile(r"[A-Za-z0-9\-_.,()&/]++(?: [A-Za-z0-9\-_.,()&/]++)*+").fullmatch


def _clean(x) -> str | None:
    """sanitize_string of a JSON scalar as text (true is '1', false and null are empty)."""
    t = "" if x is None or x is False else "1" if x is True else str(x)
    if t and not _CLEAN(t):
        spaces, not_allowed = (_SPACES_ASCII, _NOT_ALLOWED_ASCII) if t.isascii() else (_SPACES, _NOT_ALLOWED)
        t = not_allowed.sub("", spaces.sub(" ", _TAG.sub("", t)).strip(" "))
    return None if t in ("", "0") else t


def _clean_nested(x):
    """Cleaned copy of a JSON object or list; None when nothing is left.  A list that loses entries keeps their positions as keys."""
    out: dict = {}
    for k, v in x.items() if isinstance(x, dict) else enumerate(x):
        value = _clean_nested(v) if isinstance(v, (dict, list)) else _clean(v)
        if value is not None:
            key = (_clean(k) or k) if isinstance(k, str) else k
            out.pop(key, None)
            out[key] = value
    if isinstance(x, list) and list(out) == list(range(len(out))):
        return list(out.values()) or None
    return {str(k): v for k, v in out.items()} or None


def sanitize_nested(c) -> Column:
    """ARR2 / JSN1 to any depth: JSON text whose objects and lists are cleaned as :func:`sanitize_array` does.

    Keys and values go through sanitize_string, entries that clean to nothing are dropped,
    of equal keys the later counts.  Text that is no JSON is split on , ; or |.  Null for
    null and for JSON scalars, and when nothing is left.
    """
    @F.pandas_udf("string")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode = json.JSONEncoder(ensure_ascii=False, separators=(",", ":")).encode
        for s in batches:
            out = []
            for t in s:
                try:
                    x = json.loads(t) if isinstance(t, str) and t else None
                except ValueError:
                    x = re.split(r"[,;|]", t)
                done = _clean_nested(x) if isinstance(x, (dict, list)) else None
                out.append(None if done is None else encode(done))
            yield pd.Series(out, dtype=object)

    return of(col(c))


def first_distinct(c, k: int) -> Column:
    """ARR3: de-duplicate keeping first occurrences, then the first ``k``."""
    return F.slice(F.array_distinct(col(c)), 1, k)


def join_list(c, platform: str = "default") -> Column:
    """ARR4: join a list with the platform's separator."""
    return F.array_join(col(c), JOIN_SEPARATORS.get(platform, JOIN_SEPARATORS["default"]))


def primary_image(c) -> Column:
    """ARR5: first element or null."""
    return F.try_element_at(col(c), F.lit(1))


def parse_json_list(c) -> Column:
    """JSN1: JSON text → array of strings (null when not a JSON array)."""
    return F.from_json(col(c), "array<string>")


def to_json_list(c) -> Column:
    """JSN1: array → JSON text."""
    return F.to_json(col(c))
