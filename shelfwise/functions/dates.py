"""Date and duration scalars (DAT1–DAT5).

The text forms and date layouts are fixed values of the platforms' pages.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from shelfwise.operators.common import col, lit


def duration_seconds(start, end) -> Column:
    """DAT1: absolute seconds between two timestamps."""
    return F.abs(F.timestamp_diff("SECOND", col(start), col(end)))


def duration_label(c, style: str = "clock") -> Column:
    """DAT2: ``HH:MM:SS`` / ``MM:SS`` (style 'clock', ingest logs) or
    ``xh ym zs`` / ``ym zs`` / ``zs`` (style 'units', runs); 'N/A' when 0 or null."""
    s = col(c).cast("bigint")
    h, m, sec = F.floor(s / 3600), F.floor((s % 3600) / 60), s % 60
    if style == "clock":
        body = F.when(h > 0, F.format_string("%02d:%02d:%02d", h, m, sec)) \
            .otherwise(F.format_string("%02d:%02d", m, sec))
    else:
        body = (F.when(h > 0, F.format_string("%dh %dm %ds", h, m, sec))
                .when(m > 0, F.format_string("%dm %ds", m, sec))
                .otherwise(F.format_string("%ds", sec)))
    return F.when(s.isNull() | (s == 0), F.lit("N/A")).otherwise(body)


def review_date(c, asof) -> Column:
    """DAT3: review date from the text forms the platforms print.

    "... on 15 January 2024" (d MMMM yyyy); "15/01/2024" (d/M/yyyy); a relative
    "N day(s)/week(s)/month(s)/year(s) ago" counted back from ``asof``; "Jun, 2023"
    (month and year, day 1); else an ISO date.  Null when nothing parses.
    """
    t = col(c)
    a = F.to_date(lit(asof))
    on = F.regexp_extract(t, r"on\s+(\d+\s+\w+\s+\d{4})", 1)
    dmy = F.regexp_extract(t, r"(\d{1,2}/\d{1,2}/\d{4})", 1)
    rel = r"(?i)(\d+)\s+(day|week|month|year)s?\s+ago"
    n = F.regexp_extract(t, rel, 1).try_cast("int")
    unit = F.lower(F.regexp_extract(t, rel, 2))
    relative = (F.when(unit == "day", F.date_sub(a, n)).when(unit == "week", F.date_sub(a, n * 7))
                .when(unit == "month", F.add_months(a, -n)).when(unit == "year", F.add_months(a, -12 * n)))
    my = F.regexp_extract(t, r"([A-Za-z]+),?\s+(\d{4})", 0)
    month_year = F.try_to_timestamp(F.regexp_replace(my, ",", ""), F.lit("MMM yyyy"))
    iso = F.regexp_extract(t, r"(\d{4}-\d{2}-\d{2})", 1)
    return F.coalesce(
        F.to_date(F.try_to_timestamp(F.nullif(on, F.lit("")), F.lit("d MMMM yyyy"))),
        F.to_date(F.try_to_timestamp(F.nullif(dmy, F.lit("")), F.lit("d/M/yyyy"))),
        F.when(n.isNotNull(), relative),
        F.to_date(month_year),
        F.to_date(F.try_to_timestamp(F.nullif(iso, F.lit("")), F.lit("yyyy-MM-dd"))),
    )


def release_date(c) -> Column:
    """DAT4: first of three layouts that parses: '15 January 2024', 'January 15, 2024', '2024-01-15'."""
    t = F.trim(col(c))
    return F.coalesce(*[F.to_date(F.try_to_timestamp(t, F.lit(f))) for f in
                        ("d MMMM yyyy", "MMMM d, yyyy", "yyyy-MM-dd")])


def hours_since(c, asof) -> Column:
    """DAT5: whole hours from ``c`` to ``asof``."""
    return F.timestamp_diff("HOUR", col(c), lit(asof))


def elapsed_label(c, asof) -> Column:
    """DAT5: '3 days ago' — the largest whole unit from ``c`` to ``asof``, 'from now' for a later ``c``, null for null."""
    a, b = F.least(col(c), lit(asof)), F.greatest(col(c), lit(asof))
    whole = lambda unit: F.timestamp_diff(unit, a, b)
    say = lambda n, unit: F.concat(n.cast("string"), F.lit(f" {unit}"), F.when(n == 1, "").otherwise("s"))
    months, days = whole("MONTH"), whole("DAY")
    size = (F.when(months >= 12, say(F.floor(months / 12), "year"))
            .when(months >= 1, say(months, "month"))
            .when(days >= 7, say(F.floor(days / 7), "week"))
            .when(days >= 1, say(days, "day"))
            .when(whole("HOUR") >= 1, say(whole("HOUR"), "hour"))
            .when(whole("MINUTE") >= 1, say(whole("MINUTE"), "minute"))
            .otherwise(say(whole("SECOND"), "second")))
    return F.when(col(c).isNotNull() & lit(asof).isNotNull(),
                  F.concat(size, F.when(col(c) > lit(asof), F.lit(" from now")).otherwise(" ago")))


def within_cooldown(c, asof, hours: int = 12) -> Column:
    """DAT5: true when the last run is less than ``hours`` before ``asof``."""
    return hours_since(c, asof) < hours
