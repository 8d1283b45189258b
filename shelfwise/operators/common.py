"""Small Column helpers shared by the operator modules."""

from __future__ import annotations

import uuid
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfwise.session import checkpoint_dir


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once under ``spark.checkpoint.dir`` and read back: cuts the lineage of iterative jobs in shared storage."""
    path = f"{checkpoint_dir(df.sparkSession).rstrip('/')}/steps/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def lit(v) -> Column:
    """A Column for ``v`` (a Column passes through).

    A naive ``datetime`` is a wall-clock value and becomes a timestamp_ntz
    literal, so comparisons with the (zone-less) data do not depend on the
    session time zone.
    """
    if isinstance(v, Column):
        return v
    if isinstance(v, datetime) and v.tzinfo is None:
        return F.lit(v.isoformat(sep=" ")).cast("timestamp_ntz")
    return F.lit(v)


def col(c) -> Column:
    return c if isinstance(c, Column) else F.col(c)


def latest(df: DataFrame, column: str) -> Column:
    """``max(column)`` of ``df`` as a scalar subquery: the registry's ``asof``.

    Evaluated once by Spark as an uncorrelated subquery — no driver round trip
    and no join against the data.
    """
    return df.select(F.max(column)).scalar()


def ago(asof, n: int, unit: str = "DAYS") -> Column:
    """``asof - INTERVAL n unit``."""
    return lit(asof) - F.expr(f"INTERVAL {int(n)} {unit}")


def since(column, asof, n: int, unit: str = "DAYS") -> Column:
    """Trailing window predicate ``column >= asof - n unit`` (FIL6)."""
    return col(column) >= ago(asof, n, unit)


def pct(num: Column, den: Column, digits: int) -> Column:
    """``round(100 * num / den, digits)`` as double, 0 when ``den`` is 0."""
    return (F.when(den > 0, F.round(F.lit(100.0) * num / den, digits))
            .otherwise(F.lit(0.0)).cast("double"))


def round_avg(c, digits: int = 2) -> Column:
    """Average rounded half-up, as double (DuckDB averages decimals as doubles)."""
    return F.round(F.avg(c), digits).cast("double")



def bind(value: Column, fn) -> Column:
    """Evaluate ``value`` once and give it to ``fn``, which may use it many times.

    Column expressions are trees: using a sub-expression twice (in a CASE
    condition and its result, say) evaluates it twice, and Spark does not
    de-duplicate inside conditional branches.  Routing the value through a
    one-element array lambda computes it exactly once per row.
    """
    return F.element_at(F.transform(F.array(value), fn), 1)


EPOCH_NTZ = "TIMESTAMP_NTZ'1970-01-01 00:00:00'"


def ntz_micros(c) -> Column:
    """Microseconds since the epoch of a wall-clock (timestamp_ntz) value — no time zone involved."""
    return F.timestamp_diff("MICROSECOND", F.expr(EPOCH_NTZ), col(c))


def ntz_to_instant(c) -> Column:
    """timestamp_ntz → timestamp, reading the wall clock as UTC whatever the session zone
    (event-time windows and watermarks need TIMESTAMP)."""
    return F.timestamp_micros(ntz_micros(c))


def instant_to_ntz(c) -> Column:
    """Inverse of :func:`ntz_to_instant`."""
    return F.timestamp_add("MICROSECOND", F.unix_micros(col(c)), F.expr(EPOCH_NTZ))
