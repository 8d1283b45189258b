"""Document fingerprints: a quartile bucket digest of hashed byte triplets.

Every three consecutive bytes of the UTF-8 text are hashed to one of ``BUCKETS`` counters.
The quartiles of the counters turn each into two bits (in which quarter it lies), so the
digest depends on the shape of the counts, not on their size.  A header of two bytes holds
the length (eight steps an octave) and the two quartile ratios.  Two digests differ by the
sum of the bucket distances and of what the headers differ by; the sum is bounded and
``likeness`` is what is left of the bound, 1 for equal digests and never below 0.

Null and empty texts have the digest of no bytes.  Texts under three bytes have empty
counters and differ by their length only.  Long texts are counted in pieces of ``PIECE`` bytes.

``with_neighbours`` compares each document with an edited form of itself and with the
document that follows in descending key order.  One global sort puts neighbours into the
same partition; only the last row of a partition waits for the first row of the next one,
and those rows (one a partition) are joined afterwards.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfwise.llm.common import stored

BUCKETS = 1024
PIECE = 1 << 20
#: What two buckets none, one, two and three quarters apart add to the difference.
STEP = np.array([0, 1, 2, 3], np.int64)
#: What a step of the length code, and of a quartile ratio, adds; at most so many steps count.
LENGTH_STEP, LENGTH_MOST, RATIO_STEP = 2, 24, 2
#: Differences from this on are no likeness at all: unrelated quarters differ by 1.25 on average.
BOUND = int(BUCKETS * 1.25)


def bucket_counts(data: bytes) -> np.ndarray:
    """How many byte triplets of ``data`` fall into each bucket."""
    counts = np.zeros(BUCKETS, np.int64)
    shift = np.uint32(32 - (BUCKETS - 1).bit_length())
    for at in range(0, max(len(data) - 2, 0), PIECE):
        b = np.frombuffer(data, np.uint8, min(PIECE + 2, len(data) - at), at).astype(np.uint32)
        triplet = b[:-2] | b[1:-1] << np.uint32(8) | b[2:] << np.uint32(16)
        mixed = triplet * np.uint32(0x9E3779B1)
        mixed ^= mixed >> np.uint32(15)
        counts += np.bincount((mixed * np.uint32(0x85EBCA77)) >> shift, minlength=BUCKETS)
    return counts


def length_code(n: int) -> int:
    """Eight steps for each doubling of the length; 0 to 7 as they are, 255 at most."""
    if n < 8:
        return n
    e = n.bit_length() - 4
    return min(e * 8 + (n >> e), 255)


def digest(text: str | None) -> bytes:
    """Two header bytes (length; quartile ratios as nibbles), then two bits a bucket."""
    data = text.encode("utf-8", "replace") if isinstance(text, str) else b""
    counts = bucket_counts(data)
    cuts = [BUCKETS // 4 - 1, BUCKETS // 2 - 1, 3 * BUCKETS // 4 - 1]
    q1, q2, q3 = np.partition(counts, cuts)[cuts].tolist()
    quarter = ((counts > q1).view(np.uint8) + (counts > q2) + (counts > q3)).astype(np.uint8).reshape(-1, 4)
    ratios = (15 * q1 // q3 << 4 | 15 * q2 // q3) if q3 else 0
    packed = quarter[:, 0] << 6 | quarter[:, 1] << 4 | quarter[:, 2] << 2 | quarter[:, 3]
    return bytes([length_code(len(data)), ratios]) + packed.tobytes()


#: The quarters that a body byte holds, for every value of the byte.
_QUARTERS = (np.arange(256)[:, None] >> np.array([6, 4, 2, 0]) & 3).astype(np.int8)


def difference(a: bytes, b: bytes) -> int:
    """Bounded distance of two digests: buckets, then length and quartile ratios."""
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    far = STEP @ np.bincount(np.abs(_QUARTERS[x[2:]] - _QUARTERS[y[2:]]).ravel(), minlength=4)
    steps = min(abs(int(x[0]) - int(y[0])), LENGTH_MOST)
    ratio = abs((int(x[1]) >> 4) - (int(y[1]) >> 4)) + abs((int(x[1]) & 15) - (int(y[1]) & 15))
    return min(int(far) + LENGTH_STEP * steps + RATIO_STEP * ratio, BOUND)


def likeness(a: bytes, b: bytes) -> float:
    """1 for equal digests, 0 for a difference of BOUND or more."""
    return 1.0 - difference(a, b) / BOUND


def with_digest(docs: DataFrame, text: str = "text", out: str = "fingerprint") -> DataFrame:
    """``docs`` with the digest of ``text`` in lowercase hex; a column ``out`` already there is replaced."""
    @F.pandas_udf("string")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield s.map(lambda t: digest(t).hex(), na_action=None)

    return docs.withColumn(out, of(F.col(text)))


def likeness_of(a, b) -> F.Column:
    """Likeness of two hex digest columns; null if either is."""
    @F.pandas_udf("double")
    def of(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([likeness(bytes.fromhex(p), bytes.fromhex(q)) if isinstance(p, str) and isinstance(q, str) else None for p, q in zip(x, y)], dtype="float64")

    return of(F.col(a) if isinstance(a, str) else a, F.col(b) if isinstance(b, str) else b)


def edited_by(text: str, after: str, share: int = 3) -> str:
    """``text`` whose last floor(length/share) code points are the first as many (or all) of ``after``."""
    k = len(text) // share
    return text[:len(text) - k] + after[:k]


#: kind 0: a finished row; 1: the last row of a partition, its text waiting; 2: the first row's text.
_FIELDS = [("n_chars", T.LongType()), ("fingerprint", T.StringType()), ("edited_sha256", T.StringType()), ("edited_fingerprint", T.StringType()),
           ("near_edited", T.DoubleType()), ("near_next", T.DoubleType())]


def _compared(text: str, own: bytes, after: str, next_own: bytes, keep: bool) -> tuple:
    new = edited_by(text, after)
    d = digest(new)
    return (len(text), own.hex(), sha256(new.encode("utf-8", "replace")).hexdigest(), d.hex(), likeness(own, d), likeness(own, next_own), new if keep else None)


def with_neighbours(docs: DataFrame, key: str = "doc_id", text: str = "text", keep_text: bool = False) -> DataFrame:
    """One row per row of ``docs``: key, n_chars, fingerprint, edited_sha256, edited_fingerprint, near_edited, near_next (and edited).

    The next document is that of the next smaller key, after the last the first again; a
    document alone is its own neighbour.  Rows of equal key are ordered by a hash of the
    text, null keys come last.  Null texts count as empty.  Other columns are not read.
    """
    key_type = docs.schema[key].dataType
    body = [T.StructField(n, t) for n, t in _FIELDS] + [T.StructField("edited", T.StringType())]
    flat = T.StructType([T.StructField("kind", T.IntegerType()), T.StructField("place", T.IntegerType()), T.StructField("doc", T.StringType()),
                         T.StructField("waiting", T.StringType())] + body)
    names = [f.name for f in flat]

    def along(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        place, last = TaskContext.get().partitionId(), None
        blank = (None,) * (len(_FIELDS) - 2)
        for pdf in batches:
            out = []
            for doc, t in zip(pdf["doc"].tolist(), pdf["t"].tolist()):
                t = t if isinstance(t, str) else ""
                own = digest(t)
                if last is None:
                    out.append((2, place, None, t, None, own.hex(), *blank, None))
                else:
                    out.append((0, place, last[0], None, *_compared(last[1], last[2], t, own, keep_text)))
                last = (doc, t, own)
            yield pd.DataFrame(out, columns=names, dtype=object)
        if last is not None:
            yield pd.DataFrame([(1, place, last[0], last[1], None, last[2].hex(), *blank, None)], columns=names, dtype=object)

    order = [F.col("doc").desc_nulls_last(), F.xxhash64("t"), F.monotonically_increasing_id()]
    rows = docs.select(F.col(key).alias("doc"), F.col(text).alias("t")).orderBy(*order).withColumn("doc", F.col("doc").cast("string"))
    parts = stored(rows.mapInPandas(along, flat), "fingerprint-rows")
    heads = parts.where("kind = 2").select(F.col("place").alias("head"), F.col("waiting").alias("after"), F.col("fingerprint").alias("after_fingerprint"))
    # one row per partition of the sort, without texts
    every = Window.orderBy("head").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    follows = heads.select(F.col("head").alias("place"), F.coalesce(F.lead("head").over(Window.orderBy("head")), F.first("head").over(every)).alias("head"))
    tails = parts.where("kind = 1").select("place", "doc", "waiting", "fingerprint").join(follows, "place").join(heads, "head")

    def finish(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame([(doc, *_compared(t, bytes.fromhex(own), after, bytes.fromhex(next_own), keep_text))
                                for doc, t, own, after, next_own in zip(*(pdf[c].tolist() for c in ("doc", "waiting", "fingerprint", "after", "after_fingerprint")))],
                               columns=["doc", *(f.name for f in body)], dtype=object)

    ends = tails.mapInPandas(finish, T.StructType([T.StructField("doc", T.StringType()), *body]))
    shown = [n for n, _ in _FIELDS] + (["edited"] if keep_text else [])
    return parts.where("kind = 0").select("doc", *shown).union(ends.select("doc", *shown)).select(F.col("doc").cast(key_type).alias(key), *shown)
