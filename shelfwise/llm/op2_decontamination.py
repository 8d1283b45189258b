"""Benchmark decontamination by winnowing.

Every window of ``n`` item words contains ``n - k + 1`` k-grams; the one of least hash
(the rightmost of equals) is its fingerprint.  A document keeps the fingerprint of each
of its own windows, so a window that occurs in both gives the same fingerprint in both:
no shared span of ``n`` words is missed.  Document and benchmark fingerprints are
joined; around every hit the windows that could have chosen it are cut out of the
document and joined with the item windows by their words, which makes the result exact.

Items shorter than ``n`` words are one window each; each length present is winnowed with
its own k, so the guarantee holds for them too.

The benchmark side is reduced to distinct fingerprints and distinct windows.  Each is
broadcast only when its stored row count is under ``common.BROADCAST_ROWS``; else Spark
shuffles both sides (AQE splits a fingerprint that many documents share).  Documents are
named by a content hash in the first pass, so copies of a text share their hits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwise.llm.common import maybe_broadcast, stored, text_key

WORDS = 10
K = 5
KEEP = 1_000_000

#: bytes -> lower-cased word byte, or a space (ASCII other than letters and digits).
_FORM = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))


def words(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "replace").translate(_FORM).split() if isinstance(text, str) else []


class Known(dict):
    """Words' hashes, made as they are asked for."""

    def __missing__(self, word: bytes) -> int:
        h = self[word] = xxhash.xxh64_intdigest(word, 7)
        return h


class Hasher:
    """64-bit hashes of words, remembered up to ``KEEP`` words."""

    def __init__(self):
        self.known = Known()

    def __call__(self, ws: list[bytes]) -> np.ndarray:
        if len(self.known) > KEEP:
            self.known.clear()
        return np.fromiter(map(self.known.__getitem__, ws), np.uint64, len(ws))


def gram_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k words from each position (fewer results than words by k - 1)."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for j in range(k):
        out = out * np.uint64(0x9E3779B97F4A7C15) + (h[j:j + n] ^ (h[j:j + n] >> np.uint64(29)))
    out ^= out >> np.uint64(31)
    out *= np.uint64(0xBF58476D1CE4E5B9)
    return out ^ (out >> np.uint64(30))


def window_minima(g: np.ndarray, w: int) -> np.ndarray:
    """Position of the least (rightmost) k-gram hash of each window of w k-grams."""
    m = len(g) - w + 1
    if m <= 0:
        return np.zeros(0, np.int64)
    best, at = g[:m].copy(), np.arange(m)
    for s in range(1, w):
        c = g[s:s + m]
        less = c <= best
        best[less] = c[less]
        at[less] = np.flatnonzero(less) + s
    return at


def shape(n: int) -> tuple[int, int]:
    """(k, k-grams per window) for windows of n words."""
    k = min(K, n)
    return k, n - k + 1


def _item_windows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    hasher = Hasher()
    for pdf in batches:
        out = []
        for item, x in zip(pdf["item"], pdf["t"]):
            ws = words(x)
            if not ws:
                continue
            n = min(WORDS, len(ws))
            k, w = shape(n)
            g = gram_hashes(hasher(ws), k)
            for i, p in enumerate(window_minima(g, w)):
                out.append((b" ".join(ws[i:i + n]).decode("utf-8", "replace"), n, int(g[p].view(np.int64)), item))
        yield pd.DataFrame(out, columns=["w", "n", "h", "item"])


def _fingerprints(lengths: list[int]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hasher = Hasher()
        for pdf in batches:
            keys, texts = pdf["th"].to_numpy(), pdf["t"]
            at = 0
            while at < len(texts):
                hs, owner, held = [], [], 0
                while at < len(texts) and held < 400_000:
                    h = hasher(words(texts.iat[at]))
                    hs.append(h)
                    owner.append(np.full(len(h), at))
                    held += len(h)
                    at += 1
                h, own = np.concatenate(hs), np.concatenate(owner)
                for n in lengths:
                    k, w = shape(n)
                    g = gram_hashes(h, k)
                    pos = window_minima(g, w)
                    # windows that lie within one text
                    inside = own[:len(pos)] == own[n - 1:n - 1 + len(pos)]
                    pos = np.unique(pos[inside])
                    if len(pos):
                        first = np.searchsorted(own, own[pos], side="left")
                        yield pd.DataFrame({"th": keys[own[pos]], "n": np.int32(n), "pos": (pos - first).astype(np.int32), "h": g[pos].view(np.int64)})

    return run


def _extend(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """A base row per document, and a row per window that may have chosen a hit fingerprint."""
    for pdf in batches:
        out = []
        for row, th, x, hits in zip(pdf["row"], pdf["th"], pdf["t"], pdf["hits"]):
            ws = words(x)
            out.append((row, th, len(ws), None, None, None))
            if hits is None:
                continue
            spans = set()
            for hit in hits:
                n, p = hit["n"], hit["pos"]
                spans.update((s, n) for s in range(max(0, p - (n - shape(n)[0])), min(p, len(ws) - n) + 1))
            out += [(row, th, None, s, n, b" ".join(ws[s:s + n]).decode("utf-8", "replace")) for s, n in sorted(spans)]
        yield pd.DataFrame({c: pd.Series([r[i] for r in out], dtype=t) for i, (c, t) in enumerate(
            [("row", object), ("th", "int64"), ("n_words", "Int64"), ("start", "Int32"), ("n", "Int32"), ("w", object)])})


def decontaminate(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text",
                  item_key: str = "item_id", item_text: str = "text") -> DataFrame:
    """One row per row of ``docs``: key, n_words, n_hit, items (sorted strings), n_items, contaminated, th.

    ``n_hit`` counts words inside any occurrence of an item window; ``items`` are the ids
    of items with such windows (null ids are not listed, their windows still hit); ``th``
    is ``common.text_key`` of the text, to join decisions back.  Null and empty texts have
    no words.  Repeated rows give repeated results.
    """
    items = stored(benchmark.select(F.col(item_key).cast("string").alias("item"), F.col(item_text).alias("t"))
                   .mapInPandas(_item_windows, "w string, n int, h long, item string")
                   .groupBy("w", "n", "h").agg(F.collect_set("item").alias("items")), "item-windows")
    prints = stored(items.select("n", "h").distinct(), "item-prints")
    lengths = sorted(r["n"] for r in items.select("n").distinct().collect())  # at most WORDS values
    base = docs.select(F.col(key).cast("string").alias("row"), text_key(F.col(text)).alias("th"), F.col(text).alias("t"))
    hits = stored(base.select("th", "t").mapInPandas(_fingerprints(lengths), "th long, n int, pos int, h long")
                  .join(maybe_broadcast(prints, prints.count()), ["n", "h"])
                  .select("th", F.struct("n", "pos").alias("hit")).distinct()
                  .groupBy("th").agg(F.collect_list("hit").alias("hits")), "doc-hits")
    cut = base.join(hits, "th", "left").select("row", "th", "t", "hits").mapInPandas(
        _extend, "row string, th long, n_words long, start int, n int, w string")
    cut = stored(cut, "doc-windows")
    found = (cut.where("w IS NOT NULL").join(maybe_broadcast(items, items.count()), ["w", "n"])
             .select("row", "th", F.lit(None).cast("long").alias("n_words"), F.struct("start", "n").alias("span"), "items"))
    plain = cut.where("w IS NULL").select("row", "th", "n_words", F.lit(None).cast(found.schema["span"].dataType).alias("span"),
                                          F.lit(None).cast("array<string>").alias("items"))
    kind = docs.schema[key].dataType
    covered = F.array_distinct(F.flatten(F.transform("spans", lambda s: F.sequence(s["start"], s["start"] + s["n"] - 1))))
    return (plain.unionByName(found).groupBy("row", "th")
            .agg(F.count("n_words").cast("int").alias("copies"), F.max("n_words").alias("n_words"),
                 F.collect_set("span").alias("spans"), F.collect_set("items").alias("items"))
            .select(F.col("row").cast(kind).alias(key), "th", "n_words", "copies", F.size(covered).cast("long").alias("n_hit"),
                    F.array_sort(F.array_distinct(F.flatten("items"))).alias("items"))
            .withColumn("copy", F.explode(F.sequence(F.lit(1), "copies")))
            .select(key, "n_words", "n_hit", "items", F.size("items").cast("long").alias("n_items"),
                    (F.col("n_hit") > 0).alias("contaminated"), "th"))
