"""Periodic run detection by descending-LCP Kruskal.

A run is a stretch of consecutive words with smallest period q, at least ``max(shortest,
exponent * q)`` words long, that neither neighbour extends with that period.  If it starts
at s and has length L, the suffixes at s and s + q share exactly L - q words, and no suffix
between them shares as many.  So suffix classes are united in order of decreasing LCP (the
edges of neighbours in the suffix array, as Kruskal takes them), each class keeping its
positions in order; two positions that become neighbours at distance p within the LCP seed
a run of period p, and the pair that no word to the left extends is the run itself.

The suffix order comes from sorting by three words and doubling the length on the suffixes
that are still tied, all texts of a batch at once (a word of one text never equals one of
another).  A run needs an LCP of ``least_lcp(...)`` words, so smaller classes are not united.

Each row is worked on alone, whatever the others are, so nothing is shuffled.  A batch holds
``WORDS`` words or one longer text.  Null, empty and blank texts have no words and no runs.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import defaultdict
from collections.abc import Callable, Iterator
from itertools import compress, count

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WORDS = 1 << 18
RESULT = "struct<n_words: long, runs: array<struct<start: long, length: long, period: long>>, collapsed: string>"


def least_lcp(shortest: int, exponent: int) -> int:
    """The least LCP of two suffixes one period apart at the start of a run."""
    return min(max(shortest, exponent * q) - q for q in range(1, shortest + 1))


def tied_order(ids: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """(order, head): suffixes that share their first words with another one, in suffix order; head marks where a new group starts.

    Suffixes of one group share as many words as fit one sort key: three, two if there are
    very many different ids, and never more than ``least``.  The last id must occur once.
    """
    n, v = len(ids), int(ids.max()) + 1
    width = min(least, 3 if v ** 3 < 1 << 62 else 2)
    if n <= width:
        return np.zeros(0, np.int64), np.zeros(0, bool)
    wide = ids.astype(np.int64)
    packed = wide[:n - width + 1].copy()
    for j in range(1, width):
        packed = packed * v + wide[j:n - width + 1 + j]
    order = np.argsort(packed)
    new = np.ones(len(order), bool)
    new[1:] = packed[order[1:]] != packed[order[:-1]]
    start = np.flatnonzero(new)
    rank = np.empty(n, np.int64)
    rank[n - width + 1:] = n + np.arange(width - 1)  # too short to be tied, any distinct numbers do
    rank[order] = np.repeat(start, np.diff(np.append(start, len(order))))
    alone = new & np.append(new[1:], True)
    order, new = order[~alone], new[~alone]
    at = np.arange(len(order))  # places of `order` that are still tied
    length = width
    while len(at):
        # within each group, by the rank of the suffix that follows `length` words later
        pos = order[at]
        group, nxt = rank[pos], rank[np.minimum(pos + length, n - 1)]
        by = np.argsort(group * (n + width) + nxt)
        pos, group, nxt = pos[by], group[by], nxt[by]
        order[at] = pos
        split = np.ones(len(pos), bool)
        split[1:] = (group[1:] != group[:-1]) | (nxt[1:] != nxt[:-1])
        outer = np.ones(len(pos), bool)
        outer[1:] = group[1:] != group[:-1]
        base = np.maximum.accumulate(np.where(outer, np.arange(len(pos)), 0))
        own = np.maximum.accumulate(np.where(split, np.arange(len(pos)), 0))
        rank[pos] = group + (own - base)
        at = at[~(split & np.append(split[1:], True))]
        length *= 2
    return order, new


def shared_words(ids: list[int], order: list[int], head: list[bool]) -> dict[int, tuple[int, int]]:
    """suffix -> (suffix before it in its group, words that they share), in text order so that each length starts from the last one."""
    before = {b: a for a, b, h in zip(order, order[1:], head[1:]) if not h}
    out, last, h = {}, -2, 0
    for i in sorted(before):
        j = before[i]
        h = h - 1 if i == last + 1 and h > 1 else 0
        while ids[i + h] == ids[j + h]:
            h += 1
        out[i] = (j, h)
        last = i
    return out


def runs_in(ids: np.ndarray, shortest: int, exponent: int) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run.  The first and the last id must occur once, as must what separates texts."""
    least = least_lcp(shortest, exponent)
    order, head = tied_order(ids, least)
    if not len(order):
        return []
    words = ids.tolist()
    edges = sorted(((h, i, j) for i, (j, h) in shared_words(words, order.tolist(), head.tolist()).items() if h >= least), key=lambda e: (-e[0], e[1]))
    found, classes = [], {}
    for lcp, i, j in edges:
        small, large = classes.get(i) or [i], classes.get(j) or [j]
        if len(small) > len(large):
            small, large = large, small
        last = -1
        for k, x in enumerate(small):
            p = bisect_left(large, x)
            near = []
            if p and large[p - 1] != last:
                near.append((large[p - 1], x))
            if p < len(large) and (k + 1 == len(small) or small[k + 1] > large[p]):
                near.append((x, large[p]))
            for a, b in near:
                period = b - a
                if period <= lcp and lcp + period >= max(shortest, exponent * period) and words[a - 1] != words[b - 1]:
                    found.append((a, lcp + period, period))
            large.insert(p, x)
            classes[x] = large
            last = x
        if len(large) == len(small) + 1:  # the other class was one position without a set yet
            for x in large:
                classes[x] = large
    return found


def runs_of_texts(texts: list[list[bytes]], shortest: int, exponent: int) -> list[list[tuple[int, int, int]]]:
    """Runs of each text, by start, then period."""
    number = count(1).__next__
    parts, starts, at = [np.zeros(1, np.int64)], [], 1
    for ws in texts:
        known: dict[bytes, int] = defaultdict(number)
        starts.append(at)
        parts.append(np.fromiter(map(known.__getitem__, ws), np.int64, len(ws)))
        parts.append(np.array([number()]))
        at += len(ws) + 1
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    found = np.array(sorted(runs_in(np.concatenate(parts), shortest, exponent), key=lambda r: (r[0], r[2])), np.int64).reshape(-1, 3)
    owner = np.searchsorted(np.array(starts), found[:, 0], "right") - 1
    for d, (s, length, period) in zip(owner.tolist(), found.tolist()):
        out[d].append((s - starts[d], length, period))
    return out


def collapse(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words that no run holds after its own first period, joined by one space."""
    if not runs:
        return b" ".join(words)
    keep = np.ones(len(words), bool)
    for start, length, period in runs:
        keep[start + period:start + length] = False
    return b" ".join(compress(words, keep.tolist()))


def find(docs: DataFrame, key: str = "doc_id", text: str = "text", out: str = "periodic", shortest: int = 6, exponent: int = 4,
         edit: Callable[[str | None, list[bytes]], list[bytes]] | None = None) -> DataFrame:
    """``docs`` with ``out``: n_words, runs (by start, then period) and the collapsed text.

    Words are runs without ASCII white space.  ``edit`` may change the words of a row,
    given its key as text (None: null), before they are searched.  A column ``out`` already there is replaced,
    all others pass through.
    """
    if shortest < 2 or exponent < 2:
        raise ValueError("runs have two words and two periods at least")

    @F.pandas_udf(RESULT)
    def of(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for keys, texts in batches:
            rows, batch, size = [], [], 0

            def flush() -> None:
                nonlocal batch, size
                for ws, runs in zip(batch, runs_of_texts(batch, shortest, exponent)):
                    rows.append((len(ws), [dict(zip(("start", "length", "period"), r)) for r in runs], collapse(ws, runs).decode("utf-8", "replace")))
                batch, size = [], 0

            for k, t in zip(keys.tolist(), texts.tolist()):
                ws = t.encode("utf-8", "replace").split() if isinstance(t, str) else []
                batch.append(edit(k if isinstance(k, str) else None, ws) if edit else ws)
                size += len(ws)
                if size >= WORDS:
                    flush()
            flush()
            yield pd.DataFrame(rows, columns=["n_words", "runs", "collapsed"])

    return docs.withColumn(out, of(F.col(key).cast("string"), F.col(text)))
