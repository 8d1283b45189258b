"""Hard-negative mining by the threshold algorithm.

Rows are integer vectors with a label; a row's score is its inner product with the anchor.
An anchor's positives are its best rows of the same label.  For each positive, the negatives
are the best rows of another label whose score lies in a window set by the positive's score.

Rows are dealt into blocks of bounded size (same label for the positives, any label for the
negatives) and anchors into blocks too; a task takes one block of each.  For its rows it
sorts one candidate list per dimension.  An anchor reads all lists in step, downwards where
its component is positive and upwards where it is negative.  Rows that turn up are scored
by random access.  The threshold is the score that a row no list has shown yet could have
at most: the sum over the dimensions of the anchor's component times the value just read.  Reading
stops once the threshold is strictly below the k-th best score of every window (a tie
could still win by its key), or below the window itself.  The best of each block are merged.

Scores are exact: doubles where every product sum stays below 2^53, else Python integers.

Repeated rows (same key, label and vector) count once.  A key that two different rows share
makes two anchors; rows of the anchor's own key are never its positives.  Rows with a null key
take part, after all keys on ties, but are no anchors.  Vectors of other lengths are not
compared.  No row, no label twice or an empty window give no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfwise.llm.common import stored

#: Bytes of a block of rows (as doubles) and anchors in a block of theirs.
BLOCK_BYTES = 4 << 20
ANCHORS = 128
#: Rows read from each list before the threshold is looked at the first time; doubled each time.
STEP = 16


def integers(vectors: list[np.ndarray], scale: int) -> np.ndarray:
    """floor(scale * x) of every component, as doubles where all are below 2^53, else as Python integers (object)."""
    m = np.array(vectors, np.float64).reshape(len(vectors), len(vectors[0]))
    with np.errstate(over="ignore"):
        scaled = np.floor(m * scale)
    if scaled.size == 0 or np.abs(scaled).max() < 1 << 53:
        return scaled
    whole = lambda x: math.floor(x * scale) if abs(x) < 1 << 52 else int(x) * scale
    return np.array([[whole(x) for x in row] for row in m.tolist()], object)


def _best(found: list[tuple[int, int]], scores: np.ndarray, rows: np.ndarray, k: int, ties: np.ndarray) -> list[tuple[int, int]]:
    """The ``k`` best of ``found`` and the new rows, by score, then tie rank."""
    if len(rows) > k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        kept = scores >= least
        if kept.sum() > 4 * k:  # many equal scores: only the first of them by tie rank can stay
            order = np.lexsort((ties[rows], -scores))[:k]
            scores, rows = scores[order], rows[order]
        else:
            scores, rows = scores[kept], rows[kept]
    return sorted(found + [(int(s), int(r)) for s, r in zip(scores.tolist(), rows.tolist())], key=lambda x: (-x[0], ties[x[1]]))[:k]


class Lists:
    """The rows of a block with a sorted list per dimension."""

    def __init__(self, vectors: np.ndarray):
        self.vectors = vectors
        if vectors.shape[1]:
            self.order = np.ascontiguousarray(np.argsort(vectors, axis=0, kind="stable").T.astype(np.int32))
            self.values = np.take_along_axis(vectors.T, self.order, 1)
        else:
            self.order, self.values = np.arange(len(vectors), dtype=np.int32)[None, :], np.zeros((1, len(vectors)))

    def search(self, anchor: np.ndarray, allowed: np.ndarray, windows: list[tuple[int | None, int | None]], k: int, ties: np.ndarray) -> list[list[tuple[int, int]]]:
        """For each window (least score, greatest score; None: open) its ``k`` best allowed rows as (score, row).

        Better is a higher score, then a smaller entry of ``ties``.
        """
        n = len(self.vectors)
        used = np.flatnonzero(anchor)
        lists = used if len(used) else np.zeros(1, np.int64)  # an anchor of zeros still has to see every row
        up = anchor[lists] < 0 if len(used) else np.zeros(1, bool)
        rising, falling = lists[up.astype(bool)], lists[~up.astype(bool)]
        seen = np.zeros(n, bool)
        best: list[list[tuple[int, int]]] = [[] for _ in windows]
        open_ = list(range(len(windows)))
        depth, step, every = 0, STEP, None
        while depth < n and open_:
            end = min(depth + step, n)
            new = np.zeros(n, bool)
            new[self.order[rising, depth:end].ravel()] = True
            new[self.order[falling, n - end:n - depth].ravel()] = True
            rows = np.flatnonzero(new & ~seen)
            seen[rows] = True
            rows = rows[allowed[rows]]
            if len(rows):
                # a product with all rows costs less than one with a copy of most of them
                if every is None and len(rows) * 4 >= n and self.vectors.dtype != object:
                    every = self.vectors @ anchor
                scores = self.vectors[rows] @ anchor if every is None else every[rows]
                floors = [best[w][-1][0] if len(best[w]) == k else windows[w][0] for w in open_]
                if None not in floors:  # what no window can take
                    some = (scores >= min(floors)).astype(bool)
                    rows, scores = rows[some], scores[some]
                for w, floor in zip(open_, floors):
                    fits = np.ones(len(rows), bool)
                    if floor is not None:
                        fits &= (scores >= floor).astype(bool)
                    if windows[w][1] is not None:
                        fits &= (scores <= windows[w][1]).astype(bool)
                    if fits.any():
                        best[w] = _best(best[w], scores[fits], rows[fits], k, ties)
            if seen.all():
                break
            threshold = int(anchor[rising] @ self.values[rising, end - 1] + anchor[falling] @ self.values[falling, n - end]) if len(used) else 0
            open_ = [w for w in open_ if not (len(best[w]) == k and threshold < best[w][-1][0])
                     and not (windows[w][0] is not None and threshold < windows[w][0])]
            depth, step = end, step * 2
        return best


def exact(rows: np.ndarray, anchors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both as doubles if no product sum can reach 2^53, else as Python integers."""
    if rows.dtype != object and anchors.dtype != object:
        top = lambda m: float(np.abs(m).max()) if m.size else 0.0
        if top(rows) * top(anchors) * max(rows.shape[1], 1) < 1 << 53:
            return rows, anchors
    whole = lambda m: m if m.dtype == object else np.array([[int(x) for x in r] for r in m.tolist()], object).reshape(m.shape)
    return whole(rows), whole(anchors)


def _fits_long(score: int) -> int | None:
    return score if -(1 << 63) <= score < 1 << 63 else None


def _tie_ranks(keys: list) -> np.ndarray:
    """Rank of each key, nulls last."""
    out = np.empty(len(keys), np.int64)
    out[sorted(range(len(keys)), key=lambda i: (keys[i] is None, keys[i] or 0))] = np.arange(len(keys))
    return out


def mine(rows: DataFrame, anchor: F.Column, key: str = "vec_id", label: str = "label", vector: str = "embedding", scale: int = 256,
         positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score for the rows of ``rows`` that ``anchor`` selects.

    A negative's score is at least ``low`` and at most ``high`` percent of the positive's.
    Components become floor(scale * x).  Rows with a null label, a null vector or a null or
    non-finite component take no part.  Scores beyond a long are compared exactly and
    returned as null.
    """
    key_type, number = rows.schema[key].dataType, F.col("v")
    bad = F.exists(number, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    base = stored(rows.select(F.col(key).alias("id"), F.col(label).alias("label"), F.col(vector).cast("array<double>").alias("v"),
                              F.coalesce(anchor, F.lit(False)).alias("is_anchor"))
                  .where("label IS NOT NULL AND v IS NOT NULL").where(~bad)
                  .withColumns({"dim": F.size("v"), "mark": F.xxhash64("label", "v")})
                  .dropDuplicates(["id", "mark", "label", "v"]), "negatives-rows")
    rows_of = F.greatest(F.lit(64), F.floor(F.lit(BLOCK_BYTES) / (F.greatest("dim", F.lit(1)) * 8)))

    def blocked(groups: list[str], best_of, out: T.StructType, asked: DataFrame) -> DataFrame:
        """Every anchor of ``asked`` against every row of the same ``groups``, one task per block of each."""
        sizes = stored(base.groupBy(*groups).agg(F.count("*").alias("n")).withColumn("parts", F.ceil(F.col("n") / rows_of).cast("int")), "negatives-sizes")
        asks = stored(asked.groupBy(*groups).agg(F.count("*").alias("m")).withColumn("turns", F.ceil(F.col("m") / ANCHORS).cast("int"))
                      .join(sizes, groups), "negatives-asks").select(*groups, "parts", "turns")
        salt = lambda count, seed: F.pmod(F.xxhash64("id", "mark", F.lit(seed)), F.col(count)).cast("int")
        numbers = lambda count: F.explode(F.sequence(F.lit(0), F.col(count) - 1))
        left = base.join(asks, groups).withColumn("part", salt("parts", 1)).withColumn("turn", numbers("turns"))
        right = asked.join(asks, groups).withColumn("turn", salt("turns", 2)).withColumn("part", numbers("parts")).drop("parts", "turns")
        right = right.select(*[F.col(c).alias(c) for c in right.columns])  # a side of its own for cogroup, though both come from the same rows
        by = [*groups, "part", "turn"]
        return left.select(*by, F.coalesce("id", F.lit(0).cast(key_type)).alias("id"), F.col("id").isNull().alias("no_id"), "mark", *({"label"} - set(by)), "v").groupBy(*by).cogroup(right.groupBy(*by)).applyInPandas(best_of, out)

    def block(r: pd.DataFrame, a: pd.DataFrame):
        x, q = exact(integers(r["v"].tolist(), scale), integers(a["v"].tolist(), scale))
        ids = [None if none else i for i, none in zip(r["id"].tolist(), r["no_id"].tolist())]
        return Lists(x), q, ids, _tie_ranks(ids)

    same = T.StructType([T.StructField("anchor_id", key_type), T.StructField("anchor_mark", T.LongType()), T.StructField("id", key_type),
                         T.StructField("mark", T.LongType()), T.StructField("score", T.StringType())])

    def best_same(r: pd.DataFrame, a: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(r) and len(a):
            lists, q, ids, ties = block(r, a)
            marks = r["mark"].tolist()
            own = np.array([object() if i is None else i for i in ids], object)
            for anchor_id, mark, vec in zip(a["id"].tolist(), a["mark"].tolist(), q):
                for s, i in lists.search(vec, own != anchor_id, [(None, None)], positives, ties)[0]:
                    out.append((anchor_id, mark, ids[i], marks[i], str(s)))
        return pd.DataFrame(out, columns=[f.name for f in same], dtype=object)

    anchors = base.where(F.col("is_anchor") & F.col("id").isNotNull()).select("id", "mark", "label", "dim", "v")
    # scores travel as decimal text: beyond 38 digits no Spark number holds them
    wide = lambda c: [F.when(F.col(c).startswith("-"), 0).otherwise(1), F.when(F.col(c).startswith("-"), -F.length(c)).otherwise(F.length(c)),
                      F.when(F.col(c).startswith("-"), F.translate(c, "0123456789", "9876543210")).otherwise(F.col(c))]
    best = lambda c, id_: [*(e.desc() for e in wide(c)), F.col(id_).asc_nulls_last(), F.col("mark")]
    ranked = blocked(["label", "dim"], best_same, same, anchors)
    chosen = stored(ranked.withColumn("n", F.row_number().over(Window.partitionBy("anchor_id", "anchor_mark").orderBy(*best("score", "id"))))
                    .where(F.col("n") <= positives), "negatives-positives")
    asked = (chosen.groupBy(F.col("anchor_id").alias("id"), F.col("anchor_mark").alias("mark"))
             .agg(F.array_sort(F.collect_list(F.struct("n", F.col("id").alias("p"), "score"))).alias("positives")))
    asked = stored(anchors.join(asked, ["id", "mark"]).select("id", "mark", F.col("label").alias("own"), "dim", "v", "positives"), "negatives-windows")

    found = T.StructType([T.StructField("anchor_id", key_type), T.StructField("anchor_mark", T.LongType()), T.StructField("n", T.IntegerType()),
                          T.StructField("positive_id", key_type), T.StructField("positive_score", T.StringType()),
                          T.StructField("negative_id", key_type), T.StructField("mark", T.LongType()), T.StructField("negative_score", T.StringType())])

    def best_other(r: pd.DataFrame, a: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(r) and len(a):
            lists, q, ids, ties = block(r, a)
            marks, labels = r["mark"].tolist(), r["label"].to_numpy()
            for anchor_id, mark, own, windows, vec in zip(a["id"].tolist(), a["mark"].tolist(), a["own"].tolist(), a["positives"].tolist(), q):
                scores = [int(p["score"]) for p in windows]
                bounds = [(-(-low * s // 100), high * s // 100) for s in scores]
                each = lists.search(vec, labels != own, bounds, negatives, ties)
                for p, s, rows_ in zip(windows, scores, each):
                    out += [(anchor_id, mark, p["n"], p["p"], str(s), ids[i], marks[i], str(t)) for t, i in rows_]
        return pd.DataFrame(out, columns=[f.name for f in found], dtype=object)

    merged = blocked(["dim"], best_other, found, asked)
    window = Window.partitionBy("anchor_id", "anchor_mark", "n").orderBy(*best("negative_score", "negative_id"))
    return (merged.withColumn("rank", F.row_number().over(window)).where(F.col("rank") <= negatives)
            .select("anchor_id", "positive_id", "rank", "negative_id", *[F.expr(f"try_cast({c} AS long)").alias(c) for c in ("positive_score", "negative_score")]))
