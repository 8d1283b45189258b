"""Embedding near-dedup by a subspace pigeonhole join.

Vectors of length one with cosine >= s are at squared distance <= 2 - 2s.  Rotated and
cut into ``BLOCKS`` blocks, a close pair is within (2 - 2s) / BLOCKS in at least one of
them.  The rotation is onto the principal axes, dealt to the blocks in turn, so each
block leads with a direction of large variance.

Per block, vectors are range-partitioned on the leading coordinate into runs of at most
about ``RUN`` vectors or ``RUN_BYTES``; only runs whose intervals come within the block's range are joined, one
task per pair of runs.  Inside it the block distance filters, the union over blocks is
verified on the original vectors in double precision, and a pair found in several blocks
counts only in the first.  A task returns links per vector and a spanning forest, never
the pairs.

Equal vectors are one class with a weight.  On data without structure the leading
coordinate prunes little: the work is then quadratic in the number of distinct vectors,
as for every exact method in that many dimensions; tasks and memory stay bounded.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwise.llm.common import stored
from shelfwise.llm.graph import components

BLOCKS = 4
RUN = 16_384
#: A run is shorter where its vectors would take more bytes (doubles and rotated floats).
RUN_BYTES = 32 << 20
SLACK = 1e-5
#: Pairs verified at a time within a task.
PAIRS = 100_000


def usable(v) -> F.Column:
    """Not null, not empty, all components present and finite, not all zero."""
    c = F.col(v) if isinstance(v, str) else v
    finite = F.forall(c, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.coalesce(c.isNotNull() & (F.size(c) > 0) & finite & F.exists(c, lambda x: x != 0), F.lit(False))


def unit(rows: list) -> np.ndarray:
    x = np.array([np.asarray(r, np.float64) for r in rows])
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def scaled(rows: list, dim: int) -> np.ndarray:
    """Vectors as doubles, each times a power of two that brings its greatest component near 1, so no square over- or underflows; cosines stay as they are."""
    x = np.array([np.asarray(v, np.float64) for v in rows]).reshape(len(rows), dim)
    return np.ldexp(x, -np.frexp(np.abs(x).max(1, initial=0.0))[1][:, None])


def rotation(classes: DataFrame, dim: int) -> np.ndarray:
    """Principal axes of all unit vectors of this length, dealt to the blocks in turn (dim x dim)."""
    def gram(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((dim, dim))
        for pdf in batches:
            u = unit(pdf["e"])
            total += u.T @ u
        yield pd.DataFrame({"i": np.arange(dim), "row": list(total)})

    rows = (classes.select("e").mapInPandas(gram, "i int, row array<double>").select("i", F.posexplode("row").alias("j", "x"))
            .groupBy("i", "j").agg(F.sum("x").alias("x"))
            .groupBy("i").agg(F.transform(F.array_sort(F.collect_list(F.struct("j", "x"))), lambda s: s["x"]).alias("row")).collect())  # dim rows of dim numbers
    m = np.zeros((dim, dim))
    for r in rows:
        m[r["i"]] = r["row"]
    axes = np.linalg.eigh(m)[1][:, ::-1]
    return axes[:, np.argsort(np.arange(dim) % blocks_of(dim), kind="stable")]


def blocks_of(dim: int) -> int:
    return min(BLOCKS, dim)


def block_edges(dim: int) -> list[int]:
    """Where the blocks begin, as np.argsort of position modulo the block count lays them out."""
    b = blocks_of(dim)
    return [0, *np.cumsum([len(range(i, dim, b)) for i in range(b)]).tolist()]


def _join_runs(dim: int, cosine: float):
    limit = (2 - 2 * cosine) / blocks_of(dim)
    edge = block_edges(dim)
    schema = "c long, links long, other long"

    def verify(xa, xb, ra, rb, p, q, block):
        """Which of the candidate pairs are links that no earlier block has found."""
        dot = np.einsum("ij,ij->i", xa[p], xb[q])
        ok = dot >= cosine * np.sqrt((xa[p] ** 2).sum(1) * (xb[q] ** 2).sum(1))
        p, q = p[ok], q[ok]
        d = (ra[p].astype(np.float64) - rb[q].astype(np.float64)) ** 2
        near = np.stack([d[:, a:b].sum(1) <= limit + SLACK for a, b in zip(edge, edge[1:])], 1)
        first = near.argmax(1) == block
        return p[first], q[first]

    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        block, i, j = key
        side = pdf["side"].to_numpy()
        part = [pdf[side == 0], pdf[side == 1]] if i != j else [pdf, pdf]
        c, w, x, r = [], [], [], []
        for d in part:
            d = d.sort_values("c")
            c.append(d["c"].to_numpy())
            w.append(d["w"].to_numpy())
            x.append(scaled(list(d["e"]), dim))
            r.append(np.frombuffer(b"".join(d["r"]), np.float32).reshape(len(d), dim))
        links = [np.zeros(len(a), np.int64) for a in c]
        root: dict[int, int] = {}
        edges = []

        def find(v):
            while root.get(v, v) != v:
                root[v] = root.get(root[v], root[v])
                v = root[v]
            return v

        a, b = edge[block], edge[block + 1]
        left, right = np.ascontiguousarray(r[0][:, a:b]), np.ascontiguousarray(r[1][:, a:b])
        norm_l, norm_r = (left ** 2).sum(1), (right ** 2).sum(1)
        for at in range(0, len(left), 512):
            far = left[at:at + 512] @ right.T
            far *= -2
            far += norm_l[at:at + 512, None]
            far += norm_r[None]
            p, q = np.nonzero(far <= limit + 2 * SLACK)
            p = p + at
            if i == j:
                up = p < q
                p, q = p[up], q[up]
            for k in range(0, len(p), PAIRS):
                pp, qq = verify(x[0], x[1], r[0], r[1], p[k:k + PAIRS], q[k:k + PAIRS], block)
                np.add.at(links[0], pp, w[1][qq])
                np.add.at(links[1], qq, w[0][pp])
                for u, v in zip(c[0][pp].tolist(), c[1][qq].tolist()):
                    fu, fv = find(u), find(v)
                    if fu != fv:
                        root[max(fu, fv)] = min(fu, fv)
                        edges.append((u, v))
        rows = [(int(n), int(k), None) for s in (0, 1) for n, k in zip(c[s], links[s]) if k]
        return pd.DataFrame({"c": pd.Series([n for n, _, _ in rows] + [u for u, _ in edges], dtype="int64"),
                             "links": pd.Series([k for _, k, _ in rows] + [0] * len(edges), dtype="int64"),
                             "other": pd.Series([None] * len(rows) + [v for _, v in edges], dtype="Int64")})

    return run, schema


def _links_of_length(classes: DataFrame, dim: int, count: int, cosine: float) -> DataFrame:
    """Rows (c, links, null) and (c, 0, other) for the classes of one vector length."""
    turn = rotation(classes, dim)
    edge = block_edges(dim)
    reach = float(np.sqrt((2 - 2 * cosine) / blocks_of(dim))) + 1e-4
    kind = classes.schema["e"].dataType.simpleString()

    def spread(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            r = (unit(pdf["e"]) @ turn).astype(np.float32) if len(pdf) else np.zeros((0, dim), np.float32)
            # ties on the leading coordinate are told apart by less than the reach allows for
            tie = (pdf["c"].to_numpy().astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)).astype(float) / (1 << 24) * 1e-5
            yield pd.DataFrame({"c": pdf["c"], "w": pdf["w"], "e": pdf["e"], "r": [v.tobytes() for v in r],
                                "lead": [list(v) for v in (r[:, edge[:-1]].astype(np.float64) + tie[:, None])]})

    rows = stored(classes.select("c", "w", "e").mapInPandas(spread, f"c long, w long, e {kind}, r binary, lead array<double>"), "embedding-rows")
    runs = -(-count // min(RUN, max(64, RUN_BYTES // (12 * dim))))
    n_blocks = len(edge) - 1
    cuts = [[] for _ in range(n_blocks)]
    if runs > 1:
        at = [k / runs for k in range(1, runs)]
        got = rows.agg(*[F.percentile_approx(F.col("lead")[b], F.array(*map(F.lit, at)), F.lit(10 * runs)).alias(f"b{b}") for b in range(n_blocks)]).first()
        cuts = [sorted(set(got[f"b{b}"])) for b in range(n_blocks)]
    tiles = None
    for b in range(n_blocks):
        lead = F.col("lead")[b]
        q = cuts[b]
        run = sum((F.when(lead > v, 1).otherwise(0) for v in q), F.lit(0)) if q else F.lit(0)
        # the last run that begins within reach of each run's end, and the first that ends within reach of its begin
        last = [bisect_right(q, q[k] + reach) if k < len(q) else len(q) for k in range(len(q) + 1)]
        first = [next(i for i in range(len(q) + 1) if last[i] >= k) for k in range(len(q) + 1)]
        arr = lambda v: F.element_at(F.array(*map(F.lit, v)), F.col("run") + 1)
        x = rows.select("c", "w", "e", "r", run.cast("int").alias("run"))
        as_left = x.select("c", "w", "e", "r", F.col("run").alias("i"), F.explode(F.sequence(F.col("run"), arr(last))).alias("j"), F.lit(0).alias("side"))
        as_right = x.select("c", "w", "e", "r", F.explode(F.sequence(arr(first), F.col("run"))).alias("i"), F.col("run").alias("j"), F.lit(1).alias("side")).where("i < j")
        t = as_left.unionByName(as_right).withColumn("block", F.lit(b))
        tiles = t if tiles is None else tiles.unionByName(t)
    fn, schema = _join_runs(dim, cosine)
    return tiles.groupBy("block", "i", "j").applyInPandas(fn, schema)


def near_dedup(vectors: DataFrame, key: str = "vec_id", embedding: str = "embedding", cosine: float = 0.9) -> DataFrame:
    """One row per row of ``vectors``: key, n_links, component_id, kept.

    Vectors that are null, empty, zero or hold null or non-finite components link with
    nothing and are kept; vectors of different lengths are not compared.  Equal vectors
    are linked with each other.
    """
    rows = vectors.select(F.col(key).alias("key"), F.col(embedding).alias("e")).withColumn("ok", usable("e"))
    good = rows.where("ok")
    classes = stored(good.groupBy("e").agg(F.count("*").alias("w"), F.min("key").alias("least"))
                     .withColumn("c", F.monotonically_increasing_id()), "embedding-classes")
    found = None
    for r in classes.groupBy(F.size("e").alias("d")).agg(F.count("*").alias("n")).collect():  # one row per vector length
        f = _links_of_length(classes.where(F.size("e") == r["d"]), r["d"], r["n"], cosine)
        found = f if found is None else found.union(f)
    if found is None:
        found = classes.select("c", F.lit(0).cast("long").alias("links"), F.col("c").alias("other")).limit(0)
    found = stored(found, "embedding-links")
    roots = components(found.where("other IS NOT NULL").select(F.col("c").alias("a"), F.col("other").alias("b")))
    linked = found.groupBy("c").agg(F.sum("links").alias("links"))
    placed = stored(classes.select("c", "w", "least").join(roots.withColumnRenamed("node", "c"), "c", "left").join(linked, "c", "left")
                    .select("c", F.coalesce("root", "c").alias("root"), "least",
                            (F.coalesce("links", F.lit(0)) + F.col("w") - 1).alias("n_links")), "embedding-placed")
    least = stored(placed.groupBy("root").agg(F.min("least").alias("component_id")), "embedding-components")
    known = stored(classes.select("c", "e").join(placed.join(least, "root").select("c", "n_links", "component_id"), "c")
                   .select("e", "n_links", "component_id"), "embedding-known")
    kept = lambda d: d.select(F.col("key").alias(key), "n_links", "component_id", F.coalesce(F.col("key") == F.col("component_id"), F.lit(False)).alias("kept"))
    alone = rows.where(~F.col("ok")).select(F.col("key"), F.lit(0).cast("long").alias("n_links"), F.col("key").alias("component_id"))
    return kept(good.join(known, "e").select("key", "n_links", "component_id")).unionByName(kept(alone))
