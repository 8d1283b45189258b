import math
import random

import numpy as np
import pytest

from pyspark.sql import functions as F
from shelfwise.llm import op13_negatives as op13
from shelfwise.llm.queries import ORACLE, op13_hard_negatives
from shelfwise.plans.verify import duckdb_connection

SCHEMA = "vec_id long, label int, embedding array<double>, mark long, part int, turn int"


def brute(rows, anchor, positives=5, negatives=10, scale=256):
    good = {(i, c, tuple(v)) for i, c, v in rows if c is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)}
    whole = lambda x: math.floor(scale * x) if abs(x) < 1e15 else int(x) * scale
    good = [(i, c, [whole(x) for x in v]) for i, c, v in good]
    order = lambda r: (-r[1], r[0] is None, r[0] or 0)
    out = []
    for i, c, v in good:
        if i is None or not anchor(i):
            continue
        score = lambda w: sum(a * b for a, b in zip(v, w))
        pos = sorted(((j, score(w)) for j, d, w in good if d == c and j != i and len(w) == len(v)), key=order)[:positives]
        neg = sorted(((j, score(w)) for j, d, w in good if d != c and len(w) == len(v)), key=order)
        for p, s in pos:
            fit = [(j, t) for j, t in neg if 30 * s <= 100 * t <= 90 * s][:negatives]
            fits = lambda x: x if -2 ** 63 <= x < 2 ** 63 else None
            out += [(i, p, k + 1, j, fits(s), fits(t)) for k, (j, t) in enumerate(fit)]
    return sorted(out, key=repr)


def mined(spark, rows, step=10, **kw):
    df = spark.createDataFrame([(*r, 7, 7, 7) for r in rows], SCHEMA)
    got = op13.mine(df, F.col("vec_id") % step == 0, **kw)
    return sorted(map(tuple, got.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect()), key=repr)


@pytest.mark.parametrize("dim,block", [(6, 4 << 20), (3, 1), (1, 1)])
def test_against_brute_force(spark, monkeypatch, dim, block):
    monkeypatch.setattr(op13, "BLOCK_BYTES", block)  # at least 64 rows a block
    monkeypatch.setattr(op13, "ANCHORS", 7)
    rng = random.Random(dim)
    rows = [(i, rng.randrange(3), [rng.choice([0.0, 0.25, -0.5, rng.uniform(-1, 1)]) for _ in range(dim)]) for i in range(400)]
    assert mined(spark, rows) == brute(rows, lambda i: i % 10 == 0) != []


def test_rows_that_take_no_part(spark):
    v = [0.5, 0.25]
    rows = [(0, 1, v), (1, 1, v), (1, 1, v), (2, 2, [0.3, 0.1]), (2, 2, [0.3, 0.1]), (3, None, v), (4, 2, None), (5, 2, [0.3, None]), (6, 2, [float("nan"), 0.1]),
            (7, 2, [float("inf"), 0.1]), (8, 2, [0.3]), (9, 2, []), (None, 2, [0.3, 0.1]), (10, 3, [0.0, 0.0]), (11, 3, [0.1, 0.0]), (20, 4, []), (21, 4, []), (30, 2, [])]
    got = mined(spark, rows)
    assert got == brute(rows, lambda i: i % 10 == 0)
    assert mined(spark, []) == []


def test_scores_beyond_doubles_and_longs(spark):
    rng = random.Random(2)
    for size in (1e9, 1e18, 1e300):
        rows = [(i, i % 2, [rng.choice([1, -1, 2, 3]) * size * rng.choice([1, 1, 0.5]), float(rng.randrange(4))]) for i in range(60)]
        assert sorted(mined(spark, rows), key=repr) == brute(rows, lambda i: i % 10 == 0) != []


def test_reading_stops_before_the_end_and_loses_nothing():
    rng = np.random.default_rng(4)
    x = np.floor(rng.normal(size=(4000, 4)) * 50)
    seen = []

    class Counted(np.ndarray):
        def __matmul__(self, other):
            seen.append(len(self))
            return np.asarray(self) @ other

    lists = op13.Lists(x)
    lists.vectors = x.view(Counted)
    q = x[0]
    ties = np.arange(len(x))
    best = lists.search(q, np.ones(len(x), bool), [(None, None), (10, 900)], 10, ties)
    full = sorted(((int(s), i) for i, s in enumerate((x @ q).tolist())), key=lambda t: (-t[0], t[1]))
    assert best[0] == full[:10] and best[1] == [t for t in full if 10 <= t[0] <= 900][:10]
    seen.clear()
    q = np.array([9.0, 0.0, -1.0, 0.0])  # few lists decide
    full = sorted(((int(s), i) for i, s in enumerate((x @ q).tolist())), key=lambda t: (-t[0], t[1]))
    assert lists.search(q, np.ones(len(x), bool), [(None, None)], 10, ties)[0] == full[:10] and sum(seen) < len(x) / 2


def test_query_and_sql_against_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    cols = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    got = sorted(map(tuple, op13_hard_negatives(spark, sf).select(*cols).collect()))
    assert got == sorted(duckdb_connection(sf).execute(f"SELECT {', '.join(cols)} FROM ({ORACLE['op13_hard_negatives']})").fetchall())
    rows = [(r["vec_id"], (r["label"] + 1) % 10 if r["vec_id"] % 7 == 0 else r["label"], list(r["embedding"])) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    assert sorted(got, key=repr) == brute(rows, lambda i: i % 100 == 0) != []
