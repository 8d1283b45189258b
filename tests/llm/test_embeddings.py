import math

import numpy as np
import pytest

from shelfwise.llm import op6_embeddings as op6


def brute(rows, cosine=0.9):
    ok = [i for i, (_, e) in enumerate(rows) if e and None not in e and all(map(math.isfinite, e)) and any(e)]
    near = {i: [] for i in range(len(rows))}
    for i in ok:
        for j in ok:
            if i != j and len(rows[i][1]) == len(rows[j][1]):
                a, b = np.array(rows[i][1]), np.array(rows[j][1])
                if a @ b >= cosine * math.sqrt((a @ a) * (b @ b)):
                    near[i].append(j)
    out = []
    for i in range(len(rows)):
        seen, todo = {i}, [i]
        while todo:
            for j in near[todo.pop()]:
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        c = min((rows[j][0] for j in seen if rows[j][0] is not None), default=None)
        out.append((rows[i][0], len(near[i]), c, rows[i][0] is not None and rows[i][0] == c))
    return sorted(out, key=repr)


def result(df, **kw):
    return sorted((tuple(r) for r in op6.near_dedup(df, **kw).select("vec_id", "n_links", "component_id", "kept").collect()), key=repr)


def vectors(n=300, dim=16, seed=6):
    rng = np.random.default_rng(seed)
    centre = rng.normal(size=(12, dim))
    x = np.concatenate([rng.normal(size=(n // 2, dim)), centre[rng.integers(0, 12, n // 2)] + rng.normal(scale=0.12, size=(n // 2, dim))])
    return [(i, [float(v) for v in r]) for i, r in enumerate(x)]


@pytest.mark.parametrize("run", [32, 16_384])
def test_against_brute_force(spark, monkeypatch, run):
    monkeypatch.setattr(op6, "RUN", run)
    rows = vectors()
    rows += [(1000 + i, rows[200][1]) for i in range(5)] + [(2000, [2 * v for v in rows[3][1]]), (2001, None), (2002, []), (2003, [0.0] * 16),
                                                             (2004, [float("nan")] * 16), (2005, [float("inf")] + [1.0] * 15), (2006, [None] + [1.0] * 15),
                                                             (2007, [1.0, 0.0]), (2008, [0.9, math.sqrt(0.19)]), (2009, [0.6, 0.8]), (None, rows[3][1]), (7, rows[7][1])]
    df = spark.createDataFrame([(k, e, 1, 1) for k, e in rows], "vec_id long, embedding array<double>, c long, e long")
    assert result(df) == brute(rows)


def test_empty(spark):
    assert result(spark.createDataFrame([], "vec_id long, embedding array<float>")) == []
    one = spark.createDataFrame([(1, None)], "vec_id long, embedding array<float>")
    assert result(one) == [(1, 0, 1, True)]


def test_extreme_doubles(spark):
    import decimal
    rng = np.random.default_rng(9)
    base = rng.normal(size=(12, 4))
    base[6:] = base[:6] + rng.normal(scale=0.05, size=(6, 4))
    sizes = [1e-200, 1e200, 1e-308, 1e307, 1.0, 3e-160]
    rows = [(i, [float(x * sizes[i % 6]) for x in v]) for i, v in enumerate(base)]
    rows += [(100 + i, [1e-200 if i == j else 0.0 for j in range(4)]) for i in range(4)] + [(200, [1e200, 0.0, 0.0, 0.0]), (201, [1e200, 1e200, 0.0, 0.0]), (202, [5e-324, 0.0, 0.0, 0.0])]
    exact = [[decimal.Decimal(x) for x in e] for _, e in rows]
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    with decimal.localcontext() as ctx:
        ctx.prec, ctx.Emax, ctx.Emin = 60, 9_999_999, -9_999_999
        links = {r[0]: sum(i != j and dot(a, b) >= decimal.Decimal("0.9") * (dot(a, a) * dot(b, b)).sqrt() for j, b in enumerate(exact)) for i, (r, a) in enumerate(zip(rows, exact))}
    got = {r["vec_id"]: r["n_links"] for r in op6.near_dedup(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert got == links and {0, 1, 2} <= set(links.values())


def test_runs_are_sized_by_bytes(spark, monkeypatch):
    monkeypatch.setattr(op6, "RUN_BYTES", 12 * 16 * 64)
    rows = vectors()
    assert result(spark.createDataFrame(rows, "vec_id long, embedding array<double>")) == brute(rows)
