import random
from itertools import combinations

import pytest
import xxhash


from shelfwise.llm import op5_simhash as op5
from shelfwise.llm.graph import components


def brute_fp(t, k=3):
    import string
    w = [x for x in __import__("re").split(r"[\x20\x09-\x0D]+", (t or "").translate(str.maketrans(string.ascii_uppercase, string.ascii_lowercase))) if x]
    if not w:
        return 0
    sh = [" ".join(w[i:i + k]) for i in range(len(w) - k + 1)] or [" ".join(w)]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_groups(rows):
    fps = [brute_fp(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in combinations(range(len(rows)), 2):
        if bin(fps[i] ^ fps[j]).count("1") <= 3:
            root[find(i)] = find(j)
    out = []
    for i, (k, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if find(j) == find(i) and rows[j][0] is not None]
        out.append((k, format(fps[i], "016x"), min(ids, default=None)))
    return sorted(out, key=repr)


def got(df):
    g = op5.groups(df)
    return sorted(((r["doc_id"], r["h"], r["component_id"]) for r in g.select("doc_id", op5.hex16("fp").alias("h"), "component_id").collect()), key=repr)


def test_edge_rows_and_documents(edge, nothing, small):
    for df in (edge, small):
        assert got(df) == brute_groups([(r["doc_id"], r["text"]) for r in df.collect()])
    assert got(nothing) == []


@pytest.mark.parametrize("crowd,bits", [(2, 3), (16, 3), (1, 1), (3, 5)])
def test_crowded_keys_lose_no_component(spark, monkeypatch, crowd, bits):
    monkeypatch.setattr(op5, "CROWD", crowd)
    rng = random.Random(8)
    fps = {rng.getrandbits(64) for _ in range(200)}
    core = rng.getrandbits(64)
    for _ in range(200):  # near copies: few bits of a dozen open ones
        x = core
        for b in rng.sample(range(0, 60, 5), rng.randint(1, 6)):
            x ^= 1 << b
        fps.add(x)
    for x in list(fps)[:60]:  # pairs just beyond the distance
        fps.add(x ^ sum(1 << b for b in rng.sample(range(64), bits + 1)))
    fps = sorted(op5.signed(v) for v in fps)
    root = {v: v for v in fps}

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    for a, b in combinations(fps, 2):
        if ((a ^ b) & ((1 << 64) - 1)).bit_count() <= bits:
            root[find(a)] = find(b)
    got_ = {r["node"]: r["root"] for r in op5.near_components(spark.createDataFrame([(v,) for v in fps], "fp long"), bits).collect()}
    by = {}
    for v in fps:
        by.setdefault(got_.get(v, v), set()).add(v)
    want = {}
    for v in fps:
        want.setdefault(find(v), set()).add(v)
    assert sorted(map(sorted, by.values())) == sorted(map(sorted, want.values()))


def test_components_of_chains_stars_and_loops(spark):
    edges = [(i, i + 1) for i in range(60)] + [(1000, 1000 + i) for i in range(1, 80)] + [(5000, 5000), (6000, 6001), (6001, 6000), (None, 3)]
    rows = components(spark.createDataFrame(edges, "a long, b long")).collect()
    by = {}
    for r in rows:
        by.setdefault(r["root"], set()).add(r["node"])
    assert sorted(map(len, by.values())) == [2, 61, 80] and len(rows) == 143
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_one_survivor_per_group(edge):
    left = op5.survivors(op5.groups(edge)).collect()
    assert len(left) == op5.groups(edge).select("component").distinct().count()
