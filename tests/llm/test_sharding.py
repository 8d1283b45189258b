import random
import zlib
from collections import defaultdict

import pytest

from shelfwise.llm.op1_sharding import CapacityTree, evenness, pack, shard_by_bytes


def check(rows, texts, shards):
    """Equal texts together, slots 0.. without a gap, checksum and size of every row."""
    where, slots = defaultdict(set), defaultdict(list)
    assert len(rows) == len(texts)
    by_id = defaultdict(list)
    for k, t in texts:
        by_id[k].append((len((t or "").encode()) + 8, zlib.crc32((t or "").encode())))
    for r in rows:
        assert (r["size"], r["text_crc32"]) in by_id[r["doc_id"]]
        where[r["text_crc32"], r["size"]].add(r["shard"])
        slots[r["shard"]].append(r["slot"])
        assert 0 <= r["shard"] < shards
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    return where


def test_edge_rows(edge, nothing):
    texts = [(r["doc_id"], r["text"]) for r in edge.collect()]
    where = check(shard_by_bytes(edge, 3).collect(), texts, 3)
    assert all(len(v) == 1 for (crc, size), v in where.items() if size > 8)
    assert shard_by_bytes(nothing, 3).collect() == []


def test_documents_are_even(small):
    s = shard_by_bytes(small, 4)
    check(s.collect(), [(r["doc_id"], r["text"]) for r in small.collect()], 4)
    assert evenness(s) < 1.05


def test_hot_group_stays_whole(spark):
    df = spark.createDataFrame([(i, "same text" if i % 3 else f"text {i}") for i in range(900)], "doc_id long, text string")
    rows = shard_by_bytes(df, 5).collect()
    assert len({r["shard"] for r in rows if r["doc_id"] % 3}) == 1
    check(rows, [(i, "same text" if i % 3 else f"text {i}") for i in range(900)], 5)


def test_pack_is_best_fit_decreasing():
    assert pack([(6, "a"), (5, "b"), (4, "c"), (3, "d")], capacity=9) == {"a": 0, "b": 1, "c": 1, "d": 0}
    assert pack([(20, "a"), (1, "b")], capacity=9) == {"a": 0, "b": 1}
    assert pack([], shards=4) == {}


@pytest.mark.parametrize("seed", range(5))
def test_pack_against_a_plain_scan(seed):
    rng = random.Random(seed)
    items = [(rng.randint(1, 50), f"i{k}") for k in range(300)]
    bins, want = [], {}
    for size, name in sorted(items, key=lambda x: (-x[0], x[1])):
        fits = [(cap, i) for i, cap in enumerate(bins) if cap >= size]
        if not fits:
            bins.append(60)
            fits = [(60, len(bins) - 1)]
        cap, i = min(fits)
        bins[i] = cap - size
        want[name] = i
    assert pack(items, capacity=60) == want


def test_tree_against_a_list():
    rng, tree, held = random.Random(3), CapacityTree(), []
    for _ in range(3000):
        if held and rng.random() < 0.45:
            k = held.pop(rng.randrange(len(held)))
            tree.remove(k)
        else:
            k = (rng.randint(0, 100), rng.randint(0, 10**9))
            held.append(k)
            tree.insert(k)
        size = rng.randint(0, 110)
        assert tree.tightest(size) == min((h for h in held if h[0] >= size), default=None)
        assert tree.roomiest() == max(held, default=None)
