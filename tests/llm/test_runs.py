import hashlib
import random
import zlib

import pytest

from shelfwise.llm import op12_runs as op12
from shelfwise.llm.queries import op12_runs, repeated_tail


def brute(words, shortest=6, exponent=4):
    """Runs by comparing every word with the one q places on, for every q."""
    n, out = len(words), []
    for q in range(1, n // exponent + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j + q - i >= max(shortest, exponent * q):
                if not any(all(words[x] == words[x + d] for x in range(i, j + q - d)) for d in range(1, q)):
                    out.append((i, j + q - i, q))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def kept(words, runs):
    return b" ".join(w for i, w in enumerate(words) if not any(s + p <= i < s + n for s, n, p in runs))


@pytest.mark.parametrize("shortest,exponent", [(6, 4), (2, 2), (4, 3), (9, 2)])
def test_runs_against_brute_force(shortest, exponent):
    rng = random.Random(shortest * 10 + exponent)
    texts = []
    for _ in range(400):
        ws = []
        while len(ws) < rng.randrange(60):
            unit = [rng.choice(b"abc"[:rng.randint(1, 3)]) for _ in range(rng.randint(1, 7))]
            ws += (unit * 9)[:rng.randint(1, 9 * len(unit))]
        texts.append([bytes([w]) for w in ws])
    got = op12.runs_of_texts(texts, shortest, exponent)
    for ws, runs in zip(texts, got):
        assert runs == brute(ws, shortest, exponent)
        assert op12.collapse(ws, runs) == kept(ws, runs)


def test_two_word_keys_where_ids_are_many(monkeypatch):
    rng = random.Random(1)
    ws = [rng.choice([b"a", b"b"]) for _ in range(300)]
    want = brute(ws)
    ids = [0] + [3_000_000 + (w == b"a") for w in ws] + [1]
    import numpy as np
    assert sorted((s - 1, n, p) for s, n, p in op12.runs_in(np.array(ids), 6, 4)) == sorted(want)


def test_long_texts_of_one_word():
    ws = [b"a"] * 60_000
    assert op12.runs_of_texts([ws, [b"a", b"b"] * 20_000], 6, 4) == [[(0, 60_000, 1)], [(0, 40_000, 2)]]


def test_edit_by_definition():
    words = [str(i).encode() for i in range(57)]
    seen = 0
    for key in map(str, range(400)):
        h = zlib.crc32(key.encode())
        g, n, want = h // 10, len(words), list(words)
        if h % 10 == 0:
            seen += 1
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            for i in range(a, n):
                want[i] = words[a + (i - a) % p]
        assert repeated_tail(key, words) == want
    assert seen > 20 and repeated_tail("0", []) == [] and repeated_tail(None, words) == words


def expected(doc_id, text):
    words = repeated_tail(None if doc_id is None else str(doc_id), (text or "").encode().split())
    runs = brute(words)
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    sha = lambda b: hashlib.sha256(b).hexdigest()
    head = (*best[:2], best[2], 1000 * best[1] // best[2]) if best else (None,) * 4
    return (doc_id, len(runs), *head, sha("".join("%d,%d,%d\n" % r for r in runs).encode()), sha(kept(words, runs)))


def test_query_against_brute_force(spark, small, tmp_path):
    got = {tuple(r) for r in op12_runs(spark, "/root/testdata/sf0.001").select(
        "doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256").collect()}
    texts = [(r["doc_id"], r["text"]) for r in small.collect() if len((r["text"] or "").split()) < 1500]
    assert len(texts) > 100 and {expected(*t) for t in texts} <= got
    assert any(x[1] for x in got)


def test_edge_rows(edge, nothing):
    assert op12.find(nothing).collect() == []
    rows = op12.find(edge).select("text", "periodic", "lang").collect()
    assert len(rows) == edge.count()
    for r in rows:
        words = (r["text"] or "").encode().split()
        assert r["periodic"]["n_words"] == len(words)
        if len(words) < 1000:
            assert [(x["start"], x["length"], x["period"]) for x in r["periodic"]["runs"]] == brute(words)
        else:  # a phrase of three words, 60,000 times
            assert [(x["start"], x["length"], x["period"]) for x in r["periodic"]["runs"]] == [(0, len(words), 3)]
            assert r["periodic"]["collapsed"] == "lorem ipsum dolor"
    with pytest.raises(ValueError):
        op12.find(edge, exponent=1)
