import random
import re
import string

import pytest

from shelfwise.llm.op2_decontamination import decontaminate
from shelfwise.llm.queries import ORACLE, QUERIES
from shelfwise.plans.verify import compare


def brute(docs, items):
    lower = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)
    cut = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(lower))
    wins = []
    for item, t in items:
        w = cut(t)
        n = min(10, len(w))
        wins += [(item, tuple(w[i:i + n])) for i in range(len(w) - n + 1)] if w else []
    out = []
    for key, t in docs:
        w = cut(t)
        hit, got = set(), set()
        for item, win in wins:
            for i in range(len(w) - len(win) + 1):
                if tuple(w[i:i + len(win)]) == win:
                    hit |= set(range(i, i + len(win)))
                    got.add(item)
        out.append((key, len(w), len(hit), tuple(sorted(str(g) for g in got if g is not None))))
    return sorted(out, key=repr)


def result(df):
    return sorted(((r["doc_id"], r["n_words"], r["n_hit"], tuple(r["items"])) for r in df.collect()), key=repr)


def test_random_texts_against_brute_force(spark):
    rng = random.Random(4)
    vocab = ["a", "B", "c", "Dé", "e1", "É", "f"]
    text = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    items = [(i, text(rng.choice([1, 3, 4, 7, 9, 10, 12, 15]))) for i in range(25)] + [(90, None), (91, ""), (92, "!!"), (None, "a B c Dé"), (3, "f f f f")]
    docs = [(i, text(rng.randint(0, 60))) for i in range(60)]
    docs += [(100, items[3][1]), (101, (text(5) + ",. " + items[20][1].upper().replace(" ", " - ") + " " + text(5))), (101, None), (None, items[4][1]), (102, ""), docs[0], docs[0]]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame(items, "item_id long, text string")
    assert result(decontaminate(d, b)) == brute(docs, items)


def test_edge_rows(spark, edge, nothing):
    items = [(1, "quick brown fox jumps over the lazy dog"), (2, "lorem ipsum dolor lorem ipsum dolor lorem ipsum dolor lorem"), (3, "漢字")]
    b = spark.createDataFrame(items, "item_id long, text string")
    docs = [(r["doc_id"], r["text"] if r["doc_id"] != 7 else None) for r in edge.collect()]
    got = [x for x in result(decontaminate(edge, b)) if x[0] != 7]
    assert got == [x for x in brute(docs, items) if x[0] != 7]
    hot = [r for r in decontaminate(edge, b).collect() if r["doc_id"] == 7][0]
    assert (hot["n_words"], hot["n_hit"]) == (180_000, 179_998)
    assert decontaminate(nothing, b).collect() == []
    assert [r["n_hit"] for r in decontaminate(edge, b.limit(0)).collect()] == [0] * edge.count()


@pytest.mark.parametrize("name", ["op2_decontamination", "op6_embeddings"])
def test_sql(spark, duck, name):
    assert not compare(QUERIES[name](spark, "/root/testdata/sf0.001"), ORACLE[name], duck)
