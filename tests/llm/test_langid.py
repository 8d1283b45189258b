import numpy as np
from pyspark.sql import functions as F

from shelfwise.llm import op9_langid as op9


def phrases(seq, train):
    """Greedy longest-match phrases of one segment, by plain search."""
    src, n, i = "".join(map(chr, train)), 0, 0
    s = "".join(map(chr, seq))
    while i < len(s):
        k = 1
        while i + k < len(s) and s[i:i + k + 1] in src:
            k += 1
        if s[i:i + k] not in src:
            k = 1 + next((m for m in range(len(s) - i - 1, 0, -1) if s[i + 1:i + 1 + m] in src), 0)
        n, i = n + 1, i + k
    return n


def test_parse_against_plain_search(monkeypatch):
    monkeypatch.setattr(op9, "SEGMENT", 40)
    m = op9.Model({"x": ["abracadabra alakazam", "hocus pocus"], "y": ["zyzzyva fjord", "vext quiz"]})
    train = [m._train(["abracadabra alakazam", "hocus pocus"]), m._train(["zyzzyva fjord", "vext quiz"])]
    for t in ("abra kazam quiz", "pocus zyzz hocus fjord alaka zam vex " * 5, "a", "Q q Q"):
        s = op9.symbols(t, m.table)
        want = [sum(phrases(s[i:i + 40].tolist(), tr) for i in range(0, len(s), 40)) for tr in train]
        assert m.parse([s])[0].tolist() == want, t


def test_symbols_fold_and_collapse():
    t = op9.fold_table("aé")
    assert op9.symbols("A..é  É1x", t).tolist() == [0, 1, 0, 2, 0, 2, 0, 3, 0]
    assert op9.symbols("", t).tolist() == [0]


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").withColumn("held_out", op9.held_out(F.col("doc_id")))
    model = op9.train(docs.where("not held_out"))
    rows = op9.predict(docs.where("held_out"), model).select("lang", "language.*").collect()
    assert len(rows) > 150
    assert np.mean([r["lang"] == r["lang_pred"] for r in rows]) > 0.97
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_edge_rows(edge, nothing):
    model = op9.train(edge)
    rows = op9.predict(edge, model).collect()
    assert len(rows) == edge.count()
    for r in rows:
        blank = not any(c.isalpha() for c in r["text"] or "")
        assert (r["language"]["lang_pred"] == "und") == blank
        assert 0 <= r["language"]["score"] <= 1
    assert op9.predict(nothing, model).collect() == []
    assert {r["language"]["lang_pred"] for r in op9.predict(edge, op9.train(nothing)).collect()} == {"und"}


def test_pieces_do_not_change_the_kind(monkeypatch):
    m = op9.Model({"x": ["abracadabra alakazam"], "y": ["zyzzyva fjord"]})
    whole = m.predict(["abra " * 500])[0][0]
    monkeypatch.setattr(op9, "PIECE", 64)
    assert m.predict(["abra " * 500])[0][0] == whole == "x"


def invented(letters, n, seed):
    rng = np.random.default_rng(seed)
    vocabulary = ["".join(rng.choice(list(letters), rng.integers(2, 6))) for _ in range(60)]
    return [" ".join(rng.choice(vocabulary, 12)) for _ in range(n)]


def test_copies_do_not_thin_the_draw(spark, monkeypatch):
    monkeypatch.setattr(op9, "TRAIN_ROWS", 10)
    a, b = invented("abcdefgh", 30, 1), invented("abcdefgh", 30, 2)
    docs = spark.createDataFrame([(x, "a") for x in a] + [(x, "b") for x in b] + [("abab gaga", "b")] * 60_000, "text string, lang string")
    model = op9.train(docs)
    assert model.langs == ["a", "b"]
    assert len(np.unique(model.bits.round(-1))) == 1  # both learn from several texts
    got = [p[0] for p in model.predict(a + b)]
    assert np.mean([x == y for x, y in zip(got, ["a"] * 30 + ["b"] * 30)]) > 0.95


def test_a_language_of_long_texts_is_learned(spark):
    a, b = invented("abcdefgh", 40, 3), invented("abcdefgh", 4000, 4)
    long = "0 " * 15_000 + " ".join(b)
    assert len(long) > 2 * op9.TRAIN_MAX_CHARS
    model = op9.train(spark.createDataFrame([(x, "a") for x in a] + [(long, "b")], "text string, lang string"))
    assert model.langs == ["a", "b"]
    assert [p[0] for p in model.predict(a[:5] + b[-5:])] == ["a"] * 5 + ["b"] * 5


def test_little_training_text_does_not_lose_by_its_size():
    a, b = invented("abcdefgh", 600, 5), invented("abcdefgh", 600, 6)
    m = op9.Model({"much": a[:500], "little": b[:4]})
    assert np.mean([p[0] == "little" for p in m.predict(b[500:])]) > 0.95
    assert np.mean([p[0] == "much" for p in m.predict(a[500:])]) > 0.95


def test_letters_beyond_single_symbols_are_not_merged():
    han = [chr(0x4E00 + i) for i in range(1200)]
    latin = invented("abcdefgh", 100, 7)
    a, b = invented(han[300:700], 300, 8), invented(han[800:1200], 300, 9)
    c = invented(han[:300], 200, 10) + ["".join(han[:300])]
    m = op9.Model({"a": a[:200], "b": b[:200], "c": c, "latin": latin[:60]})
    got = [p[0] for p in m.predict(a[200:] + b[200:] + latin[60:])]
    assert got == ["a"] * 100 + ["b"] * 100 + ["latin"] * 40


def test_codes_of_a_large_alphabet():
    ranks = [*range(9000), *range(50_000, 60_000), *range(140_000, 150_000)]
    codes = [op9.code(i).to_bytes(4, "little").rstrip(b"\0") for i in ranks]
    assert len(set(codes)) == len(codes) and all(0 < x < op9.SINGLE + 1 for c in codes for x in c)
    assert {len(c) for c in codes} == {1, 2, 3, 4}
    known = set(codes)
    assert not any(c[:i] in known for c in codes for i in range(1, len(c)))  # no code begins another
    table = op9.fold_table("".join(chr(0x4E00 + i) for i in range(400)))
    assert op9.symbols(chr(0x4E00) + chr(0x4E00 + 130) + "..x", table).tolist() == [0, 1, *op9.code(130).to_bytes(2, "little"), 0, op9.SINGLE + 1, 0]


def test_a_language_of_long_texts_in_a_large_alphabet_is_learned():
    """Letters beyond the single symbols take several, so one text is longer than a whole training sample."""
    import random

    from shelfwise.llm import op9_langid as op9
    rng = random.Random(6)
    signs = [chr(0x4E00 + i) for i in range(2500)]
    words = ["".join(rng.choice(signs[1800:]) for _ in range(2)) for _ in range(300)]
    long_ = lambda n: "".join(rng.choice(words) for _ in range(n))
    wide = ["".join(rng.choice(signs) for _ in range(4000)) for _ in range(4)]
    model = op9.Model({"han": [long_(20_000)], "wide": wide, "en": ["the quick brown fox jumps over the lazy dog " * 40]})
    assert all(len(a) > model.width * 100 for a in model.automata)
    got = model.predict([long_(400), "the lazy fox jumps over the dog", long_(50)])
    assert [g[0] for g in got] == ["han", "en", "han"] and got[0][2] <= op9.MAX_PHRASE_RATE
