import hashlib
import random

import pytest

from pyspark.sql import functions as F
from shelfwise.llm import op11_fingerprint as op11
from shelfwise.llm.queries import op11_fingerprints


def plain_digest(text):
    """The digest by definition, one triplet and one bucket at a time."""
    data = (text or "").encode()
    counts = [0] * op11.BUCKETS
    for i in range(len(data) - 2):
        m = (data[i] | data[i + 1] << 8 | data[i + 2] << 16) * 0x9E3779B1 & 0xFFFFFFFF
        m = ((m ^ m >> 15) * 0x85EBCA77) & 0xFFFFFFFF
        counts[m * op11.BUCKETS >> 32] += 1
    srt = sorted(counts)
    q = [srt[op11.BUCKETS * i // 4 - 1] for i in (1, 2, 3)]
    body = bytearray(op11.BUCKETS // 4)
    for i, c in enumerate(counts):
        body[i // 4] |= sum(c > x for x in q) << 6 - 2 * (i % 4)
    ratios = 15 * q[0] // q[2] * 16 + 15 * q[1] // q[2] if q[2] else 0
    return bytes([op11.length_code(len(data)), ratios]) + bytes(body)


def plain(rows):
    """(doc_id, ...) of with_neighbours, by sorting all rows."""
    import xxhash  # noqa: F401
    rows = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0)))
    out = []
    for i, (doc, text) in enumerate(rows):
        text, after = text or "", rows[(i + 1) % len(rows)][1] or ""
        k = len(text) // 3
        new = text[:len(text) - k] + after[:k]
        a, b, c = plain_digest(text), plain_digest(new), plain_digest(after)
        out.append((doc, len(text), hashlib.sha256(new.encode()).hexdigest(), a.hex(), b.hex(), op11.likeness(a, b), op11.likeness(a, c)))
    return out


def got(df):
    return [(r["doc_id"], r["n_chars"], r["edited_sha256"], r["fingerprint"], r["edited_fingerprint"], r["near_edited"], r["near_next"]) for r in df.collect()]


@pytest.mark.parametrize("parts", [1, 5])
def test_against_plain_form(spark, parts):
    rng = random.Random(3)
    rows = [(i, "".join(rng.choice("abc dé漢🙂\n") for _ in range(rng.choice([0, 1, 2, 3, 5, 40, 300])))) for i in range(60)] + [(100, None), (None, "last ones")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)
    assert sorted(got(op11.with_neighbours(df)), key=repr) == sorted(plain(rows), key=repr)


def test_one_row_and_none(spark, nothing):
    assert got(op11.with_neighbours(nothing)) == []
    (row,) = got(op11.with_neighbours(spark.createDataFrame([(2 ** 60 + 1, "abcdef")], "doc_id long, text string")))
    assert row[0] == 2 ** 60 + 1 and row[2] == hashlib.sha256(b"abcdab").hexdigest() and row[6] == 1.0


def test_edge_rows(edge):
    rows = got(op11.with_neighbours(edge, keep_text=True))
    assert len(rows) == edge.count()
    by = {}
    for r in edge.select("doc_id", "text").collect():
        by.setdefault(r["doc_id"], []).append(plain_digest(r["text"]).hex())
    for r in rows:
        assert r[3] in by[r[0]] and 0 <= r[5] <= 1 and 0 <= r[6] <= 1
    kept = op11.with_digest(edge, out="fp").drop("fp").columns
    assert kept == [c for c in edge.columns if c != "fp"]
    d = op11.with_digest(edge, out="d").select("text", "d").collect()
    assert all(r["d"] == plain_digest(r["text"]).hex() for r in d if len(r["text"] or "") < 10_000)


def test_likeness_is_bounded_and_symmetric():
    rng = random.Random(5)
    ds = [op11.digest(rng.choice(["", "a", "ab", "x" * 500, "".join(rng.choice("abcdefgh ") for _ in range(rng.randrange(4000)))])) for _ in range(40)]
    for a in ds:
        assert op11.likeness(a, a) == 1.0
        for b in ds:
            assert 0.0 <= op11.likeness(a, b) == op11.likeness(b, a) <= 1.0
            assert (op11.likeness(a, b) == 1.0) == (a == b)


def test_edited_texts_are_nearer_than_the_next_document(spark):
    rows = op11_fingerprints(spark, "/root/testdata/sf0.01")
    d = rows.join(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", F.length("text").alias("n")), "doc_id").where("n >= 200 AND near_next < 1").collect()
    assert sum(r["near_edited"] > r["near_next"] for r in d) / len(d) > 0.97
    high = [r["near_edited"] for r in d]
    assert sum(h > 0.4 for h in high) / len(high) > 0.9


def test_likeness_columns(spark):
    df = op11.with_digest(spark.createDataFrame([("one text here", "one text here"), ("one text here", None)], "a string, b string"), "a", "x")
    df = op11.with_digest(df, "b", "y")
    r = df.select(op11.likeness_of("x", "y").alias("l"), op11.likeness_of("x", F.lit(None).cast("string")).alias("n")).collect()
    assert r[0]["l"] == 1.0 and r[1]["l"] < 1.0 and r[0]["n"] is None
