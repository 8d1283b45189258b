import base64
import hashlib
import random

import public_tokenizers as P
import pytest

from shelfwise.llm import op3_tokencount as op3
from shelfwise.llm import op7_bpe as op7

PARTS = ["a", "B", "é", "É", "Σ", "ς", "İ", "ß", "'s", "'T", " ", "\n", "\x1c", "\x85", " ", "1", "٣", "²", "漢", "字", "ñ", "ñ",
         "<|endoftext|>", "<|ENDOFTEXT|>", "<|startoftext|>", "!", "...", "_", "🙂", "the", "ing", "ﬁ", "가", "﻿", "\x00", "HELLO", "ǅ"]


def texts(n=3000, seed=5):
    rng = random.Random(seed)
    return ["".join(rng.choice(PARTS) for _ in range(rng.randint(0, 14))) for _ in range(n)]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    return lambda x: len(t.encode(x or "", add_special_tokens=False).ids)


@pytest.fixture(scope="module")
def tiktoken_ids():
    import tiktoken
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary


@pytest.mark.parametrize("chunk", [5, 1 << 16])
def test_counts_against_the_library(library, monkeypatch, chunk):
    monkeypatch.setattr(op3, "CHUNK", chunk)
    c = op3.Counter(P.path("word_bpe_49k.json"))
    for x in texts():
        assert c.count(x) == library(x), x


def test_chunk_maps_compose_associatively():
    c = op3.Counter(P.path("word_bpe_49k.json"))
    rng = random.Random(1)
    for x in texts(300):
        i, j = sorted((rng.randint(0, len(x)), rng.randint(0, len(x))))
        a, b, d = c.chunk(x[:i]), c.chunk(x[i:j]), c.chunk(x[j:])
        assert c.compose(c.compose(a, b), d) == c.compose(a, c.compose(b, d))


def test_tables_started_anew_give_the_same(library, monkeypatch):
    monkeypatch.setattr(op3, "KEEP", 50)
    c = op3.Counter(P.path("word_bpe_49k.json"))
    assert [c.count(x) for x in texts(300)] == [library(x) for x in texts(300)]


def test_count_edge_rows(edge, nothing, small, library):
    path = P.path("word_bpe_49k.json")
    for df in (edge, small):
        for r in op3.token_counts(df, path).collect():
            assert r["n_tokens"] == library(r["text"])
            assert r["n_bytes"] == len((r["text"] or "").encode())
            assert r["over_limit"] == (r["n_tokens"] > 2048)
    assert op3.token_counts(nothing, path).collect() == []


def test_other_vocabularies_are_refused():
    with pytest.raises((ValueError, KeyError, TypeError)):
        op3.Counter(P.path("byte_bpe_50k.json"))


def test_words_against_tiktoken(tiktoken_ids):
    r, split = op7.ranks(P.path("byte_bpe_50k.tiktoken")), op7.splitter(P.PATTERN)
    for x in [*texts(), "a" * 3000, "ab" * 2000, "thntention" * 300]:
        assert [i for w in split(x) for i in op7.bpe(w.encode(), r)] == tiktoken_ids(x), x


@pytest.mark.parametrize("block", [20_000, op7.BLOCK_SYMBOLS])
def test_encode_and_decode(edge, nothing, small, tiktoken_ids, monkeypatch, block):
    monkeypatch.setattr(op7, "BLOCK_SYMBOLS", block)
    path = P.path("byte_bpe_50k.tiktoken")
    for df in (edge, small):
        # the small table decodes in a step of its own, the edge cases along with the encoding
        apart = df is small
        if block == 20_000 and df is edge:
            df = df.where("doc_id <> 7")
        coded = op7.decode(op7.encode(df, path, P.PATTERN), path) if apart else op7.encode(df, path, P.PATTERN, decoded=True)
        got = sorted((str(r["row"]), bytes(r["ids"]), bytes(r["decoded"])) for r in coded.collect())
        want = sorted((str(r["doc_id"]), b"".join(i.to_bytes(4, "little") for i in tiktoken_ids(r["text"] or "")), (r["text"] or "").encode()) for r in df.collect())
        assert [(k, hashlib.sha256(a).digest(), hashlib.sha256(b).digest()) for k, a, b in got] == [(k, hashlib.sha256(a).digest(), hashlib.sha256(b).digest()) for k, a, b in want]
    assert op7.encode(nothing, path, P.PATTERN).collect() == []


def test_blocks_of_equal_copies_stay_apart(spark, monkeypatch):
    monkeypatch.setattr(op7, "BLOCK_SYMBOLS", 100)
    df = spark.range(0, 400, numPartitions=4).selectExpr("id AS doc_id", "'one text that is copied' AS text")
    for want_words in (True, False):
        run, schema = op7._blocks(P.PATTERN, 1, want_words)
        rows = df.selectExpr("string(doc_id) AS row", "text AS t").mapInPandas(run, schema)
        assert rows.select("block").distinct().count() == 80
        assert rows.count() == (80 if want_words else 400)
    got = op7.encode(df, P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    assert got.count() == 400 and got.select("ids").distinct().count() == 1
