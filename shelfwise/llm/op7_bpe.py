"""Byte-level BPE encoding and decoding through a global distinct-word shuffle.

1. Texts are cut into pre-tokens.  Each task keeps its texts in blocks: a block's distinct
   pre-tokens are rows (block, index, word), and a text is the sequence of its words'
   indexes, in position order, packed into bytes.  So the explode carries each word once
   per block and a position costs one to three bytes instead of a row.  Words and packed
   texts are two passes over the documents, so neither is written besides its shuffle;
   a block is named by a digest of its place (task, turn) and its texts, so blocks of equal
   copies stay apart, and one whose words are missing (an input that does not repeat
   itself) fails instead of giving wrong ids.
2. The words are shuffled by a hash of the word: one row per block and hash bucket, the
   words packed.  All copies of a word meet in one bucket, which encodes it once and
   answers every (block, index) that asked.  There are as many buckets as shuffle partitions.
3. Ids and packed texts are shuffled by block and reassembled by position.

A word occurs at most once in a block, so the most frequent word has as many rows as
there are blocks, never as many as it has occurrences; a block holds at most
``BLOCK_SYMBOLS`` pre-tokens, or one text that alone has more.

Decoding joins ids with the token-byte table of the vocabulary: the table has as many
rows as the vocabulary file (refused above ``MAX_VOCABULARY``) and is held by every task.

Null text: no ids, null decoded bytes only where the caller's ids are null.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK_SYMBOLS = 1_000_000
MAX_VOCABULARY = 1_000_000


@lru_cache(maxsize=2)
def ranks(path: str) -> dict[bytes, int]:
    """Token bytes -> rank from a rank file (base64 token, rank)."""
    out = {}
    with open(path, "rb") as f:
        for line in f:
            if line.strip():
                token, rank = line.split()
                out[base64.b64decode(token)] = int(rank)
    if len(out) > MAX_VOCABULARY:
        raise ValueError(f"{path}: more than {MAX_VOCABULARY} tokens")
    return out


def bpe(word: bytes, rank: dict[bytes, int]) -> list[int]:
    """Merge the adjacent pair of least rank (the leftmost of equals) until none is in the table."""
    if word in rank:
        return [rank[word]]
    parts = [word[i:i + 1] for i in range(len(word))]
    if len(parts) > 256:
        return _bpe_long(parts, rank)
    keys = [rank.get(parts[i] + parts[i + 1]) for i in range(len(parts) - 1)]
    while True:
        best, at = None, -1
        for i, k in enumerate(keys):
            if k is not None and (best is None or k < best):
                best, at = k, i
        if best is None:
            return [rank[p] for p in parts]
        parts[at:at + 2] = [parts[at] + parts[at + 1]]
        del keys[at]
        if at < len(keys):
            keys[at] = rank.get(parts[at] + parts[at + 1])
        if at:
            keys[at - 1] = rank.get(parts[at - 1] + parts[at])


def _bpe_long(parts: list[bytes], rank: dict[bytes, int]) -> list[int]:
    """The same merges with a heap over a linked list, for words of any length."""
    import heapq
    n = len(parts)
    left, right = list(range(-1, n - 1)), [*range(1, n), -1]
    heap = [(k, i, parts[i], parts[i + 1]) for i in range(n - 1) if (k := rank.get(parts[i] + parts[i + 1])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, a, b = heapq.heappop(heap)
        j = right[i]
        if parts[i] is not a or j < 0 or parts[j] is not b:
            continue
        parts[i], parts[j] = a + b, None
        right[i] = right[j]
        if right[i] >= 0:
            left[right[i]] = i
        for x in (left[i], i):
            if x >= 0 and right[x] >= 0 and (k := rank.get(parts[x] + parts[right[x]])) is not None:
                heapq.heappush(heap, (k, x, parts[x], parts[right[x]]))
    return [rank[p] for p in parts if p is not None]


@lru_cache(maxsize=2)
def splitter(pattern: str):
    """Pre-token finder for a pattern over the classes L, N and white space.

    Texts within Latin-1 use ``re`` with the classes spelled out for that range, which
    finds the same pre-tokens in half the time; other texts use ``regex``.
    """
    import re

    import regex
    general = regex.compile(pattern).findall
    body = {}
    for name in (r"\p{L}", r"\p{N}", r"\s"):
        ok = regex.compile(name)
        body[name] = "".join(f"\\x{i:02x}" for i in range(256) if ok.match(chr(i)))
    out, inside = [], False
    for piece in re.findall(r"\\p\{.\}|\\.|.", pattern, re.S):
        if piece in body:
            out.append(body[piece] if inside else f"[{body[piece]}]")
        elif piece == r"\S":
            out.append("[^" + body[r"\s"] + "]")
        else:
            inside = piece == "[" or (inside and piece != "]")
            out.append(piece)
    latin = re.compile("".join(out)).findall

    def find(text: str) -> list[str]:
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return general(text)
        return latin(text)

    return find


def pack(codes: np.ndarray) -> bytes:
    """Indexes as byte planes (low bytes first), compressed; a text without words is the byte 0."""
    planes = codes.astype("<u4").view(np.uint8).reshape(-1, 4).T
    used = max(1, 4 - next((k for k in range(4) if planes[3 - k].any()), 4))
    return bytes([used]) + zstandard.ZstdCompressor(level=3).compress(np.ascontiguousarray(planes[:used]).tobytes())


def unpack(data: bytes) -> np.ndarray:
    used = data[0]
    if not used:
        return np.zeros(0, "<u4")
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data[1:]), np.uint8)
    out = np.zeros((len(raw) // used, 4), np.uint8)
    out[:, :used] = raw.reshape(used, -1).T
    return out.view("<u4").ravel()


def pack_words(words: list[str]) -> bytes:
    """Lengths and letters of some words, compressed."""
    data = [w.encode("utf-8", "replace") for w in words]
    size = np.array([len(d) for d in data], "<u4").tobytes()
    return zstandard.ZstdCompressor(level=3).compress(len(data).to_bytes(4, "little") + size + b"".join(data))


def unpack_words(packed: bytes) -> list[bytes]:
    raw = zstandard.ZstdDecompressor().decompress(packed)
    n = int.from_bytes(raw[:4], "little")
    ends = (np.cumsum(np.frombuffer(raw, "<u4", n, 4), dtype=np.int64) + 4 + 4 * n).tolist()
    return [raw[a:b] for a, b in zip([4 + 4 * n, *ends], ends)]


def _blocks(pattern: str, buckets: int, want_words: bool):
    """Tasks' texts -> rows of the blocks' words (block, bucket, idx, words) or of their texts (block, row, codes)."""
    schema = "block long, bucket int, idx binary, words binary" if want_words else "block long, row string, codes binary"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        split = splitter(pattern)
        index: dict[str, int] = {}
        texts: list[tuple[str, np.ndarray]] = []
        task = TaskContext.get().partitionId()
        held, made = 0, 0
        digest = xxhash.xxh64(f"{task} {made}")

        def flush():
            nonlocal held, made, digest
            block = np.uint64(digest.intdigest()).astype(np.int64)
            words = list(index)
            # frequent words get small indexes, which pack into fewer bytes
            count = np.bincount(np.concatenate([c for _, c in texts]), minlength=len(words))
            order = np.argsort(-count, kind="stable")
            place = np.empty(len(words), np.int32)
            place[order] = np.arange(len(words), dtype=np.int32)
            if want_words:
                words.sort()  # neighbours alike compress better
                bucket = np.array([xxhash.xxh32_intdigest(w) % buckets for w in words], np.int32)
                place = place[[index[w] for w in words]]
                rows = []
                for k in np.unique(bucket).tolist():
                    at = np.flatnonzero(bucket == k)
                    rows.append((block, k, pack(place[at]), pack_words([words[i] for i in at.tolist()])))
                yield pd.DataFrame(rows, columns=["block", "bucket", "idx", "words"])
            else:
                for at in range(0, len(texts), 2000):
                    some = texts[at:at + 2000]
                    yield pd.DataFrame({"block": block, "row": [k for k, _ in some],
                                        "codes": [pack(place[c]) if len(c) else b"\0" for _, c in some]})
            index.clear()
            texts.clear()
            held, made = 0, made + 1
            digest = xxhash.xxh64(f"{task} {made}")

        for pdf in batches:
            for key, x in zip(pdf["row"], pdf["t"]):
                words = split(x) if isinstance(x, str) else []
                known = list(map(index.get, words))
                if None in known:
                    known = [index.setdefault(w, len(index)) if i is None else i for w, i in zip(words, known)]
                texts.append((key, np.array(known, np.uint32)))
                digest.update((x if isinstance(x, str) else "").encode("utf-8", "replace") + b"\xff")
                held += len(words) + 20
                if held > BLOCK_SYMBOLS:
                    yield from flush()
        if texts:
            yield from flush()

    return run, schema


def _encode_words(path: str):
    """Rows of one shuffle partition, sorted by bucket: each distinct word of a bucket is encoded once."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rank = ranks(path)
        last, known = None, {}
        for pdf in batches:
            out = []
            for bucket, packed in zip(pdf["bucket"], pdf["words"]):
                if bucket != last:
                    last, known = bucket, {}
                ids, size = [], []
                for w in unpack_words(packed):
                    got = known.get(w)
                    if got is None:
                        got = known[w] = bpe(w, rank)
                    ids += got
                    size.append(len(got))
                out.append((pack(np.array(size)), pack(np.array(ids))))
            yield pd.DataFrame({"block": pdf["block"], "idx": pdf["idx"], "size": [a for a, _ in out], "ids": [b for _, b in out]})

    return run


def _reassemble(words: pd.DataFrame, texts: pd.DataFrame) -> pd.DataFrame:
    """One block: ids of its words, concatenated in the order of each text."""
    idx = np.concatenate([unpack(d) for d in words["idx"]] or [np.zeros(0, "<u4")])
    size = np.concatenate([unpack(d) for d in words["size"]] or [np.zeros(0, "<u4")]).astype(np.int64)
    flat = np.concatenate([unpack(d) for d in words["ids"]] or [np.zeros(0, "<u4")])
    start = np.cumsum(size) - size
    idx, first = np.unique(idx, return_index=True)  # in the order of the indexes
    size, start = size[first], start[first]
    out = []
    for data in texts["codes"]:
        codes = unpack(data).astype(np.int64)
        if len(codes) and (codes.max() >= len(idx) or idx[-1] + 1 != len(idx)):
            raise RuntimeError("the words of a block are missing: the input changed between two passes")
        n = size[codes]
        total = int(n.sum())
        at = np.repeat(start[codes] - (np.cumsum(n) - n), n)
        out.append(flat[at + np.arange(total)].tobytes())
    return pd.DataFrame({"row": texts["row"], "ids": out})


def encode(docs: DataFrame, path: str, pattern: str, key: str = "doc_id", text: str = "text", decoded: bool = False) -> DataFrame:
    """One row per row of ``docs``: ``key`` (its string form under ``row``) and ids (little-endian uint32 bytes).

    The result has columns row (the key as string, null for a null key) and ids; rows with
    equal keys stay separate rows.  ``decoded`` adds the bytes that the ids stand for, found
    block by block where the ids are put together.
    """
    def block(words: pd.DataFrame, texts: pd.DataFrame) -> pd.DataFrame:
        out = _reassemble(words, texts)
        return out.assign(decoded=list(map(decoder(path), out["ids"]))) if decoded else out

    schema = "row string, ids binary, decoded binary" if decoded else "row string, ids binary"
    base = docs.select(F.col(key).cast("string").alias("row"), F.col(text).alias("t"))
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    words = base.mapInPandas(*_blocks(pattern, parts, True))
    coded = (words.repartition(parts, "bucket").sortWithinPartitions("bucket")
             .mapInPandas(_encode_words(path), "block long, idx binary, size binary, ids binary"))
    texts = base.mapInPandas(*_blocks(pattern, parts, False))
    return coded.groupBy("block").cogroup(texts.groupBy("block")).applyInPandas(block, schema)


@lru_cache(maxsize=2)
def token_bytes(path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The token-byte table: where the bytes of each id begin, how many they are, all bytes in a row."""
    rank = ranks(path)
    tokens = [b""] * (max(rank.values(), default=-1) + 1)
    for t, i in rank.items():
        tokens[i] = t
    size = np.array([len(t) for t in tokens], np.int64)
    return np.cumsum(size) - size, size, np.frombuffer(b"".join(tokens), np.uint8)


def decoder(path: str):
    """Ids (little-endian uint32 bytes) -> the bytes they stand for, joined with the token-byte table."""
    start, size, flat = token_bytes(path)

    def of(data: bytes) -> bytes:
        i = np.frombuffer(data, "<u4").astype(np.int64)
        parts = []
        for at in range(0, len(i), 1 << 20):
            j = i[at:at + (1 << 20)]
            n = size[j]
            first = np.repeat(start[j] - (np.cumsum(n) - n), n)
            parts.append(flat[first + np.arange(int(n.sum()))].tobytes())
        return b"".join(parts)

    return of


def decode(encoded: DataFrame, path: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """``encoded`` with the bytes its ids stand for, by a join with the token-byte table."""
    @F.pandas_udf("binary")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        text = decoder(path)
        for s in batches:
            yield pd.Series([None if data is None else text(data) for data in s], dtype=object)

    return encoded.withColumn(out, of(F.col(ids)))


def sha256_hex(data) -> str:
    return hashlib.sha256(data).hexdigest()
