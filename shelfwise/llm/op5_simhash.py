"""SimHash near-dedup by pigeonhole blocks.

The bits of a fingerprint are split into ``2 d`` blocks.  Fingerprints that differ in at
most ``d`` bits agree in at least ``d`` blocks, so with the key "all blocks but these d",
for every choice of d blocks, each close pair shares a key.

Only components are wanted, so a key returns a forest, not its pairs.  Keys of at most
``CROWD`` fingerprints are paired at once.  In a larger one every member is tried against
the least member; then the links found so far are contracted, and a crowded key whose
members are all in one component is done.  One that still holds two components is split
within its own open bits (members agree on the others), where close pairs share a key just
the same.  The open bits halve each time, and a key with d open bits or fewer is linked
whole by its least member, so every close pair is in one component.  Nothing is capped.

Exact copies are one fingerprint from the start, with the least document id of its rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwise.llm.common import stored, text_key
from shelfwise.llm.graph import components

CROWD = 16
SEED = 42
PIECE = 1 << 16


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """Unsigned SimHash of a text; no words: 0.  Words: ASCII-lower-cased runs without white space."""
    ws = text.encode("utf-8", "replace").lower().split() if isinstance(text, str) else []
    if not ws:
        return 0
    joined = b" ".join(ws)
    if len(ws) <= shingle:
        return xxhash.xxh64_intdigest(joined, SEED)
    ends = np.cumsum([len(w) + 1 for w in ws]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])[:len(ws) - shingle + 1].tolist()
    stops = ends[shingle - 1:].tolist()
    digest = xxhash.xxh64_intdigest
    total = np.zeros(64, np.int64)
    for at in range(0, len(starts), PIECE):
        h = np.array([digest(joined[a:b], SEED) for a, b in zip(starts[at:at + PIECE], stops[at:at + PIECE])], ">u8")
        total += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(total * 2 > len(starts)).tobytes(), "big")


def with_fingerprint(docs: DataFrame, text: str = "text", out: str = "fp", shingle: int = 3) -> DataFrame:
    """``docs`` with the fingerprint as a signed long; only the text goes to Python."""
    @F.pandas_udf("long")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield pd.Series(np.array([fingerprint(x, shingle) for x in s], np.uint64).view(np.int64))

    return docs.withColumn(out, of(F.col(text)))


def signed(m: int) -> int:
    return m - (1 << 64) if m >> 63 else m


@lru_cache(1 << 14)
def splits(opened: int, bits: int) -> tuple[int, ...]:
    """Masks of the bits that stay open (signed 64 bit, like ``opened``) when ``opened`` is split in blocks and all but ``bits`` of them are fixed."""
    at = [i for i in range(64) if opened >> i & 1]
    edge = [round(i * len(at) / (2 * bits)) for i in range(2 * bits + 1)]
    block = [sum(1 << i for i in at[a:b]) for a, b in zip(edge, edge[1:])]
    return tuple(sorted({signed(sum(c)) for c in combinations(block, bits)}))


def keyed(rows: DataFrame, bits: int) -> DataFrame:
    """(fp, open, k): each row's fingerprint under every split of its open bits (no column ``open``: all are); k holds the fixed bits."""
    @F.pandas_udf("array<long>")
    def finer(opened: pd.Series) -> pd.Series:
        return opened.map(lambda m: splits(m & ((1 << 64) - 1), bits))

    first = "open" not in rows.columns
    masks = F.array(*[F.lit(m) for m in splits((1 << 64) - 1, bits)]) if first else finer("open")
    keys = rows.select("fp", F.explode(masks).alias("open")).withColumn("k", F.col("fp").bitwiseAND(F.bitwise_not("open")))
    return keys if first else keys.distinct()


def near_components(fps: DataFrame, bits: int = 3) -> DataFrame:
    """(node, root): components of the links of at most ``bits`` (1 or more) bits among the distinct fingerprints in column fp.

    Fingerprints without a link may be missing.
    """
    roots, todo = None, fps.select("fp")
    near = lambda a, b: F.bit_count(F.col(a).bitwiseXOR(F.col(b))) <= bits
    while True:
        members = stored(keyed(todo, bits), "simhash-keys")
        shared = members.groupBy("open", "k").agg(F.count("*").alias("n"), F.min("fp").alias("least")).where("n > 1")
        members = stored(members.join(shared, ["open", "k"]), "simhash-members")
        crowds = members.where(F.col("n") > CROWD)
        pairs = (members.where(F.col("n") <= CROWD).groupBy("open", "k").agg(F.array_sort(F.collect_list("fp")).alias("fps"))
                 .select("fps", F.posexplode("fps").alias("i", "a"))
                 .select("a", F.explode(F.slice("fps", F.col("i") + 2, F.size("fps"))).alias("b")).where(near("a", "b")))
        stars = crowds.select(F.col("least").alias("a"), F.col("fp").alias("b")).where(near("a", "b"))
        links = pairs.union(stars)
        roots = components(links if roots is None else links.union(roots.toDF("a", "b")))
        # crowded keys whose members are not yet one component; a key with few open bits always is
        named = (crowds.where(F.bit_count("open") > bits).join(roots, F.col("fp") == F.col("node"), "left")
                 .select("open", "k", "fp", F.coalesce("root", "fp").alias("root")))
        split = named.groupBy("open", "k").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high")
        todo = stored(named.join(split.select("open", "k"), ["open", "k"], "left_semi").select("fp", "open"), "simhash-split")
        if not todo.limit(1).count():
            break
    return roots


def groups(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 3, bits: int = 3) -> DataFrame:
    """One row per row of ``docs``: key, th (content hash), fp, component (a long) and component_id.

    ``component_id`` is the least key among the rows reachable by links of at most
    ``bits`` differing bits (null if all their keys are null).  Null, empty and blank
    texts have fingerprint 0 and link like any other.
    """
    rows = stored(with_fingerprint(docs.select(F.col(key).alias("key"), text_key(F.col(text)).alias("th"), F.col(text).alias("t")), "t",
                                   shingle=shingle).select("key", "th", "fp"), "simhash-rows")
    classes = stored(rows.groupBy("fp").agg(F.min("key").alias("least")), "simhash-classes")
    roots = near_components(classes.select("fp"), bits)
    placed = stored(classes.join(roots.withColumnRenamed("node", "fp"), "fp", "left")
                    .select("fp", F.coalesce("root", "fp").alias("component"), "least"), "simhash-roots")
    least = stored(placed.groupBy("component").agg(F.min("least").alias("component_id")), "simhash-components")
    known = placed.select("fp", "component").join(least, "component")
    return rows.join(known, "fp").select(F.col("key").alias(key), "th", "fp", "component", "component_id")


def survivors(grouped: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, th) of the one document that stays of each group: the least key, then the least content hash."""
    return grouped.groupBy("component").agg(F.min(F.struct(F.col(key).isNull().alias("n"), F.col(key).alias("k"), "th")).alias("s")).select(
        F.col("s.k").alias(key), F.col("s.th").alias("th"))


def hex16(fp) -> F.Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
