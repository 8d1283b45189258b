"""Sharding by best-fit-decreasing bin packing of indivisible groups.

Groups are rows with equal texts and stay together.  Sorted by size, each goes to the
open bin of least remaining capacity that still holds it, found in a balanced tree; a
new bin is opened only when none does.

Billions of groups cannot pass through one task, so groups are first bundled by a hash
of the text into ``shards * PARCELS`` parcels; a group of a parcel's mean size or more
is a parcel of its own (by their sizes there are at most as many again).  The packing
then sees a bounded list at every input size, and rows find their shard by two joins
with that list, broadcast under this bound.  No row is shuffled.

Slots: rows are written once with their number within (partition, shard); counts per
(partition, shard) give the offset of each, so slots run without a gap from 0.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfwise.llm.common import stored

PARCELS = 1000


class CapacityTree:
    """AA tree of (remaining capacity, bin): insert, remove, least entry with enough room."""

    def __init__(self):
        self.root = None

    @staticmethod
    def _skew(t):
        if t and t[1] and t[1][3] == t[3]:
            left = t[1]
            t[1], left[2] = left[2], t
            return left
        return t

    @staticmethod
    def _split(t):
        if t and t[2] and t[2][2] and t[3] == t[2][2][3]:
            right = t[2]
            t[2], right[1] = right[1], t
            right[3] += 1
            return right
        return t

    def insert(self, key):
        def put(t):
            if t is None:
                return [key, None, None, 1]  # key, left, right, level
            side = 1 if key < t[0] else 2
            t[side] = put(t[side])
            return self._split(self._skew(t))
        self.root = put(self.root)

    def remove(self, key):
        def take(t, key):
            if t is None:
                return None
            if key == t[0]:
                if t[1] is None and t[2] is None:
                    return None
                if t[1] is None:
                    n = t[2]
                    while n[1]:
                        n = n[1]
                    t[0], t[2] = n[0], take(t[2], n[0])
                else:
                    n = t[1]
                    while n[2]:
                        n = n[2]
                    t[0], t[1] = n[0], take(t[1], n[0])
            else:
                side = 1 if key < t[0] else 2
                t[side] = take(t[side], key)
            low = min(t[1][3] if t[1] else 0, t[2][3] if t[2] else 0) + 1
            if low < t[3]:
                t[3] = low
                if t[2] and low < t[2][3]:
                    t[2][3] = low
            t = self._skew(t)
            if t[2]:
                t[2] = self._skew(t[2])
                if t[2][2]:
                    t[2][2] = self._skew(t[2][2])
            t = self._split(t)
            if t[2]:
                t[2] = self._split(t[2])
            return t
        self.root = take(self.root, key)

    def tightest(self, size):
        t, best = self.root, None
        while t:
            if t[0][0] >= size:
                best, t = t[0], t[1]
            else:
                t = t[2]
        return best

    def roomiest(self):
        t = self.root
        while t and t[2]:
            t = t[2]
        return t and t[0]


def pack(sizes: list[tuple[int, str]], capacity: int | None = None, shards: int | None = None) -> dict[str, int]:
    """name -> bin for (size, name) items, best-fit decreasing; equal sizes by name.

    With ``capacity``, as many bins as needed; an item above it gets a bin of its own.
    With ``shards``, that many: items larger than the mean of what is left take a bin
    each, the rest share a capacity of the mean, and what fits nowhere goes to the
    roomiest bin.
    """
    items = sorted(sizes, key=lambda x: (-x[0], x[1]))
    out: dict[str, int] = {}
    at, used = 0, 0
    if shards is not None:
        left, rest = shards, sum(s for s, _ in items)
        while at < len(items) and left > 1 and items[at][0] * left > rest:
            out[items[at][1]] = used
            rest -= items[at][0]
            used, left, at = used + 1, left - 1, at + 1
        capacity = -(-rest // left)
    tree = CapacityTree()
    for size, name in items[at:]:
        spot = tree.tightest(size)
        if spot is None and (shards is None or used < shards):
            spot, used = (capacity, used), used + 1
        else:
            spot = spot or tree.roomiest()
            tree.remove(spot)
        out[name] = spot[1]
        tree.insert((spot[0] - size, spot[1]))
    return out


def _number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the task's partition and each row's number within (partition, shard)."""
    part = TaskContext.get().partitionId()
    seen: dict[int, int] = {}
    for b in batches:
        shard = b.column(b.schema.get_field_index("shard")).to_numpy(zero_copy_only=False)
        nth = np.zeros(len(shard), np.int64)
        for s in np.unique(shard):
            at = np.flatnonzero(shard == s)
            nth[at] = np.arange(len(at)) + seen.get(int(s), 0)
            seen[int(s)] = seen.get(int(s), 0) + len(at)
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.full(len(shard), part), pa.int32()), pa.array(nth, pa.int64())],
                                         names=[*b.schema.names, "part", "nth"])


def shard_by_bytes(docs: DataFrame, shards: int = 24, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows of ``docs`` in ``shards`` bins of near equal bytes: key, size, text_crc32, shard, slot.

    ``size`` is the text's UTF-8 bytes (null: 0) plus 8; null texts are one group and have
    the checksum of no bytes; repeated rows are rows.  An empty table gives no rows.
    """
    t = F.col(text)
    rows = stored(docs.select(
        F.col(key).alias("key"), (F.coalesce(F.octet_length(t), F.lit(0)) + 8).cast("long").alias("size"),
        F.crc32(F.coalesce(t, F.lit("")).cast("binary")).alias("text_crc32"),
        F.coalesce(F.md5(t.cast("binary")), F.lit("null")).alias("group")), "shard-rows")
    groups = rows.groupBy("group").agg(F.sum("size").alias("size"))
    total = rows.agg(F.sum("size").alias("n")).first()["n"] or 0
    n_parcels = shards * PARCELS
    big = F.col("size") * n_parcels >= F.lit(total)
    bundle = F.concat(F.lit("#"), F.pmod(F.xxhash64("group"), F.lit(n_parcels)))
    parcels = (groups.select(F.when(big, F.col("group")).otherwise(bundle).alias("parcel"), "size")
               .groupBy("parcel").agg(F.sum("size").alias("size")).collect())  # at most 2 * shards * PARCELS rows
    placed = pack([(r["size"], r["parcel"]) for r in parcels], shards=shards)
    spark = docs.sparkSession
    plan = pd.DataFrame({"parcel": list(placed), "shard": list(placed.values())})
    bins = F.broadcast(spark.createDataFrame(plan.astype({"shard": "int32"}) if len(plan) else [], "parcel string, shard int"))
    own = F.broadcast(bins.where(~F.col("parcel").startswith("#")).select(F.col("parcel").alias("group"), F.col("shard").alias("own")))
    placed_rows = (rows.join(own, "group", "left").withColumn("parcel", F.when(F.col("own").isNull(), bundle))
                   .join(bins, "parcel", "left").withColumn("shard", F.coalesce("own", "shard"))
                   .select("key", "size", "text_crc32", "shard"))
    kind = placed_rows.schema["key"].dataType.simpleString()
    numbered = stored(placed_rows.mapInArrow(_number, f"key {kind}, size long, text_crc32 long, shard int, part int, nth long"), "shard-numbered")
    first = (numbered.groupBy("shard", "part").agg(F.count("*").alias("n"))
             .withColumn("first", F.sum("n").over(Window.partitionBy("shard").orderBy("part")) - F.col("n")))
    return (numbered.join(first, ["shard", "part"])
            .select(F.col("key").alias(key), "size", "text_crc32", "shard", (F.col("first") + F.col("nth")).alias("slot")))


def evenness(sharded: DataFrame) -> float:
    """Largest shard's bytes over the mean of the shards in use."""
    r = sharded.groupBy("shard").agg(F.sum("size").alias("b")).agg(F.max("b").alias("m"), F.avg("b").alias("a")).first()
    return math.nan if r["a"] is None else r["m"] / r["a"]
