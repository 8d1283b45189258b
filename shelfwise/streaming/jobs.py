"""Structured Streaming twins of the incremental computations (§2.11).

Inputs arrive as parquet files in a folder (file source); results go to parquet
tables through ``foreachBatch``, one folder per batch id that a replay overwrites,
so a restarted query resumes from its checkpoint without repeated rows.  All folders live
under the session's ``spark.checkpoint.dir`` (shared storage on a cluster).
"""

from __future__ import annotations

import uuid

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from shelfwise.operators.common import instant_to_ntz, ntz_micros, ntz_to_instant
from shelfwise.session import checkpoint_dir


CLOSING = "2200-01-01 00:00:00"


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint directory."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def land_files(df: DataFrame, path: str, order_col: str, files: int = 8, by: Column | None = None) -> int:
    """Write ``df`` as files that arrive oldest first; returns how many make one arrival.

    By ``order_col``, in ``files`` files that arrive one at a time; or one drop per value of
    ``by``, which every task of ``df`` writes its share of, so that no drop is one task's work.
    All drops get the same number of files (empty ones where a task had no rows for it): a
    micro-batch of that many files (``maxFilesPerTrigger``) is one drop.  The file source takes
    files by their modification time, which is set here; a feeder for the registry's entries
    and tests, as an upstream writer would deliver them.
    """
    spark = df.sparkSession
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    conf = spark._jsc.hadoopConfiguration()
    fs = hadoop(path).getFileSystem(conf)
    if by is None:
        df.repartitionByRange(files, order_col).sortWithinPartitions(order_col).write.parquet(path)
        drops, size = [[f"{path}/{n}"] for n in _folders(spark, path, "part-")], 1
    else:
        df.withColumn("drop", by).write.partitionBy("drop").parquet(path)
        found = {f"{path}/{n}": _folders(spark, f"{path}/{n}", "part-") for n in _folders(spark, path, "drop=")}
        size = max(map(len, found.values()), default=1)
        if any(len(names) < size for names in found.values()):
            spark.createDataFrame([], df.schema).coalesce(1).write.parquet(f"{path}/_none")
            none = hadoop(f"{path}/_none/{_folders(spark, f'{path}/_none', 'part-')[0]}")
            for folder, names in found.items():
                for i in range(len(names), size):
                    names.append(f"part-none-{i:05d}.parquet")
                    spark._jvm.org.apache.hadoop.fs.FileUtil.copy(fs, none, fs, hadoop(f"{folder}/{names[-1]}"), False, conf)
        drops = [[f"{folder}/{n}" for n in names] for folder, names in found.items()]
    for i, drop in enumerate(drops):
        for name in drop:
            fs.setTimes(hadoop(name), 1_600_000_000_000 + i * 1000, -1)
    return size


def _run(query_builder, trigger_once: bool = True):
    q = query_builder.trigger(availableNow=True).start() if trigger_once else query_builder.start()
    q.awaitTermination()
    return q


def _batch_sink(target: str):
    """foreachBatch sink: one folder per batch id, overwritten when the batch is replayed."""
    def write(batch: DataFrame, batch_id: int):
        batch.write.mode("overwrite").parquet(f"{target}/__batch={batch_id}")
    return write


def latest_rows(spark: SparkSession, target: str, keys: list[str], schema_cols: list[str]) -> DataFrame:
    """Read a change table and keep the last version of each key."""
    ch = spark.read.parquet(target)
    last = ch.groupBy(*keys).agg(F.max_by(F.struct(*[c for c in schema_cols if c not in keys]), "__batch").alias("r"))
    return last.select(*keys, *[F.col(f"r.{c}").alias(c) for c in schema_cols if c not in keys])


def stream_daily_activity(spark: SparkSession, source: str, schema, watermark: str = "2 days",
                          ts: str = "created_at") -> DataFrame:
    """STM2: sessions per day and status, kept current as logs arrive.

    Event-time windows of one day with a watermark (late rows inside the
    watermark still update their day; state for closed days is dropped).
    Update mode feeds a change table; the latest row per (day, status) is the
    answer, equal to the batch aggregate AGG8 when disorder stays within the
    watermark.
    """
    out = scratch(spark, "stm2-out")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
    agg = (stream.withColumn(ts, ntz_to_instant(ts)).withWatermark(ts, watermark)
           .groupBy(F.window(ts, "1 day").alias("w"), "status").agg(F.count(F.lit(1)).alias("sessions"))
           .select(F.to_date(instant_to_ntz("w.start")).alias("activity_date"), "status", "sessions"))
    _run(agg.writeStream.outputMode("update").option("checkpointLocation", scratch(spark, "stm2-ckpt"))
         .foreachBatch(_batch_sink(out)))
    return latest_rows(spark, out, ["activity_date", "status"], ["activity_date", "status", "sessions"])


def stream_activity_48h(spark: SparkSession, source: str, schema, watermark: str = "2 days",
                        ts: str = "created_at") -> DataFrame:
    """STM4: sessions in each trailing 48-hour window, sliding by one hour."""
    out = scratch(spark, "stm4-out")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
    agg = (stream.withColumn(ts, ntz_to_instant(ts)).withWatermark(ts, watermark)
           .groupBy(F.window(ts, "48 hours", "1 hour").alias("w")).agg(F.count(F.lit(1)).alias("sessions"))
           .select(instant_to_ntz("w.start").alias("window_start"), "sessions"))
    _run(agg.writeStream.outputMode("update").option("checkpointLocation", scratch(spark, "stm4-ckpt"))
         .foreachBatch(_batch_sink(out)))
    return latest_rows(spark, out, ["window_start"], ["window_start", "sessions"])


SLICE_US = 3_600_000_000


class Cooldown(StatefulProcessor):
    """Greedy cool-down of one platform over rows that may arrive out of order.

    Instants wait in a map of hour slices until the watermark has passed their slice (an
    event-time timer per slice), then they are taken in order; the state holds the last
    accepted instant and the open slices only, so it is bounded by the watermark delay.
    """

    def __init__(self, hours: int):
        self.limit = int(hours) * 3600 * 1_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "us long")
        self.slices = handle.getMapState("slices", "slice long", "instants array<long>")

    def handleInputRows(self, key, rows, timerValues):
        seen: dict[int, set[int]] = {}
        for pdf in rows:
            for us in pdf["ts_us"].tolist():
                seen.setdefault(us // SLICE_US, set()).add(us)
        passed = timerValues.getCurrentWatermarkInMs()
        for part, instants in seen.items():
            end = (part + 1) * SLICE_US // 1000
            if end <= passed:
                continue  # the slice is closed: these rows are later than the watermark allows
            if self.slices.containsKey((part,)):
                instants |= set(self.slices.getValue((part,))[0])
            else:
                self.handle.registerTimer(end)
            self.slices.updateValue((part,), (sorted(instants),))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        # timers need not fire in order: the first one takes every slice that is closed by now
        closed = sorted(k[0] for k in self.slices.keys() if (k[0] + 1) * SLICE_US // 1000 <= timerValues.getCurrentWatermarkInMs())
        last = self.last.get()[0] if self.last.exists() else None
        out = []
        for part in closed:
            for us in sorted(self.slices.getValue((part,))[0]):
                if last is None or us - last >= self.limit:
                    out.append(us)
                    last = us
            self.slices.removeKey((part,))
        if out:
            self.last.update((last,))
            yield pd.DataFrame({"platform": [key[0]] * len(out), "ts_us": out})

    def close(self) -> None:
        pass


def stream_cooldown(spark: SparkSession, source: str, schema, hours: int = 12, ts: str = "created_at", key: str = "platform",
                    watermark: str = "1 hour", checkpoint: str | None = None, target: str | None = None) -> DataFrame:
    """STM3: a session on a platform is accepted only >= ``hours`` after the previously accepted one (batch twin: WIN14).

    Rows may be out of order by up to the ``watermark`` delay; later ones are dropped.  An
    instant is decided once the watermark has passed its hour, so the last rows stay open
    until newer ones come (:func:`close_stream`).  Equal instants of a platform reach the
    state once.  A restart from ``checkpoint`` into the same ``target`` repeats no row.
    """
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    out = target or scratch(spark, "stm3-out")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
    rows = (stream.select(F.col(key).alias("platform"), ntz_to_instant(ts).alias("at"), ntz_micros(ts).alias("ts_us")).where("platform IS NOT NULL AND at IS NOT NULL")
            .withWatermark("at", watermark))
    acc = rows.groupBy("platform").transformWithStateInPandas(
        Cooldown(hours), outputStructType="platform string, ts_us long", outputMode="append", timeMode="eventTime")
    _run(acc.writeStream.outputMode("append").option("checkpointLocation", checkpoint or scratch(spark, "stm3-ckpt")).foreachBatch(_batch_sink(out)))
    res = spark.read.schema("platform string, ts_us long").parquet(out)
    return res.select(F.col("platform"), F.timestamp_add("MICROSECOND", F.col("ts_us"), F.expr("TIMESTAMP_NTZ'1970-01-01 00:00:00'")).alias(ts))


def close_stream(spark: SparkSession, source: str, schema, ts: str = "created_at", key: str = "platform") -> None:
    """Adds a last file with one row of no platform far in the future: the watermark passes everything before it."""
    cols = [F.lit(CLOSING).cast("timestamp_ntz").alias(f.name) if f.name == ts else F.lit("").alias(f.name) if f.name == key
            else F.lit(None).cast(f.dataType).alias(f.name) for f in schema.fields]
    spark.range(1).select(*cols).write.mode("append").parquet(source)


def _folders(spark: SparkSession, base: str, prefix: str) -> list[str]:
    """Names of the files and folders in ``base`` that start with ``prefix``, ascending; none if ``base`` does not exist.

    Any other failure of the file system is raised.
    """
    path = spark._jvm.org.apache.hadoop.fs.Path(base)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return []
    return sorted(n for n in (f.getPath().getName() for f in fs.listStatus(path)) if n.startswith(prefix))


def _committed(spark: SparkSession, folder: str) -> bool:
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/_SUCCESS")
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)


def _current_version(spark: SparkSession, target: str, before: str | None = None) -> str | None:
    """The newest version folder (older than ``before``) whose write was committed.

    Versions are never changed once committed and nothing points at them, so there
    is no pointer that a crash could lose.  Folders without a commit mark are
    unfinished writes and are skipped; if there are only such folders beside a
    finished batch, that is an error, never an empty table.
    """
    names = [n for n in _folders(spark, target, "v=") if before is None or n < before]
    for name in reversed(names):
        if _committed(spark, f"{target}/{name}"):
            return f"{target}/{name}"
    if names and (before is not None or len(names) > 1):  # an earlier batch was finished, so its mark is lost
        raise RuntimeError(f"{target} holds versions but none is committed: {names}")
    return None


def _bucket(buckets: int) -> Column:
    return F.pmod(F.xxhash64("platform", "sku"), F.lit(int(buckets))).cast("int")


def read_version(spark: SparkSession, version: str, schema) -> DataFrame:
    """The table that a manifest folder (see :func:`stream_upsert`) names."""
    base = version.rsplit("/manifest/", 1)[0]
    parts = [f"{base}/{r.data}" for r in spark.read.parquet(version).orderBy("bucket").collect()]  # one row per bucket
    return spark.read.schema(schema).parquet(*parts) if parts else spark.createDataFrame([], schema)


def _expire(spark: SparkSession, base: str, keep: int) -> None:
    """Removes manifests but the last ``keep`` committed ones, and bucket folders that no kept manifest names."""
    names = [n for n in _folders(spark, f"{base}/manifest", "v=") if _committed(spark, f"{base}/manifest/{n}")]
    old, kept = names[:-keep], names[-keep:]
    if not old:
        return
    used = {r.data for n in kept for r in spark.read.parquet(f"{base}/manifest/{n}").collect()}
    path = spark._jvm.org.apache.hadoop.fs.Path
    fs = path(base).getFileSystem(spark._jsc.hadoopConfiguration())
    for n in old:
        fs.delete(path(f"{base}/manifest/{n}"), True)
    newest = kept[-1]
    for v in _folders(spark, f"{base}/data", "v="):
        if v <= newest:  # a later one is a write under way
            for b in _folders(spark, f"{base}/data/{v}", "bucket="):
                if f"data/{v}/{b}" not in used:
                    fs.delete(path(f"{base}/data/{v}/{b}"), True)


def stream_upsert(spark: SparkSession, source: str, schema, target: str, asof_col: str = "scraped_date",
                  checkpoint: str | None = None, buckets: int = 64, keep: int = 2, files: int = 1) -> str:
    """STM1: product snapshots arrive as files and are upserted batch by batch, ``files`` files in a batch.

    The table lies in ``buckets`` hash buckets of (platform, sku).  A micro-batch is
    de-duplicated per key (WIN1) and merged (UPS1) with the buckets that it touches only;
    these are written anew under ``data/v=<batch id>``, and ``manifest/v=<batch id>`` names
    the folder of every bucket.  A version counts once its manifest's commit mark is there,
    so a batch replayed after a failure starts from the manifest before its own and writes
    the same rows, and a restarted query (same ``checkpoint``) continues from the newest one.
    All but the last ``keep`` versions are removed.  Choose ``buckets`` so that one is a few
    hundred MB; the manifest has one row for each.  A large bucket is written by several tasks.  Returns the newest manifest's folder
    (:func:`read_version`).
    """
    from shelfwise.operators.upsert import upsert_products
    base = target.rstrip("/")
    names = [f.name for f in schema.fields]

    def merge(batch: DataFrame, batch_id: int):
        batch = batch.select(*names)
        seen = batch.groupBy(_bucket(buckets).alias("b")).agg(F.max(asof_col).alias("asof")).orderBy("b").collect()
        if not seen:
            return
        touched = [r.b for r in seen]
        asof = max((r.asof for r in seen if r.asof is not None), default=None)
        version = f"v={batch_id:08d}"
        before = _current_version(spark, f"{base}/manifest", before=version)
        held = {r.bucket: r.data for r in spark.read.parquet(before).collect()} if before else {}
        parts = [f"{base}/{held[b]}" for b in touched if b in held]
        current = spark.read.schema(schema).parquet(*parts) if parts else spark.createDataFrame([], schema)
        merged = upsert_products(current, batch, asof).select(*names, _bucket(buckets).alias("bucket"))
        merged.hint("rebalance", "bucket").write.partitionBy("bucket").mode("overwrite").parquet(f"{base}/data/{version}")
        now = held | {b: f"data/{version}/bucket={b}" for b in touched}
        spark.createDataFrame(sorted(now.items()), "bucket int, data string").coalesce(1).write.mode("overwrite").parquet(f"{base}/manifest/{version}")
        _expire(spark, base, keep)

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(source)
    _run(stream.writeStream.option("checkpointLocation", checkpoint or scratch(spark, "stm1-ckpt"))
         .foreachBatch(merge))
    return _current_version(spark, f"{base}/manifest")
