"""Streaming twins: restart from the checkpoint and equality with the batch operators."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from shelfwise.operators import ranking as rk
from shelfwise.streaming import jobs as st


def test_stream_upsert_resumes_from_checkpoint(spark):
    d = dt.date
    rows = [("p1", "amazon", "S1", "T1", 10.0, d(2024, 1, 1)), ("p2", "amazon", "S2", "T2", 20.0, d(2024, 1, 1)),
            ("p3", "amazon", "S1", "T1b", 11.0, d(2024, 2, 1)), ("p4", "amazon", "S3", "T3", 30.0, d(2024, 3, 1))]
    df = spark.createDataFrame(rows, "product_id string, platform string, sku string, title string, price double, "
                                     "scraped_date date")
    src, target, ckpt = st.scratch(spark, "src"), st.scratch(spark, "tgt"), st.scratch(spark, "ckpt")
    # first two months arrive, the query stops; the third month arrives and the query restarts
    first = df.where(F.month("scraped_date") <= 2)
    st.land_files(first, src, "scraped_date", 2)
    v1 = st.stream_upsert(spark, src, df.schema, target, checkpoint=ckpt)
    assert {r.sku: r.title for r in st.read_version(spark, v1, df.schema).collect()} == {"S1": "T1b", "S2": "T2"}
    df.where(F.month("scraped_date") == 3).write.mode("append").parquet(src)
    v2 = st.stream_upsert(spark, src, df.schema, target, checkpoint=ckpt)
    final = {r.sku: (r.title, r.price) for r in st.read_version(spark, v2, df.schema).collect()}
    assert final == {"S1": ("T1b", 11.0), "S2": ("T2", 20.0), "S3": ("T3", 30.0)}


def test_a_one_product_batch_writes_one_bucket(spark):
    d = dt.date
    cols = "product_id string, platform string, sku string, title string, price double, scraped_date date"
    many = spark.createDataFrame([(f"p{i}", "amazon", f"S{i}", f"T{i}", 10.0 + i, d(2024, 1, 1)) for i in range(200)], cols)
    src, target, ckpt = st.scratch(spark, "src"), st.scratch(spark, "tgt"), st.scratch(spark, "ckpt")
    schema, args = many.schema, dict(checkpoint=ckpt, buckets=8)
    many.coalesce(1).write.parquet(src)
    v = st.stream_upsert(spark, src, schema, target, **args)
    first = {r.bucket: r.data for r in spark.read.parquet(v).collect()}
    assert sorted(first) == list(range(8)) and st.read_version(spark, v, schema).count() == 200
    for i, price in enumerate((1.0, 2.0, 3.0)):
        spark.createDataFrame([("q", "amazon", "S7", None, price, d(2024, 2, 1 + i))], cols).coalesce(1).write.mode("append").parquet(src)
        v = st.stream_upsert(spark, src, schema, target, **args)
    now = {r.bucket: r.data for r in spark.read.parquet(v).collect()}
    moved = [b for b in now if now[b] != first[b]]
    assert len(moved) == 1 and st._folders(spark, f"{target}/data/v=00000003", "bucket=") == [f"bucket={moved[0]}"]
    rows = {r.sku: r for r in st.read_version(spark, v, schema).collect()}
    assert len(rows) == 200 and (rows["S7"].product_id, rows["S7"].title, rows["S7"].price) == ("p7", "T7", 3.0)
    # two versions stay: the bucket's folders before them and the older manifests are gone, untouched buckets are not
    assert st._folders(spark, f"{target}/manifest", "v=") == ["v=00000002", "v=00000003"]
    assert st._folders(spark, f"{target}/data/v=00000001", "bucket=") == [] and len(st._folders(spark, f"{target}/data/v=00000000", "bucket=")) == 7


def test_a_drop_is_written_by_all_tasks_and_is_one_batch(spark):
    d = dt.date
    cols = "product_id string, platform string, sku string, title string, price double, scraped_date date"
    rows = [(f"p{y}-{i}", "amazon", f"S{i}", f"T{y}" if i % 3 else None, float(y + i), d(y, 1 + i % 12, 1)) for y in (2021, 2022) for i in range(40)]
    rows += [("q", "amazon", "S1", None, 1.0, d(2023, 5, 1)), ("n", "amazon", "S2", "late", 2.0, None)]  # drops that only one task has rows of
    df = spark.createDataFrame(rows, cols).repartition(4, "sku")
    src, target = st.scratch(spark, "src"), st.scratch(spark, "tgt")
    files = st.land_files(df, src, "scraped_date", by=F.year("scraped_date"))
    drops = st._folders(spark, src, "drop=")
    assert files == 4 and len(drops) == 4 and all(len(st._folders(spark, f"{src}/{n}", "part-")) == files for n in drops)
    v = st.stream_upsert(spark, src, df.schema, target, buckets=4, files=files)
    assert v.endswith("v=00000003")  # one version per drop
    got = {r.sku: (r.product_id, r.title, r.price, r.scraped_date) for r in st.read_version(spark, v, df.schema).collect()}
    assert len(got) == 40 and got["S1"] == ("p2021-1", "T2022", 1.0, d(2023, 5, 1)) and got["S2"] == ("p2021-2", "late", 2.0, None)
    assert got["S3"] == ("p2021-3", None, 2025.0, d(2022, 12, 1)) and got["S5"] == ("p2021-5", "T2022", 2027.0, d(2022, 12, 1))


def _attempts(spark, rows):
    return spark.createDataFrame(rows, "platform string, created_at timestamp_ntz")


def test_stream_cooldown_equals_batch(spark):
    t0, rng = dt.datetime(2024, 1, 1), random.Random(4)
    rows = [(rng.choice(["amazon", "croma", None]), t0 + dt.timedelta(minutes=rng.randrange(60 * 24 * 12))) for _ in range(900)]
    df = _attempts(spark, rows + rows[:50] + [("amazon", None)])
    src = st.scratch(spark, "cool")
    st.land_files(df, src, "created_at", 6)
    st.close_stream(spark, src, df.schema)
    got = sorted((r.platform, r.created_at) for r in st.stream_cooldown(spark, src, df.schema, 12).where("platform <> ''").collect())
    want = sorted((r.platform, r.created_at) for r in rk.cooldown(df).collect())
    assert got == want and len(want) > 30


def test_stream_cooldown_out_of_order_late_rows_and_restart(spark):
    t0 = dt.datetime(2024, 1, 1)
    h = lambda x: t0 + dt.timedelta(hours=x)
    src, ckpt, out = st.scratch(spark, "cool"), st.scratch(spark, "ckpt"), st.scratch(spark, "out")
    # arrival order of the files: 0, 30 / 13, 26 (out of order, within the delay) / 60 / 14 (too late)
    for rows in ([("amazon", h(0)), ("amazon", h(30))], [("amazon", h(13)), ("amazon", h(26))], [("amazon", h(60))], [("amazon", h(14))]):
        _attempts(spark, rows).coalesce(1).write.mode("append").parquet(src)
        got = sorted(r.created_at for r in st.stream_cooldown(spark, src, _attempts(spark, rows).schema, 12, watermark="20 hours", checkpoint=ckpt, target=out).collect())
    assert got == [h(0), h(13), h(26)]           # 30 is 4 h after 26; 60 is still open; 14 came after its hour was closed
    st.close_stream(spark, src, _attempts(spark, []).schema)
    args = dict(watermark="20 hours", checkpoint=ckpt, target=out)
    for _ in range(2):                            # a restart without new files changes nothing
        got = sorted(r.created_at for r in st.stream_cooldown(spark, src, _attempts(spark, []).schema, 12, **args).where("platform <> ''").collect())
        assert got == [h(0), h(13), h(26), h(60)]


def test_replayed_batches_change_nothing(spark):
    df = spark.createDataFrame([("amazon", dt.datetime(2024, 1, 1))], "platform string, created_at timestamp_ntz")
    out = st.scratch(spark, "sink")
    write = st._batch_sink(out)
    write(df, 0)
    write(df, 1)
    write(df, 1)                 # a replay of the last batch
    assert spark.read.parquet(out).count() == 2


def test_unfinished_versions_are_skipped_and_never_read_as_empty(spark):
    base = st.scratch(spark, "versions")
    assert st._current_version(spark, base) is None
    df = spark.range(3)
    df.write.parquet(f"{base}/v=00000000")
    df.write.option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").parquet(f"{base}/v=00000001")
    assert st._current_version(spark, base) == f"{base}/v=00000000"
    assert st._current_version(spark, base, before="v=00000000") is None


def test_lost_commit_marks_are_an_error(spark):
    base = st.scratch(spark, "versions")
    for v in range(2):
        spark.range(3).write.option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").parquet(f"{base}/v=0000000{v}")
    with pytest.raises(RuntimeError):
        st._current_version(spark, base)
    with pytest.raises(RuntimeError):
        st._current_version(spark, base, before="v=00000001")
