"""Operator properties on hand-made rows: buckets, bands, positions, cool-down, upserts, run comparison."""

import datetime as dt

from pyspark.sql import functions as F

from shelfwise.operators import compare as cp
from shelfwise.operators import filters as fl
from shelfwise.operators import ranking as rk
from shelfwise.operators import stats
from shelfwise.operators import upsert as up


def test_price_buckets_overlap(spark):
    df = spark.createDataFrame([(p, True) for p in (29999.0, 30000.0, 50000.0, 80000.0, 120000.0, 150000.0)] +
                               [(None, True), (10.0, False)], "price double, is_active boolean")
    r = stats.price_buckets(df).first()
    assert (r.under_30k, r.from_30k_to_50k, r.from_50k_to_80k, r.from_80k_to_120k, r.over_120k) == (1, 2, 2, 2, 1)


def test_sentiment_gaps(spark):
    df = spark.createDataFrame([(x,) for x in (2.0, 2.05, 2.5, 3.95, 4.0)], "rating double")
    get = lambda b: sorted(r[0] for r in fl.sentiment_filter(df, b).collect())
    assert get("critical") == [2.0] and get("neutral") == [2.5] and get("positive") == [4.0]


def test_cooldown_is_greedy(spark):
    t0 = dt.datetime(2024, 1, 1)
    times = [t0, t0 + dt.timedelta(hours=11, minutes=59), t0 + dt.timedelta(hours=23, minutes=58),
             t0 + dt.timedelta(hours=36), t0 + dt.timedelta(days=5)]
    df = spark.createDataFrame([("amazon", t) for t in times], "platform string, created_at timestamp_ntz")
    got = sorted(r.created_at for r in rk.cooldown(df).collect())
    # 11:59 after t0 is refused; 23:58 is accepted (a plain lag would refuse it); 36:00 is 12:02 later
    assert got == [t0, t0 + dt.timedelta(hours=23, minutes=58), t0 + dt.timedelta(hours=36), t0 + dt.timedelta(days=5)]


def _brute_cooldown(ts, hours=12):
    out, last = [], None
    for t in sorted(ts):
        if last is None or (t - last) >= dt.timedelta(hours=hours):
            out.append(t)
            last = t
    return out


def test_cooldown_matches_brute_force(spark):
    import random
    rnd = random.Random(7)
    t0 = dt.datetime(2024, 1, 1)
    rows = [("p%d" % (i % 3), t0 + dt.timedelta(minutes=rnd.randint(0, 60 * 24 * 20))) for i in range(400)]
    df = spark.createDataFrame(rows, "platform string, created_at timestamp_ntz")
    got = {(r.platform, r.created_at) for r in rk.cooldown(df).collect()}
    want = {(p, t) for p in ("p0", "p1", "p2") for t in _brute_cooldown([t for q, t in rows if q == p])}
    assert got == want


def test_cooldown_of_minute_spaced_months(spark):
    t0 = dt.datetime(2024, 1, 1)
    rows = [("dense", t0 + dt.timedelta(minutes=7 * i)) for i in range(24_000)] + [("gaps", t0 + dt.timedelta(hours=h)) for h in (0, 12, 13, 24, 100, 111, 112)]
    rows += [("dense", t0)] * 3 + [(None, t0), ("gaps", None)]
    df = spark.createDataFrame(rows, "platform string, created_at timestamp_ntz")
    got = sorted((r.platform, r.created_at) for r in rk.cooldown(df).collect())
    assert got == [(p, t) for p in ("dense", "gaps") for t in _brute_cooldown({t for q, t in rows if q == p and t})]
    assert rk.cooldown(df.limit(0)).collect() == []


def test_organic_positions_gap_free(spark):
    rows = []
    for kw in (1, 2):
        for page in (1, 2, 3):
            for k in range(5):
                rows.append((kw * 100 + page * 10 + k, kw, page, dt.datetime(2024, 1, page, 0, k), k == 2))
    df = spark.createDataFrame(rows, "item_id long, keyword_id long, page int, created_at timestamp_ntz, is_sponsored boolean")
    pos = rk.organic_position(df)
    for kw in (1, 2):
        got = sorted((r.page, r.created_at, r.position) for r in pos.where(F.col("keyword_id") == kw).collect())
        assert [g[2] for g in got] == list(range(1, 13))


def test_slot_positions(spark):
    rows = [(i, 1, p, dt.datetime(2024, 1, 1, 0, i), i in (1, 5), "S%d" % i) for p in (1, 2) for i in range(3)]
    df = spark.createDataFrame(rows, "item_id long, keyword_id long, page int, created_at timestamp_ntz, is_sponsored boolean, sku string")
    slot = sorted((r.page, r.position) for r in rk.slot_position(df, 24).collect())
    assert slot == [(1, 1), (1, 3), (2, 25), (2, 27)]
    organic = sorted((r.page, r.position) for r in rk.organic_slot_position(df, 24).collect())
    assert organic == [(1, 1), (1, 2), (2, 25), (2, 26)]
    kept = sorted((r.page, r.position) for r in rk.kept_base_position(df).collect())
    assert kept == [(1, 1), (1, 3), (2, 3), (2, 5)]


def test_page_cutoff_stops_at_empty_streak(spark):
    df = spark.createDataFrame([(1, p, n) for p, n in [(1, 5), (2, 0), (3, 4), (4, 0), (5, 0), (6, 7)]],
                               "k int, page int, n int")
    kept = sorted(r.page for r in rk.page_cutoff(df, "k", 2, F.col("n") > 0).collect())
    assert kept == [1, 2, 3]
    first_empty = sorted(r.page for r in rk.page_cutoff(df, "k", 1, F.col("n") > 0).collect())
    assert first_empty == [1]


def _products(spark, rows):
    return spark.createDataFrame(rows, "product_id string, platform string, sku string, title string, price double, "
                                       "scraped_date date")


def test_upsert_actions_and_idempotence(spark):
    d0, d1 = dt.date(2024, 1, 1), dt.date(2024, 1, 2)
    cur = _products(spark, [("a", "amazon", "S1", "T1", 10.0, d0), ("b", "amazon", "S2", "T2", 20.0, d0),
                            ("c", "amazon", "S3", "T3", 30.0, d0)])
    inc = _products(spark, [("x", "amazon", "S1", "T1", 10.0, d1), ("y", "amazon", "S2", "T2", 25.0, d1),
                            ("z", "amazon", "S4", "T4", 40.0, d1), ("w", "amazon", "S3", None, None, d1)])
    out = {r.sku: r for r in up.upsert_products(cur, inc, d1).collect()}
    assert {k: v.action for k, v in out.items()} == {"S1": "touched", "S2": "updated", "S3": "touched", "S4": "created"}
    assert out["S2"].price == 25.0 and out["S2"].product_id == "b" and out["S2"].scraped_date == d1
    assert out["S3"].title == "T3" and out["S3"].price == 30.0
    merged = up.upsert_products(cur, inc, d1).drop("action")
    again = up.upsert_products(merged, inc, d1)
    assert {r.action for r in again.collect()} == {"touched"}
    counts = {r.platform: r for r in up.ingest_counters(up.upsert_products(cur, inc, d1)).collect()}
    assert (counts["amazon"].products_added, counts["amazon"].products_updated) == (1, 1)


def test_compare_keeps_left_duplicates(spark):
    rows = [("p%d" % i, "amazon", s, "t", float(i), dt.date(2024, 1, 1), r)
            for i, (s, r) in enumerate([("A", "r1"), ("A", "r1"), ("B", "r1"), ("C", "r1"), ("A", "r2"), ("D", "r2")])]
    df = spark.createDataFrame(rows, "product_id string, platform string, sku string, title string, price double, "
                                     "scraped_date date, scraper_id string")
    r = cp.compare_skus(df, "r1", "r2").first()
    assert (r.total_run1, r.total_run2, r.common, r.only_in_run1, r.only_in_run2) == (4, 2, 2, 2, 1)
    assert r.common + r.only_in_run1 == r.total_run1
    ch = cp.price_changes(df, "r1", "r2").collect()
    assert [(c.sku, c.difference) for c in ch] == [("A", 4.0), ("A", 4.0)]


def test_validate_products_reasons(spark):
    df = spark.createDataFrame([("S1", "T", "amazon", 5000.0), ("0", "T", "amazon", 100.0), ("S3", "", None, None)],
                               "sku string, title string, platform string, price double")
    good, bad = fl.validate_products(df)
    assert [(r.sku, r.warning) for r in good.collect()] == [("S1", None)]
    reasons = {r.sku: r.reject_reasons for r in bad.collect()}
    assert reasons == {"0": ["missing sku"], "S3": ["missing title", "missing platform"]}


def test_cooldown_with_tied_timestamps(spark):
    t0 = dt.datetime(2024, 1, 1)
    rows = [("amazon", t0 + dt.timedelta(days=d)) for d in range(30) for _ in range(7)]
    df = spark.createDataFrame(rows, "platform string, created_at timestamp_ntz").repartition(5)
    got = sorted(r.created_at for r in rk.cooldown(df).collect())
    assert got == [t0 + dt.timedelta(days=d) for d in range(30)]


def test_upsert_lookback_keeps_history(spark):
    import datetime as dt

    from shelfwise.operators import upsert as up
    cols = "product_id string, platform string, sku string, title string, scraped_date date"
    d = dt.date
    cur = spark.createDataFrame([("p1", "amazon", "A", "old", d(2024, 1, 1)), ("p2", "amazon", "A", "new", d(2024, 1, 9)),
                                 ("p3", "croma", "B", "far", d(2023, 1, 1)), ("p4", "croma", "C", "none", None)], cols)
    inc = spark.createDataFrame([("q1", "amazon", "A", "newer", d(2024, 1, 10)), ("q2", "croma", "B", "far", d(2024, 1, 10)),
                                 ("q3", "croma", "C", "none", d(2024, 1, 10))], cols)
    got = sorted((r.product_id, r.title, r.action) for r in up.upsert_products(cur, inc, d(2024, 1, 10), 2).collect())
    assert got == [("p1", "old", "unchanged"), ("p2", "newer", "updated"), ("p3", "far", "unchanged"),
                   ("p4", "none", "touched"), ("q2", "far", "created")]
