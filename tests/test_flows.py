"""End-to-end flows on hand-written pages."""

import datetime as dt

from pyspark.sql import functions as F

from shelfwise.plans import flows
from shelfwise.streaming.jobs import scratch

from test_pages import AMAZON_PRODUCT, CROMA_JSONLD, SEARCH_PAGE, pages_df


def test_ingest_twice_creates_then_touches(spark):
    pages = pages_df(spark, [(1, "https://www.amazon.in/Dell/dp/B0TESTTEST/ref=x", AMAZON_PRODUCT, "amazon"),
                             (2, "https://www.croma.com/samsung-s24/p/300123", CROMA_JSONLD, "croma")])
    target = scratch(spark, "products")
    p1, counters, rejected = flows.ingest(spark, pages, None, dt.date(2024, 1, 1), target, "0001")
    assert {r.platform: r.products_added for r in counters.collect()} == {"amazon": 1, "croma": 1}
    assert rejected.count() == 0
    p2, counters2, _ = flows.ingest(spark, pages, spark.read.parquet(p1), dt.date(2024, 1, 2), target, "0002")
    c2 = {r.platform: (r.products_added, r.products_updated, r.products_touched) for r in counters2.collect()}
    assert c2 == {"amazon": (0, 0, 1), "croma": (0, 0, 1)}
    assert {r.scraped_date for r in spark.read.parquet(p2).collect()} == {dt.date(2024, 1, 2)}


def test_rankings_flow_numbers_by_platform(spark):
    pages = pages_df(spark, [(5, "https://www.amazon.in/s?k=laptop", SEARCH_PAGE, "amazon")])
    kw = spark.createDataFrame([(5, 42, 1)], "page_id long, keyword_id long, page int")
    products = spark.createDataFrame([("P1", "amazon", "B000000003", dt.date(2024, 1, 1))],
                                     "product_id string, platform string, sku string, scraped_date date")
    rows = {r.sku: r for r in flows.rankings(pages, products, kw, dt.datetime(2024, 5, 1)).collect()}
    assert {s: r.position for s, r in rows.items()} == {"B000000001": 1, "B000000003": 2, "B000000005": 3}
    assert rows["B000000003"].product_id == "P1" and rows["B000000001"].product_id is None
