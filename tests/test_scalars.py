"""Scalar functions on hand-made edge rows (nulls, '0', tags, rupee prices, URLs, dates)."""

import datetime as dt
import hashlib

import pytest
from pyspark.sql import functions as F

from shelfwise.functions import arrays as ar
from shelfwise.functions import dates as da
from shelfwise.functions import hashing as hs
from shelfwise.functions import numbers as nm
from shelfwise.functions import text as tx
from shelfwise.functions import urls as ul


def one(spark, values, fn, dtype="string"):
    df = spark.createDataFrame([(v,) for v in values], f"v {dtype}")
    return [r[0] for r in df.select(fn(F.col("v"))).collect()]


def test_sanitize_string(spark):
    vals = [None, "", "0", "   ", "<b>Hello <i>World</i></b>", "Dell™ XPS 13!", "Café 東京", "😀 phone"]
    assert one(spark, vals, tx.sanitize_string) == [
        None, None, None, None, "Hello World", "Dell XPS 13", "Café 東京", " phone"]


def test_sanitize_string_sql_form_agrees(spark):
    vals = ["<p>a  b</p>", "0", "x&y/z (1)", None, "é😀"]
    df = spark.createDataFrame([(v,) for v in vals], "v string")
    got = df.select(tx.sanitize_string("v").alias("a"), F.expr(tx.sanitize_string_sql("v")).alias("b")).collect()
    assert all(r.a == r.b for r in got)


def test_sanitize_text_and_clean(spark):
    assert one(spark, ["<p>a</p>\n\n  b ", "0", None], tx.sanitize_text) == ["a b", None, None]
    assert one(spark, ["  <div>x</div> y  "], tx.clean_text) == ["x y"]


def test_byte_cut_drops_split_character(spark):
    assert one(spark, ["ab€cd"], lambda c: tx.sanitize_text(c, 3)) == ["ab"]


def test_normalize_brand_and_slug(spark):
    assert one(spark, ["hp", "samsung", "xiaomi", "oNePlus", None], tx.normalize_brand) == [
        "HP", "Samsung", "Xiaomi", "ONePlus", None]
    assert one(spark, ["Hello, World! 2024", "--x--"], tx.slug) == ["hello-world-2024", "x"]


def test_small_text_helpers(spark):
    assert one(spark, ["Fulfilled by Amazon Retail"], lambda c: tx.strip_label(c, "Fulfilled by")) == ["Amazon Retail"]
    assert one(spark, ["Samsung 55 inch TV", "Apple iPhone"], tx.brand_from_title) == ["Samsung", "Apple iPhone"]
    assert one(spark, ["Screen Size"], tx.spec_key) == ["screen_size"]


def test_prices(spark):
    vals = ["₹1,29,999.00", "1.234.56", "₹1,999", "₹2,000", "", None, "abc", "₹17,00,000"]
    assert one(spark, vals, nm.sanitize_price) == [129999.0, None, None, 2000.0, None, None, None, None]
    # the dot of "Rs." survives the character filter: ".500" is numeric, as in the reference
    assert one(spark, ["₹1,29,999.00", "1.234.56", "Rs. 500"], nm.extract_price) == [129999.0, None, 0.5]
    assert one(spark, ["₹1,29,999.00"], nm.numeric_price) == [129999]
    df = spark.createDataFrame([(v,) for v in vals], "v string")
    a = df.select(nm.sanitize_price("v")).collect()
    b = df.select(F.expr(nm.sanitize_price_sql("v"))).collect()
    assert [r[0] for r in a] == [r[0] for r in b]


def test_rating_and_counts(spark):
    assert one(spark, ["4.5 out of 5 stars", "5.1", "rated 3", None], nm.rating) == [4.5, None, 3.0, None]
    assert one(spark, ["1,234 ratings", None, "none"], nm.review_count) == [1234, 0, 0]
    assert one(spark, ["1,234 ratings (5 new)", None], nm.digits) == [12345, 0]


def test_price_arithmetic(spark):
    df = spark.createDataFrame([(0.0, 100.0), (1000.0, 800.0), (1000.0, 1200.0), (None, 5.0)], "price double, sale_price double")
    assert [r[0] for r in df.select(nm.discount_pct()).collect()] == [None, 20.0, None, None]
    assert [r[0] for r in df.select(nm.effective_price()).collect()] == [100.0, 800.0, 1200.0, 5.0]
    runs = spark.createDataFrame([(0, 0, 0, 0), (10, 5, 5, 2), (1, 0, 0, 3)],
                                 "products_scraped int, reviews_scraped int, rankings_scraped int, errors_count int")
    assert [r[0] for r in runs.select(nm.run_success_pct()).collect()] == [0.0, 90.0, -200.0]


def test_repair_prices(spark):
    df = spark.createDataFrame([(None, 500.0, "amazon"), (None, 500.0, "meesho"), (400.0, 500.0, "reliancedigital"),
                                (400.0, 500.0, "croma")], "price double, sale_price double, platform string")
    p, s = nm.repair_prices()
    assert [tuple(r) for r in df.select(p, s).collect()] == [
        (500.0, 500.0), (500.0, None), (500.0, 400.0), (400.0, 500.0)]


def test_currency(spark):
    assert one(spark, ["₹", " $ ", "CHF"], nm.currency_code) == ["INR", "USD", "CHF"]


def test_urls(spark):
    vals = ["www.amazon.in/dp/X", " https://a.com/x ", "http://a b.com", "", None]
    assert one(spark, vals, ul.sanitize_url) == ["https://www.amazon.in/dp/X", "https://a.com/x", None, None, None]
    df = spark.createDataFrame([(v,) for v in vals], "v string")
    assert [r[0] for r in df.select(F.expr(ul.sanitize_url_sql("v"))).collect()] == \
        [r[0] for r in df.select(ul.sanitize_url("v")).collect()]
    assert one(spark, ["/p/1", "https://x.com/p/2"], lambda c: ul.absolutize(c, "https://h.in")) == [
        "https://h.in/p/1", "https://x.com/p/2"]
    assert one(spark, ["https://x.com/a?b=1"], ul.strip_query) == ["https://x.com/a"]
    base = spark.createDataFrame([("https://x.com/c", 1), ("https://x.com/c?q=1", 3)], "u string, n int")
    assert [r[0] for r in base.select(ul.page_url("u", "n")).collect()] == ["https://x.com/c", "https://x.com/c?q=1&page=3"]


def test_sku_from_url(spark):
    df = spark.createDataFrame([
        ("https://www.amazon.in/Some/dp/B0ABCDEFGH/ref=x", "amazon"),
        ("https://www.flipkart.com/x/p/itmabc123?pid=MOBXYZ", "flipkart"),
        ("https://www.croma.com/p?productId=123", "croma"),
        ("https://www.croma.com/nothing", "croma")], "u string, p string")
    assert [r[0] for r in df.select(ul.sku_from_url("u", "p")).collect()] == ["B0ABCDEFGH", "itmabc123", "123", None]


def test_durations(spark):
    assert one(spark, [3725, 125, 0, None], lambda c: da.duration_label(c, "clock"), "int") == [
        "01:02:05", "02:05", "N/A", "N/A"]
    assert one(spark, [3725, 125, 5], lambda c: da.duration_label(c, "units"), "int") == ["1h 2m 5s", "2m 5s", "5s"]


def test_review_dates(spark):
    asof = dt.date(2024, 2, 1)
    vals = ["Reviewed in India on 15 January 2024", "15/01/2024", "3 days ago", "2 months ago", "Jun, 2023", "soon"]
    assert one(spark, vals, lambda c: da.review_date(c, asof)) == [
        dt.date(2024, 1, 15), dt.date(2024, 1, 15), dt.date(2024, 1, 29), dt.date(2023, 12, 1), dt.date(2023, 6, 1), None]
    assert one(spark, ["15 January 2024", "January 15, 2024", "2024-01-15", "x"], da.release_date) == [
        dt.date(2024, 1, 15)] * 3 + [None]


def test_hashes(spark):
    text = "a" * 49 + "é tail"
    df = spark.createDataFrame([("P1", "Ann", "4.00", text)], "pid string, name string, rating string, text string")
    got = df.select(hs.review_hash("pid", "name", "rating", "text")).first()[0]
    want = hashlib.md5(b"P1Ann4.00" + text.encode("utf-8")[:50]).hexdigest()
    assert got == want
    assert one(spark, ["hello"], lambda c: hs.content_id(c, "FK_", 16)) == [
        "FK_" + hashlib.md5(b"hello").hexdigest()[:16]]
    ids = spark.createDataFrame([("John Doe", None)], "n string, d date").select(
        hs.reviewer_id("n", "d", dt.date(2024, 2, 1))).first()[0]
    assert ids == "FD_john-doe_20240201"
    assert one(spark, ["8 GB RAM, 128GB", "none"], hs.specs_from_text) == ["8GB", None]


def test_arrays(spark):
    df = spark.createDataFrame([(["a", "b", "a", "c"],)], "a array<string>")
    assert df.select(ar.first_distinct("a", 2)).first()[0] == ["a", "b"]
    assert df.select(ar.join_list("a", "amazon")).first()[0] == "a; b; a; c"
    assert df.select(ar.primary_image("a")).first()[0] == "a"
    urls = spark.createDataFrame([(["www.x.com/1.jpg", "bad url", None],)], "a array<string>")
    assert urls.select(ar.sanitize_urls("a")).first()[0] == ["https://www.x.com/1.jpg"]
    m = spark.createDataFrame([('{"Colour": "<b>Black</b>", "Empty": ""}',), ("a; b|c",), ("",)], "t string")
    got = [r[0] for r in m.select(ar.sanitize_array("t")).collect()]
    assert got[0] == {"Colour": "Black"}
    assert got[1] == {"0": "a", "1": "b", "2": "c"}
    assert got[2] is None


def test_sanitize_array_later_duplicate_key_wins(spark):
    df = spark.createDataFrame([('{"a!": "1", "a": "2", "b": "<i>x</i>"}',)], "t string")
    assert df.select(ar.sanitize_array("t")).first()[0] == {"a": "2", "b": "x"}


def test_sanitize_nested_values(spark):
    from shelfwise.functions import arrays as ar
    rows = [('{"a":{"b":["x","",{"c":"<p> y </p>"}]},"A*":1,"A":2,"z":{"q":[]}}', '{"a":{"b":{"0":"x","2":{"c":"y"}}},"A":"2"}'),
            ('["one","two"]', '["one","two"]'), ("red; green|blue", '["red","green","blue"]'), ('"just text"', None), ("5", None), ("{}", None), ("", None), (None, None),
            ('{"n":1.50,"t":true,"f":false,"zero":0}', '{"n":"1.5","t":"1"}'), ('{"***":"v"}', '{"***":"v"}')]
    df = spark.createDataFrame(rows, "t string, want string")
    got = df.select("t", "want", ar.sanitize_nested("t").alias("got")).collect()
    assert [(r.t, r.got) for r in got] == rows
