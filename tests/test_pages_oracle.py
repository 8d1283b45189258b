"""The page extractors' DuckDB twins on the hand-written pages (positive cases).

The hand-written pages are stored as a small ``pages.parquet``; page ids are
chosen so that ``page_id % 8`` gives the intended platform.
"""

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as E
from shelfwise.plans.verify import compare

from test_pages import AMAZON_PRODUCT, BLINKIT_CARDS, CROMA_JSONLD, FLIPKART_COUNTS, RD_SWAP, REVIEWS_PAGE, SEARCH_PAGE

PAGES = [
    (8, "https://www.amazon.in/Dell/dp/B0TESTTEST/ref=x", AMAZON_PRODUCT),
    (9, "https://www.flipkart.com/redmi/p/itm123", FLIPKART_COUNTS),
    (11, "https://www.reliancedigital.in/lg-tv/p/49123", RD_SWAP),
    (12, "https://www.croma.com/samsung-s24/p/300123", CROMA_JSONLD),
    (13, "https://blinkit.com/cn/milk", BLINKIT_CARDS),
    (16, "https://www.amazon.in/s?k=laptop", SEARCH_PAGE),
    (24, "https://www.amazon.in/product-reviews/B0TEST", REVIEWS_PAGE),
]
PAGE_ONLY = ["pag01", "pag02", "pag03", "pag04", "pag07", "pag14", "pag08", "pag09", "pag10", "pag11", "pag12", "pag13", "pag16", "pag17", "pag20", "pag22", "pag23", "pag24",
             "pag25", "pag26"]
ORACLE = E.oracle_sql()
QUERIES = E.queries()
NAMES = sorted(n for n in ORACLE if n.split("_")[0] in PAGE_ONLY)


@pytest.fixture(scope="module")
def fixture_dir(tmp_path_factory):
    d = tmp_path_factory.mktemp("pages")
    pd.DataFrame(PAGES, columns=["page_id", "url", "html"]).astype({"page_id": "int64"}) \
        .to_parquet(d / "pages.parquet", index=False)
    return str(d)


@pytest.mark.parametrize("name", NAMES)
def test_page_twin_on_fixture_pages(spark, fixture_dir, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{fixture_dir}/pages.parquet')")
    problems = compare(QUERIES[name](spark, fixture_dir), ORACLE[name], con)
    assert not problems, problems


def test_fixture_pages_exercise_the_rules(spark, fixture_dir):
    got = {r.page_id: r for r in QUERIES["pag23_star_rating"](spark, fixture_dir).collect()}
    assert got[24].rating == 4.0
    links = QUERIES["pag12_image_urls"](spark, fixture_dir).collect()
    assert any(r.image_urls and "m.media-amazon.com/a.jpg" in r.image_urls for r in links)
