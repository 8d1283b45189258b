"""SRT1–SRT4: the order of the rows, against the same ORDER BY in DuckDB."""

import pytest

from shelfwise.plans.catalog import load_all
from shelfwise.plans.verify import norm

from conftest import SF_SMALL as SF


@pytest.mark.parametrize("name", ["srt01_order_by", "srt02_page", "srt03_sample_n", "srt04_keyword_list"])
def test_rows_come_in_order(spark, duck, name):
    fn, sql = load_all()[name]
    want = duck.execute(sql)
    cols = [d[0] for d in want.description]
    got = fn(spark, SF).select(*cols).collect()
    assert [tuple(map(norm, r)) for r in got] == [tuple(map(norm, r)) for r in want.fetchall()]


def test_runs_by_category_are_sorted(spark):
    rows = load_all()["srt05_runs_by_category"][0](spark, SF).collect()
    categories = [r["category"] for r in rows]
    sizes = [r["category_runs"] for r in rows]
    assert len(rows) > 0 and all(sizes[i] == categories.count(c) for i, c in list(enumerate(categories))[:50])
    # the rows of a category lie together
    assert sum(a != b for a, b in zip(categories, categories[1:])) == len(set(categories)) - 1
