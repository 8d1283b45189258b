"""Specification rows of a page: found once, the last of equal labels counts."""

import pytest
from pyspark.sql import functions as F

from shelfwise.functions import arrays as ar
from shelfwise.operators import pages as pg


@pytest.mark.parametrize("of", ["spec_map", "named", "dimensions", "sanitize_array"])
def test_a_page_is_searched_once_for_its_specifications(spark, of):
    df = spark.createDataFrame([("<tr><td>Brand</td><td>A</td></tr>", "amazon")], "html string, platform string")
    col = {"spec_map": lambda: pg.spec_map("html"), "named": lambda: pg.named_attrs(pg.spec_map("html"), {"a": "^a", "b": "^b"}),
           "dimensions": lambda: pg.dimensions(pg.spec_map("html"), "platform"), "sanitize_array": lambda: ar.sanitize_array("html")}[of]()
    plan = df.select(col.alias("c"))._jdf.queryExecution().optimizedPlan().toString()
    search = "from_json" if of == "sanitize_array" else "regexp_extract_all"
    assert plan.lower().count(search) <= (2 if of == "sanitize_array" else 1), plan


def test_the_last_of_equal_labels_counts(spark):
    html = "".join(f"<tr><th>{k}</th><td>{v}</td></tr>" for k, v in (("Brand", "old"), ("Width", "3"), ("Brand", "new"), ("Height", ""), ("Length", "9"), ("Brand", "")))
    r = spark.createDataFrame([(html,)], "html string").select(
        pg.spec_map("html").alias("m"), pg.named_attrs(pg.spec_map("html"), {"brand": "^brand", "none": "^zzz"}).alias("a"),
        pg.dimensions(pg.spec_map("html"), F.lit("amazon")).alias("d"), pg.dimensions(pg.spec_map("html"), F.lit("flipkart")).alias("e")).first()
    assert r.m == {"Width": "3", "Brand": "new", "Length": "9"}
    assert (r.a.brand, r.a.none, r.d, r.e) == ("new", None, "9 x 3", "3")
