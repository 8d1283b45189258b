"""WIN10 without sorting whole rows: thin columns find the first rows, ties and nulls as before."""

import re

from shelfwise.operators import ranking as rk


def test_first_per_sku_compares_whole_rows_of_the_least_ids_only(spark):
    rows = [("p2", "S1", "b"), ("p1", "S1", "a"), ("p1", "S1", "a"), ("p9", "S2", "z"), (None, "S3", "n"), ("p5", "S3", "m"), ("p7", None, "x"), ("p6", None, "w")]
    df = spark.createDataFrame(rows, "product_id string, sku string, title string")
    out = rk.first_per_sku(df)
    assert out.columns == ["sku", "product_id", "title"]
    assert sorted(map(tuple, out.collect()), key=str) == sorted([("S1", "p1", "a"), ("S2", "p9", "z"), ("S3", None, "n"), (None, "p6", "w")], key=str)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftSemi" in plan and not re.search(r"min\(struct\(product_id[^)]*title", plan)
