"""Findings of round 3: rows that entries read, and work that was done many times."""

import __spark_entry__ as entry


def test_currency_is_read_from_the_whole_text(spark, tmp_path):
    rows = [(7, "x" * 5000 + " costs € 5"), (14, "no symbol"), (8, "¥ first, then $"), (13, None)]
    spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'en' AS lang", "'s' AS source", "CAST(length(text) AS BIGINT) AS n_chars").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(7, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = {r.id: r.currency for r in entry.queries()["num10_currency_code"](spark, str(tmp_path)).collect()}
    assert got == {7: "EUR", 14: "INR", 8: "JPY", 13: None}
