"""A read page leaves nothing behind, and its values are handed on in small slices."""

import gc
import weakref

import pandas as pd

from shelfwise.functions.selectors import Automaton, Page
from shelfwise.operators import page_reader as rd


def test_a_page_is_freed_without_the_cycle_collector():
    gc.collect()
    gc.disable()
    try:
        page = Page("<ul><li>a<li class='x'>b</ul><p>c</p>", Automaton(["li:last-child", "li + li", "ul > .x"]))
        assert [page.text(e) for e in page.find("li:last-child")] == ["b"] == [page.text(e) for e in page.find("li + li")]
        element = weakref.ref(page.find("ul > .x")[0])
        del page
        assert element() is None
    finally:
        gc.enable()


def test_pages_are_read_in_slices(spark, monkeypatch):
    monkeypatch.setattr(rd, "SLICE", 3)
    df = spark.createDataFrame(pd.DataFrame({"html": [f"<h1>Item {i} of all</h1>" for i in range(10)], "platform": ["croma"] * 10, "i": range(10)}))
    out = rd.with_page(df.coalesce(1), "fields").select("i", rd.value("title").alias("t")).collect()
    assert {r.i: r.t for r in out} == {i: f"Item {i} of all" for i in range(10)}
    held = rd.read_in_slices(iter([(df.toPandas()["html"], df.toPandas()["platform"])]), ("fields",))
    assert [len(x) for x in held] == [3, 3, 3, 1]
