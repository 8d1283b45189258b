"""The selector automaton against definitions, on small pages."""

import pytest

from shelfwise.functions.selectors import Automaton, Page, parse
from shelfwise.operators import page_reader as rd
from shelfwise.operators import page_rules as pr

HTML = """<div id="a" class="x y"><p>One <b class="k">two</b> three<p class="k">Four</p><ul><li>L1<li class="k">L2 <i>in</i><li>L3</ul></div>
<div class="x" style="text-decoration: line-through">Last <span data-v>Color: red</span><br><span>stock</span></div><table><tr><th>H<td>C1<td>C2<tr><td>D</table>"""
CASES = {
    "div": ["One two threeFourL1L2 inL3", "Last Color: redstock"], "#a": ["One two threeFourL1L2 inL3"], ".x.y": ["One two threeFourL1L2 inL3"], ".k": ["two", "Four", "L2 in"],
    "div .k": ["two", "Four", "L2 in"], "div > .k": ["Four"], "p > b": ["two"], "ul > li.k > i": ["in"], "li + li": ["L2 in", "L3"], "li ~ li": ["L2 in", "L3"], "p ~ ul li:first-child": ["L1"],
    "li:last-child": ["L3"], "li:nth-child(2)": ["L2 in"], "li:not(.k)": ["L1", "L3"], 'span:contains("Color")': ["Color: red"], "[data-v]": ["Color: red"],
    '[style*="line-through"]': ["Last Color: redstock"], '[class^="x"][class$="y"]': ["One two threeFourL1L2 inL3"], '[class~="y"] p': ["One two three", "Four"], "th ~ td, tr td:first-child": ["C1", "C2", "D"],
    "td, th": ["H", "C1", "C2", "D"], "tr:contains(\"C1\") td": ["C1", "C2"], "div:contains('Last') > span": ["Color: red", "stock"], "*.k": ["two", "Four", "L2 in"], "nothing": [],
}


def test_selectors_by_definition():
    page = Page(HTML, Automaton(list(CASES)))
    assert {s: [page.text(e) for e in page.find(s)] for s in CASES} == CASES


def test_inside_an_element():
    a = Automaton(["div", ".k", "span"])
    page = Page(HTML, a)
    first, second = page.find("div")
    assert [page.text(e) for e in page.inside(first, ".k")] == ["two", "Four", "L2 in"] and page.inside(second, ".k") == []
    assert page.inside(first, "div") == [first] and len(page.inside(second, "span")) == 2


@pytest.mark.parametrize("html", ["", "<", "<div", "</p></div>", "<!-- x", "<p" + ">" * 50, "<script>a<b", "&lt;p&gt;", "<a <b>", "<div/><div/>", "\x00<p>\x01", "<p a=1 a=2>x"])
def test_broken_markup_is_read(html):
    page = Page(html, Automaton(["p", "div", "a"]))
    assert all(page.find(s) is not None for s in ("p", "div", "a")) and len(page.open) == 0


def test_scripts_are_not_text():
    page = Page('<div>a<script>var x = "<p>no</p>";</script><style>b{}</style>c</div>', Automaton(["div", "p", "script"]))
    assert [page.text(e) for e in page.find("div")] == ["ac"] and page.find("p") == [] and page.text(page.find("script")[0]).startswith("var x")


@pytest.mark.parametrize("bad", ["", "a >", "> a", "a,,b", "a:hover", "li:last-child + li", "a[=x]"])
def test_what_is_not_understood_is_refused(bad):
    with pytest.raises(ValueError):
        parse(bad)


def test_every_rule_compiles():
    for platform in [*pr.FIELDS, None]:
        fields, *_, automaton = rd._plan(platform, tuple(rd.PARTS))
        assert fields and automaton.chains
