"""One reading pass over a page: elements by CSS selector, whatever the nesting.

All selectors of a rule set are compiled into one automaton over their compounds.  The
page is tokenised once by the standard library's HTML parser; every element takes the
compounds that it fits (looked up by its tag, id, classes and attributes) and hands them
down, so a selector is matched where its last compound fits.  Text conditions and
``:last-child`` are known only later and are tested at the end, on the few elements left.

Supported: tag, ``#id``, ``.class``, ``[a]``, ``[a=v]`` and its ``* ^ $ ~`` forms, ``:not(...)``,
``:first-child``, ``:last-child``, ``:nth-child(n)``, ``:contains("text")``, the combinators
space, ``>``, ``+`` and ``~``, and groups with commas.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from dataclasses import dataclass, field
from html.parser import HTMLParser

# ---- fixed values: elements of HTML without content, and those whose end tag may be left out ----
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
# opening tag -> (what it ends, what that must not be sought beyond)
_TABLE, _LIST, _FLOW = ("table",), ("ul", "ol"), ("div", "td", "th", "li", "section", "article", "table", "ul", "ol", "button")
ENDED_BY = {"li": (("li",), _LIST), "p": (("p",), _FLOW), "tr": (("tr",), _TABLE), "td": (("td", "th"), ("table", "tr")), "th": (("td", "th"), ("table", "tr")),
            "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)), "option": (("option",), ("select",))}
RAW = frozenset(("script", "style"))
# ---- end of fixed values ----

_TOKEN = re.compile(r"""\s*([>+~,])\s*|(\s+)|([#.]?[A-Za-z0-9_\-]+|\*)|\[\s*([\w\-:]+)\s*(?:([*^$~]?=)\s*(?:"([^"]*)"|'([^']*)'|([^\]\s]+)))?\s*\]"""
                    r"""|:(not|nth-child|contains)\(\s*("[^"]*"|[^()]*)\s*\)|:(first-child|last-child)""")


@dataclass
class Element:
    tag: str
    attrs: dict[str, str]
    parent: Element | None
    number: int                     # in document order
    place: int                      # among the element children of its parent, from 1
    first: int                      # its text: chunks first .. last
    last: int = -1
    until: int = -1                 # the first element number after it
    fits: int = 0                   # compounds that it fits, bit by bit
    above: int = 0                  # compounds that it or an ancestor fits
    older: int = 0                  # compounds that an earlier sibling fits
    before: int = 0                 # compounds that the sibling just before it fits
    kids: int = 0
    kid_fits: int = 0
    kid_last: int = 0               # what its last element child fits; no reference, so that a page is freed as soon as it is read
    raw: list[str] = field(default_factory=list)


@dataclass
class Compound:
    tag: str | None = None
    ids: list[str] = field(default_factory=list)
    classes: list[str] = field(default_factory=list)
    attrs: list[tuple[str, str, str]] = field(default_factory=list)
    nots: list[Compound] = field(default_factory=list)
    place: int = 0
    last_child: bool = False
    contains: list[str] = field(default_factory=list)
    link: str = ""                  # how it follows the compound before it
    bit: int = 0

    def now(self, e: Element) -> bool:
        """What the opening tag tells."""
        if self.tag and self.tag != e.tag or self.place and self.place != e.place:
            return False
        if self.ids and any(e.attrs.get("id") != i for i in self.ids):
            return False
        if self.classes:
            have = e.attrs.get("class", "").split()
            if any(c not in have for c in self.classes):
                return False
        for name, op, value in self.attrs:
            have = e.attrs.get(name)
            if have is None or not _ATTR[op](have, value):
                return False
        return not any(n.now(e) for n in self.nots)

    def later(self, e: Element, page: Page) -> bool:
        """What only the whole page tells."""
        if self.last_child and e.parent is not None and e.parent.kids != e.place:
            return False
        return not self.contains or all(c in page.text(e) for c in self.contains)

    @property
    def waits(self) -> bool:
        return self.last_child or bool(self.contains)

    def keys(self) -> str:
        """The rarest thing to look it up by."""
        if self.ids:
            return "#" + self.ids[0]
        if self.classes:
            return "." + self.classes[0]
        if self.attrs:
            return "[" + self.attrs[0][0]
        return self.tag or "*"


_ATTR = {"": lambda a, b: True, "=": lambda a, b: a == b, "*=": lambda a, b: b in a, "^=": lambda a, b: a.startswith(b), "$=": lambda a, b: a.endswith(b),
         "~=": lambda a, b: b in a.split()}


def parse(selector: str) -> list[list[Compound]]:
    """The alternatives of a selector, each a chain of compounds."""
    groups, at = [[Compound()]], 0
    used = False
    text = selector.strip()
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m or m.end() == at:
            raise ValueError(f"selector not understood: {selector!r} at {at}")
        at = m.end()
        sign, gap, name, attr, op, v1, v2, v3, func, arg, child = m.groups()
        if sign == ",":
            if not used:
                raise ValueError(f"nothing before a comma: {selector!r}")
            groups.append([Compound()])
            used = False
            continue
        if sign or gap:
            if not used:
                raise ValueError(f"nothing before a combinator: {selector!r}")
            groups[-1].append(Compound(link=sign or " "))
            used = False
            continue
        c, used = groups[-1][-1], True
        if name:
            if name[0] == "#":
                c.ids.append(name[1:])
            elif name[0] == ".":
                c.classes.append(name[1:])
            elif name != "*":
                c.tag = name.lower()
        elif attr:
            c.attrs.append((attr.lower(), op or "", next((v for v in (v1, v2, v3) if v is not None), "")))
        elif func == "not":
            c.nots.append(parse(arg)[0][0])
        elif func == "nth-child":
            c.place = int(arg)
        elif func == "contains":
            c.contains.append(arg.strip("\"'"))
        elif child == "first-child":
            c.place = 1
        else:
            c.last_child = True
    if not used:
        raise ValueError(f"selector ends early: {selector!r}")
    for chain in groups:
        for a, b in zip(chain, chain[1:]):
            if b.link in "+~" and a.waits:
                raise ValueError(f"nothing that waits for the page's end before a sibling: {selector!r}")
    return groups


class Automaton:
    """Selectors by name, compiled together."""

    def __init__(self, selectors: list[str]):
        self.chains: dict[str, list[list[Compound]]] = {s: parse(s) for s in selectors}
        self.look_up: dict[str, list[Compound]] = {}
        bit = 1
        self.previous: dict[int, int] = {}
        self.ends: dict[int, list[str]] = {}
        for s, groups in self.chains.items():
            for chain in groups:
                before = 0
                for c in chain:
                    c.bit = bit
                    self.previous[bit] = before
                    self.look_up.setdefault(c.keys(), []).append(c)
                    before, bit = bit, bit << 1
                self.ends.setdefault(before, []).append(s)

    def enter(self, e: Element, hits: dict[str, list[Element]]) -> None:
        """Marks what ``e`` fits and records the selectors that end here."""
        found = [self.look_up.get(k) for k in ("*", e.tag, "#" + e.attrs.get("id", ""))]
        found += [self.look_up.get("." + c) for c in e.attrs.get("class", "").split()]
        found += [self.look_up.get("[" + a) for a in e.attrs]
        parent = e.parent
        for group in found:
            for c in group or ():
                if e.fits & c.bit:
                    continue
                if c.link:
                    before = self.previous[c.bit]
                    source = {" ": parent.above if parent else 0, ">": parent.fits if parent else 0, "~": e.older, "+": e.before}[c.link]
                    if not source & before:
                        continue
                if c.now(e):
                    e.fits |= c.bit
                    for s in self.ends.get(c.bit, ()):
                        if not hits.get(s) or hits[s][-1] is not e:
                            hits.setdefault(s, []).append(e)
        e.above = e.fits | (parent.above if parent else 0)


class Page(HTMLParser):
    """A page read once; ``find`` gives the elements of a selector in document order."""

    def __init__(self, html: str, automaton: Automaton):
        super().__init__(convert_charrefs=True)
        self.automaton, self.hits, self.chunks = automaton, {}, []
        self.count = 0
        self.root = Element("", {}, None, -1, 1, 0)
        self.open = [self.root]
        self.checked: dict[str, list[Element]] = {}
        self.feed(html)
        self.close()
        while self.open:
            self._leave()

    def _leave(self) -> None:
        e = self.open.pop()
        e.last, e.until = len(self.chunks), self.count

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        closes, within = ENDED_BY.get(tag, ((), ()))
        if closes:
            for i in range(len(self.open) - 1, 0, -1):
                if self.open[i].tag in closes:
                    while len(self.open) > i:
                        self._leave()
                    break
                if self.open[i].tag in within:
                    break
        parent = self.open[-1]
        parent.kids += 1
        held: dict[str, str] = {}
        for k, v in attrs:  # the first of a repeated attribute counts
            held.setdefault(k, v or "")
        e = Element(tag, held, parent, self.count, parent.kids, len(self.chunks))
        e.older, e.before = parent.kid_fits, parent.kid_last
        self.count += 1
        self.automaton.enter(e, self.hits)
        parent.kid_fits |= e.fits
        parent.kid_last = e.fits
        if tag in VOID:
            e.last, e.until = len(self.chunks), self.count
        else:
            self.open.append(e)

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        # browsers read <div/> as an opening tag
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].tag == tag:
                while len(self.open) > i:
                    self._leave()
                return

    def handle_data(self, data: str) -> None:
        top = self.open[-1]
        if top.tag in RAW:
            top.raw.append(data)
        else:
            self.chunks.append(data)

    def text(self, e: Element) -> str:
        """Text inside, white space collapsed; of a script, its content."""
        return "".join(e.raw) if e.tag in RAW else " ".join("".join(self.chunks[e.first:e.last]).split())

    def value(self, e: Element, attr: str | None) -> str:
        return self.text(e) if attr is None else " ".join(e.attrs.get(attr, "").split())

    def _holds(self, chain: list[Compound], k: int, e: Element | None) -> bool:
        """Whether ``e`` ends the first ``k + 1`` compounds with what was only known later."""
        if e is None or not e.fits & chain[k].bit or not chain[k].later(e, self):
            return False
        if k == 0:
            return True
        up = e.parent
        if chain[k].link in "+~":
            return True
        if chain[k].link == ">":
            return self._holds(chain, k - 1, up)
        while up is not None:
            if self._holds(chain, k - 1, up):
                return True
            up = up.parent
        return False

    def find(self, selector: str) -> list[Element]:
        if selector not in self.checked:
            found = self.hits.get(selector, [])
            groups = self.automaton.chains[selector]
            if any(c.waits for chain in groups for c in chain):
                found = [e for e in found if any(self._holds(chain, len(chain) - 1, e) for chain in groups)]
            self.checked[selector] = found
        return self.checked[selector]

    def inside(self, e: Element, selector: str) -> list[Element]:
        """The elements of ``selector`` within ``e`` (itself included)."""
        found = self.find(selector)
        a = bisect_left(found, e.number, key=lambda x: x.number)
        b = bisect_left(found, e.until, key=lambda x: x.number)
        return found[a:b]
