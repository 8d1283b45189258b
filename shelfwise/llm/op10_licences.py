"""Licence scans by sentence-rule recognition.

A text is cut into sentences, each is normalised, and known licence sentences are given
identifiers from a table: templates of plain words, found by their first three words and
then compared word by word, with gaps where a template has them.  The sequence of
identifiers is matched against an ordered list of rules, most specific first; the sentences
of a match are consumed, so a full licence text is one finding and its sentences do not also
count for a shorter notice.  Known sentences that no rule takes are reported as
``partial:<identifier>``.

A sentence that is denied ("not licensed under ...") has no identifier.  SPDX tags are read
as expressions and reported as written, operators in capitals.  Where two templates begin at
the same word the longer one counts.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import product

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Unknown sentences that may stand between two sentences of one rule.
GAP = 3

# ---- fixed values: licence sentences and their identifiers ----
# Templates over normalised text (lower case, s for c in "licence", words and version
# numbers between single spaces): [a|b] is a choice, {n} a gap of up to n words.
_UNDER = "[licensed|released|distributed|available|made available|covered|published] under the [terms of the |terms and conditions of the |]"
_FREE = "[program|library|software|file|package] is free software you can redistribute it and or modify it under the terms of [the |]gnu "
_CC = "[licensed|released|available|distributed|published] under [a |the |][creative commons |cc ]"
_NC, _SA, _ND = "[noncommercial|non commercial|nc]", "[sharealike|share alike|sa]", "[noderivatives|no derivatives|noderivs|no derivs|nd]"
SENTENCES: dict[str, list[str]] = {
    "gpl3-notice": [_UNDER + "gnu [general public license|gpl] [version |v |v|]3[.0|]", _UNDER + "gpl[ |][version |v |v|]3[.0|]"],
    "gpl2-notice": [_UNDER + "gnu [general public license|gpl] [version |v |v|]2[.0|]", _UNDER + "gpl[ |][version |v |v|]2[.0|]"],
    "lgpl-notice": [_UNDER + "gnu [lesser|library] general public license", _UNDER + "[gnu |]lgpl"],
    "agpl-notice": [_UNDER + "gnu affero general public license", _UNDER + "[gnu |]agpl"],
    "gpl-free": [_FREE + "general public license"],
    "lgpl-free": [_FREE + "[lesser|library] general public license"],
    "agpl-free": [_FREE + "affero general public license"],
    "gpl-either3": ["either version 3 of the license or at your option any later version"],
    "gpl-either2": ["either version 2 of the license or at your option any later version"],
    "gpl-either2.1": ["either version 2.1 of the license or at your option any later version"],
    "gpl-only3": ["as published by the free software foundation version 3 of the license", "version 3 of the license only"],
    "gpl-only2": ["as published by the free software foundation version 2 of the license", "version 2 of the license only"],
    "gpl-nowarranty": ["is distributed in the hope that it will be useful but without any warranty"],
    "gpl-details": ["see the gnu [lesser |library |affero |]general public license for more details"],
    "gpl-received": ["you should have received a copy of the gnu [lesser |library |affero |]general public license"],
    "apache2-notice": [_UNDER + "apache license [version |v |v|]2[.0|]", _UNDER + "apache[ software|] [version |v |v|]2[.0|] license"],
    "apache2-except": ["you may not use this file except in compliance with the license"],
    "apache2-obtain": ["you may obtain a copy of the license at"],
    "apache2-unless": ["unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis"],
    "apache2-see": ["see the license for the specific language governing permissions and limitations under the license"],
    "mit-notice": [_UNDER + "[mit|expat] license"],
    "mit-permission": ["permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"],
    "mit-copies": ["the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"],
    "mit-asis": ["the software is provided as is without warranty of any kind express or implied", "the software is provided as is and the author disclaims all warranties"],
    "mit-liable": ["in no event shall the authors or copyright holders be liable for any claim"],
    "isc-permission": ["permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"],
    "bsd-redistribution": ["redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"],
    "bsd-source": ["redistributions of source code must retain the above copyright notice"],
    "bsd-binary": ["redistributions in binary form must reproduce the above copyright notice"],
    "bsd-endorse": ["neither the name of {30} may be used to endorse or promote products derived from this software"],
    "bsd-asis": ["this software is provided by the [copyright holders|author|regents]{10} as is"],
    "bsd-liable": ["in no event shall the [copyright holder|copyright holders|copyright owner|author|regents]{6} be liable for any direct"],
    "bsd3-notice": [_UNDER + "3 clause bsd license", _UNDER + "[new|modified|revised] bsd license", _UNDER + "bsd 3 clause[ license|]"],
    "bsd2-notice": [_UNDER + "2 clause bsd license", _UNDER + "simplified bsd license", _UNDER + "bsd 2 clause[ license|]"],
    "bsd-notice": [_UNDER + "bsd license"],
    "mpl2-notice": ["this source code form is subject to the terms of the mozilla public license [version |v |v|]2[.0|]", _UNDER + "mozilla public license [version |v |v|]2[.0|]"],
    "mpl2-copy": ["if a copy of the mpl was not distributed with this file you can obtain one at"],
    "epl2-notice": [_UNDER + "eclipse public license [version |v |v|]2[.0|]"],
    "epl1-notice": [_UNDER + "eclipse public license [version |v |v|]1[.0|]"],
    "ofl-notice": [_UNDER + "sil open font license [version |v |v|]1.1", "licensed under the sil open font license"],
    "boost-notice": [_UNDER + "boost software license [version |v |v|]1[.0|]"],
    "boost-permission": ["permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license"],
    "wtfpl-title": ["do what the fuck you want to public license"],
    "cc0": ["[licensed|released|dedicated]{12} cc0", "creative commons zero", "cc0 [1.0|universal]"],
    "cc-by-nc-sa": [f"{_CC}[attribution|by] {_NC} {_SA}"],
    "cc-by-nc-nd": [f"{_CC}[attribution|by] {_NC} {_ND}"],
    "cc-by-nc": [f"{_CC}[attribution|by] {_NC}"],
    "cc-by-nd": [f"{_CC}[attribution|by] {_ND}"],
    "cc-by-sa": [f"{_CC}[attribution|by] {_SA}"],
    "cc-by": ["[licensed|released|available|distributed|published] under [a |the |]creative commons attribution", "[licensed|released|available|distributed|published] under [a |the |][creative commons|cc] by"],
    "unlicense": ["this is free and unencumbered software released into the public domain"],
    "zlib-altered": ["altered source versions must be plainly marked as such"],
    "all-rights": ["all rights reserved"],
}

# Ordered rules, identifiers in sequence -> licence; "?" marks one that may be missing.
_TAIL = ("?gpl-nowarranty", "?gpl-details", "?gpl-received")
_BSD = ("bsd-redistribution", "bsd-source", "bsd-binary")
RULES = [
    *(((f"{free}gpl-free", f"gpl-either{v}", *_TAIL), f"{name}-{v if '.' in v else v + '.0'}-or-later")
      for free, name in (("", "GPL"), ("l", "LGPL"), ("a", "AGPL")) for v in ("2", "2.1", "3")),
    *(((f"{free}gpl-free", f"gpl-only{v}", *_TAIL), f"{name}-{v}.0-only") for free, name in (("", "GPL"), ("l", "LGPL"), ("a", "AGPL")) for v in ("2", "3")),
    (("lgpl-free", *_TAIL), "LGPL"),
    (("agpl-free", *_TAIL), "AGPL"),
    (("gpl-free", *_TAIL), "GPL"),
    (("apache2-notice", "?apache2-except", "?apache2-obtain", "?apache2-unless", "?apache2-see"), "Apache-2.0"),
    (("mit-permission", "?mit-copies", "?mit-asis", "?mit-liable"), "MIT"),
    (("isc-permission", "?mit-asis", "?mit-liable"), "ISC"),
    ((*_BSD, "bsd-endorse", "?bsd-asis", "?bsd-liable"), "BSD-3-Clause"),
    ((*_BSD, "?bsd-asis", "?bsd-liable"), "BSD-2-Clause"),
    (("spdx",), "SPDX"),
    (("gpl3-notice",), "GPL-3.0"),
    (("gpl2-notice",), "GPL-2.0"),
    (("lgpl-notice",), "LGPL"),
    (("agpl-notice",), "AGPL"),
    (("mit-notice", "?mit-permission", "?mit-copies", "?mit-asis"), "MIT"),
    (("bsd3-notice",), "BSD-3-Clause"),
    (("bsd2-notice",), "BSD-2-Clause"),
    (("bsd-notice",), "BSD"),
    (("mpl2-notice", "?mpl2-copy"), "MPL-2.0"),
    (("epl2-notice",), "EPL-2.0"),
    (("epl1-notice",), "EPL-1.0"),
    (("ofl-notice",), "OFL-1.1"),
    (("boost-notice", "?boost-permission"), "BSL-1.0"),
    (("boost-permission",), "BSL-1.0"),
    (("wtfpl-title",), "WTFPL"),
    (("cc0",), "CC0-1.0"),
    (("cc-by-nc-sa",), "CC-BY-NC-SA"),
    (("cc-by-nc-nd",), "CC-BY-NC-ND"),
    (("cc-by-nc",), "CC-BY-NC"),
    (("cc-by-nd",), "CC-BY-ND"),
    (("cc-by-sa",), "CC-BY-SA"),
    (("cc-by",), "CC-BY"),
    (("unlicense",), "Unlicense"),
    (("zlib-altered",), "Zlib"),
]
# words right before a sentence that deny it, and words after which a full stop ends none
DENIALS = ("not", "never", "no longer", "nor", "neither", "not be", "isn t", "aren t", "cannot be", "rather than")
ABBREVIATIONS = ("v", "V", "vs", "e.g", "i.e", "Inc", "inc", "Ltd", "Co", "Corp", "No", "no", "ver", "Ver")
# ---- end of fixed values ----


#: Every known sentence has one of these words; a text without any is not cut into sentences.
#: The raw text may have line ends and comment marks between two words.
HINT = re.compile("|".join(w.replace(" ", "[^A-Za-z0-9]+") for w in (
    "licen[sc]e", "copyright", "warrant", "redistribut", "permission", "creative commons", "cc0", "public domain",
    "rights reserved", "plainly marked", "derived from", "provided by", "in no event", "mpl was", "gpl", "bsd", "cc by", "cc attribution")), re.I)
_end = re.compile("".join(rf"(?<!\b{re.escape(w)})" for w in ABBREVIATIONS) + r"[.!?](?=\s|$)|\n\s*\n")
_word = re.compile(r"[a-z0-9]+(?:\.[0-9]+)*")
_spdx = re.compile(r"SPDX-Licen[sc]e-Identifier:?[ \t]*([(A-Za-z0-9][A-Za-z0-9.+\-() \t]*)", re.I)
_spdx_part = re.compile(r"[()]|[A-Za-z0-9.+\-]+")


def _expanded(template: str) -> list[list[str]]:
    """The plain forms of a template as words; a gap stays as ``{n}``."""
    parts = re.split(r"(\[[^\]]*\])", template.replace("{", " {").replace("}", "} "))
    return [" ".join("".join(c).split()).split() for c in product(*(x[1:-1].split("|") if x.startswith("[") else [x] for x in parts))]


def _table() -> dict[tuple[str, ...], list[tuple[list[str], str]]]:
    """First three words (fewer if a gap or the end comes before) -> the templates that begin so."""
    out: dict[tuple[str, ...], list[tuple[list[str], str]]] = {}
    for name, templates in SENTENCES.items():
        for words in {tuple(w) for t in templates for w in _expanded(t)}:
            k = next((i for i, w in enumerate(words[:3]) if w[0] == "{"), min(3, len(words)))
            out.setdefault(words[:k], []).append((list(words), name))
    return out


TABLE = _table()


def _match(words: list[str], at: int, template: list[str]) -> int:
    """Where the template, begun at word ``at``, ends; -1 if it does not fit."""
    for k, want in enumerate(template):
        if want[0] == "{":
            for skip in range(int(want[1:-1]) + 1):
                end = _match(words, at + skip, template[k + 1:])
                if end >= 0:
                    return end
            return -1
        if at >= len(words) or words[at] != want:
            return -1
        at += 1
    return at


def expressions(text: str) -> Iterator[tuple[int, str]]:
    """(offset, expression) of each SPDX tag: identifiers joined by AND, OR, WITH and parentheses."""
    for m in _spdx.finditer(text):
        parts, depth, ident = [], 0, True  # ident: an identifier may come next
        for w in _spdx_part.findall(m.group(1)):
            op = w.upper() in ("AND", "OR", "WITH")
            if w == "(" and ident:
                depth += 1
            elif w == ")" and not ident and depth:
                depth -= 1
            elif op and not ident:
                ident = True
            elif not op and w not in "()" and ident:
                ident = False
            else:
                break
            parts.append(w.upper() if op else w)
        while parts and (parts[-1] in ("AND", "OR", "WITH") or parts[-1] == "("):
            depth -= parts.pop() == "("
        if parts:
            yield m.start(), re.sub(r"\( | (?=\))", lambda x: x.group().strip(), " ".join(parts)) + ")" * depth


def sentences(text: str) -> Iterator[tuple[int, int, int]]:
    """(number, start, end) of each sentence that holds a hint; others only advance the number."""
    hints = [m.start() for m in HINT.finditer(text)]
    at = number = h = 0
    for m in [*_end.finditer(text), None] if hints else []:
        end = m.end() if m else len(text)
        if h < len(hints) and hints[h] < end:
            yield number, at, end
            while h < len(hints) and hints[h] < end:
                h += 1
        number, at = number + 1, end
        if h == len(hints):
            break


def normalise(sentence: str) -> str:
    return " ".join(_word.findall(sentence.lower())).replace("licenc", "licens")


def identify(sentence: str) -> list[str]:
    """Identifiers of the known sentences within one sentence, in order of place."""
    words = normalise(sentence).split()
    out, i = [], 0
    while i < len(words):
        found = [(_match(words, i, t), name) for k in (1, 2, 3) for t, name in TABLE.get(tuple(words[i:i + k]), ())]
        end, name = max(found, default=(-1, ""))
        if end > i:
            before = " ".join(words[max(i - 2, 0):i])
            if not any(before == d or before.endswith(" " + d) for d in DENIALS):
                out.append(name)
            i = end
        else:
            i += 1
    return out


def scan(text: str | None) -> tuple[list[str], list[str], list[int]]:
    """(findings, identifiers, their character offsets) of a text, in order of place."""
    if not isinstance(text, str) or not HINT.search(text):
        return [], [], []
    tags = list(expressions(text))
    seq = []
    for n, a, b in sentences(text):
        here = [t for t in tags if a <= t[0] < b]
        seq += [(n, at, "spdx", tag) for at, tag in here]
        seq += [(n, a, name, "") for name in identify(text[a:b])]
    taken = [False] * len(seq)
    found = []
    for rule, licence in RULES:
        for i in range(len(seq)):
            if taken[i] or seq[i][2] != rule[0]:
                continue
            used, at, whole = [i], i, True
            for want in rule[1:]:
                nxt = next((k for k in range(at + 1, len(seq)) if not taken[k]), None)
                if nxt is not None and seq[nxt][2] == want.lstrip("?") and seq[nxt][0] - seq[at][0] <= GAP + 1:
                    used.append(nxt)
                    at = nxt
                elif not want.startswith("?"):
                    whole = False
                    break
            if whole:
                for k in used:
                    taken[k] = True
                found.append((i, f"SPDX:{seq[i][3]}" if licence == "SPDX" else licence))
    found += [(i, f"partial:{s[2]}") for i, s in enumerate(seq) if not taken[i]]
    return [f for _, f in sorted(found)], [s[2] for s in seq], [s[1] for s in seq]


def scan_documents(docs: DataFrame, text: str = "text", out: str = "licence") -> DataFrame:
    """``docs`` with struct ``out``: findings and identifiers in order of place, and sentence offsets.

    Null, empty and licence-free texts have empty lists.  Only the text goes to Python.
    """
    @F.pandas_udf("findings array<string>, sentence_ids array<string>, sentence_starts array<int>")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for s in batches:
            yield pd.DataFrame([scan(x) for x in s], columns=["findings", "sentence_ids", "sentence_starts"])

    return docs.withColumn(out, of(F.col(text)))
