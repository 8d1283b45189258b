import random
import re

from shelfwise.llm import op10_licences as op10
from shelfwise.llm.op10_licences import scan, scan_documents

MIT = """Copyright (c) 2020 A. Person

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal in it.

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED."""
APACHE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in
compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0
Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS."""
GPL = """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public
License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.
This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY. You should have received a copy of the GNU General Public License."""


def test_known_texts():
    assert scan(MIT)[0] == ["MIT"]
    assert scan(APACHE)[0] == scan(APACHE + " See the License for the specific language governing permissions and limitations under the License.")[0] == ["Apache-2.0"]
    assert scan(GPL)[0] == ["GPL-3.0-or-later"]
    assert scan("Foo. Released under the MIT License.\nBar")[0] == ["MIT"]
    assert scan("Licensed under CC BY-NC 4.0.")[0] == ["CC-BY-NC"]
    assert scan("Licensed under the Apache License, Version 2.0.")[0] == ["Apache-2.0"]
    assert scan("This work is licensed under the GNU General Public License, version 3.")[0] == ["GPL-3.0"]
    assert scan("# SPDX-License-Identifier: BSD-3-Clause\nint x;")[0] == ["SPDX:BSD-3-Clause"]
    assert scan("MIT is a place. The licence to drive.")[0] == []
    assert scan("Released under the MIT License. Released under the MIT License.")[0] == ["MIT", "MIT"]
    assert scan(None) == scan("") == ([], [], [])


GNU = """This {0} is free software; you can redistribute it and/or modify it under the terms of the GNU {1}General Public License as
published by the Free Software Foundation; either version {2} of the License, or (at your option) any later version.

This {0} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {1}General Public License for more details.

You should have received a copy of the GNU {1}General Public License along with this {0}. If not, see <https://www.gnu.org/licenses/>."""
BSD3 = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation.

3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software
without specific prior written permission.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES ARE DISCLAIMED. IN NO EVENT SHALL THE
COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT DAMAGES."""
HEADERS = {
    GNU.format("library", "Lesser ", "2.1"): "LGPL-2.1-or-later", GNU.format("program", "Affero ", "3"): "AGPL-3.0-or-later", GNU.format("program", "", "2"): "GPL-2.0-or-later",
    "// " + GNU.format("program", "", "3").replace("\n", "\n// "): "GPL-3.0-or-later", BSD3: "BSD-3-Clause", BSD3[:BSD3.index("3. Neither")] + BSD3[BSD3.index("THIS SOFTWARE"):]: "BSD-2-Clause",
    "This Source Code Form is subject to the terms of the Mozilla Public\n * License, v. 2.0. If a copy of the MPL was not distributed with this\n * file, You can obtain one at https://mozilla.org/MPL/2.0/.": "MPL-2.0",
    "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/": "EPL-2.0",
    "This Font Software is licensed under the SIL Open Font License, Version 1.1.": "OFL-1.1", "Distributed under the Boost Software License, Version 1.0. (See accompanying file)": "BSL-1.0",
    "DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE": "WTFPL", "This work is licensed under a Creative Commons Attribution-Non-Commercial 4.0 International License.": "CC-BY-NC",
    "Licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 3.0 licence": "CC-BY-NC-SA", "Published under CC BY-ND 4.0": "CC-BY-ND", "Available under Creative Commons Attribution 4.0": "CC-BY",
    "SPDX-License-Identifier: (MIT OR Apache-2.0)": "SPDX:(MIT OR Apache-2.0)", "/* SPDX-License-Identifier: GPL-2.0-only with Classpath-exception-2.0 */": "SPDX:GPL-2.0-only WITH Classpath-exception-2.0",
    "# SPDX-License-Identifier: MIT": "SPDX:MIT", "Licensed under the new BSD licence.": "BSD-3-Clause", "Copyright Acme Inc. and others, licensed under the MIT License.": "MIT",
}


def test_standard_headers_give_one_finding_each():
    assert {h: scan(h)[0] for h in HEADERS} == {h: [v] for h, v in HEADERS.items()}
    both = "\n\n".join(HEADERS)
    assert sorted(scan(both)[0]) == sorted(HEADERS.values())


def test_denied_licences_are_none():
    for t in ("This is not licensed under the MIT License.", "It is no longer released under the GNU General Public License v3.", "never distributed under the BSD License"):
        assert scan(t)[0] == []
    assert scan("This is not old. It is licensed under the MIT License.")[0] == ["MIT"]


def plain_identify(sentence):
    """Every template tried at every word, as a regular expression over the normalised sentence."""
    s, out, at = op10.normalise(sentence), [], 0
    rules = [(re.compile(" ".join(r"(?:\S+ ){0,%s}?" % w[1:-1] if w[0] == "{" else re.escape(w) for w in ws).replace("? ", "?") + r"(?!\S)"), n)
             for n, ts in op10.SENTENCES.items() for t in ts for ws in op10._expanded(t)]
    starts = [m.start() for m in re.finditer(r"\S+", s)]
    for i in starts:
        if i < at:
            continue
        end, name = max(((m.end(), n) for p, n in rules if (m := p.match(s, i))), default=(-1, ""))
        if end > i:
            before = " ".join(s[:i].split()[-2:])
            if not any(before == d or before.endswith(" " + d) for d in op10.DENIALS):
                out.append(name)
            at = end
    return out


def test_table_against_every_template_at_every_word():
    rng = random.Random(10)
    plain = [" ".join(w if w[0] != "{" else " ".join(["word"] * rng.randint(0, int(w[1:-1]) + 1)) for w in ws) for ts in op10.SENTENCES.values() for t in ts for ws in rng.sample(op10._expanded(t), 1)]
    for _ in range(120):
        parts = [rng.choice([rng.choice(plain), rng.choice(["not", "foo bar", "the licence", ""]), " ".join(rng.choice(plain).split()[:rng.randint(1, 9)])]) for _ in range(rng.randint(1, 4))]
        text = " ".join(parts)
        assert op10.identify(text) == plain_identify(text), text


def test_sentences_wrapped_between_the_hinted_words():
    assert scan("# This is free and unencumbered software released into the public\n# domain.")[0] == ["Unlicense"]
    assert scan("All rights\nreserved")[0] == ["partial:all-rights"]
    assert scan(" * All  rights\r\n *   reserved.")[0] == ["partial:all-rights"]
    assert scan("// Creative\n// Commons Zero")[0] == ["CC0-1.0"]
    assert scan("-- Altered source versions must be plainly\n-- marked as such.")[0] == ["Zlib"]
    assert scan("Neither the name of X may be used to endorse or promote products derived\n# from this software")[0] == ["partial:bsd-endorse"]
    assert scan("This software is provided\n# by the author as is.")[0] == ["partial:bsd-asis"]


def test_rules_need_their_sentences_near():
    far = MIT.replace("The above", "One. Two. Three. Four. Five. Six. The above")
    assert "partial:mit-copies" in scan(far)[0]


def test_edge_rows(edge, nothing):
    assert scan_documents(edge).where("size(licence.findings) > 0").count() == 0
    assert scan_documents(nothing).collect() == []


def test_documents_against_plain_search(small):
    lines = {"This work is licensed under the GNU General Public License, version 3.": "GPL-3.0", "Licensed under CC BY-NC 4.0.": "CC-BY-NC",
             "Released under the MIT License.": "MIT", "Licensed under the Apache License, Version 2.0.": "Apache-2.0"}
    for r in scan_documents(small).collect():
        want = [v for k, v in lines.items() for _ in range(r["text"].count(k))]
        want = sorted(want + ["partial:all-rights"] * r["text"].lower().count("all rights reserved"))
        assert sorted(r["licence"]["findings"]) == want


def test_every_known_sentence_has_a_hint():
    for name, templates in op10.SENTENCES.items():
        for t in templates:
            for words in op10._expanded(t):
                assert op10.HINT.search(" ".join(w for w in words if w[0] != "{")), (name, words)
