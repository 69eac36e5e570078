"""License scans by sentences and ordered rules.

Sentences are normalised (lower case, letters and digits, single spaces) and looked up among the
known licence sentences below. The identifiers found, in text order, are matched against ordered
rules: each rule is a sequence of identifiers, the first rule that fits claims its sentences, and
claimed sentences are not matched again. Between two sentences of a rule, unknown sentences and
known ones of other rules may stand, up to ``GAP`` sentences.

A sentence ends at one of . ! ? ; : before white space, or at a blank line. Line breaks inside a
sentence are spaces; where the whole is not known, what starts at one of its lines may be, and so
may what also ends with one. SPDX-License-Identifier lines name their licences themselves.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame

from palimpsest.llm.arrays import frame, over_texts, strings

GAP = 6

# Sentences of public licences and usual mentions, as normalised.
SENTENCES = {
    "mit-mention": ["released under the mit license", "licensed under the mit license", "this project is licensed under the mit license", "this software is released under the mit license"],
    "mit-grant": ["permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions"],
    "mit-notice": ["the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"],
    "mit-warranty": ["the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement"],
    "isc-grant": ["permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"],
    "isc-warranty": ["the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness"],
    "apache-mention": ["licensed under the apache license version 2 0", "released under the apache license version 2 0", "this work is licensed under the apache license version 2 0"],
    "apache-header": ["licensed under the apache license version 2 0 the license"],
    "apache-use": ["you may not use this file except in compliance with the license"],
    "apache-copy": ["you may obtain a copy of the license at"],
    "apache-warranty": ["unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied"],
    "bsd-grant": ["redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"],
    "bsd-source": ["redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer", "1 redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"],
    "bsd-binary": ["redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution", "2 redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"],
    "bsd-names": ["neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission", "3 neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"],
    "bsd-mention": ["licensed under the bsd license", "released under the bsd license"],
    "gpl3-mention": ["this work is licensed under the gnu general public license version 3", "licensed under the gnu general public license version 3", "released under the gnu general public license version 3"],
    "gpl2-mention": ["this work is licensed under the gnu general public license version 2", "licensed under the gnu general public license version 2", "released under the gnu general public license version 2"],
    "gpl-free": ["this program is free software"],
    "gpl3-terms": ["you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version"],
    "gpl2-terms": ["you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version"],
    "lgpl-terms": ["you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation"],
    "gpl-warranty": ["this program is distributed in the hope that it will be useful but without any warranty"],
    "mpl-header": ["this source code form is subject to the terms of the mozilla public license v 2 0"],
    "unlicense": ["this is free and unencumbered software released into the public domain"],
    "cc0-mention": ["licensed under cc0 1 0", "released under cc0 1 0"],
    "ccby-mention": ["licensed under cc by 4 0", "released under cc by 4 0", "this work is licensed under a creative commons attribution 4 0 international license"],
    "ccbysa-mention": ["licensed under cc by sa 4 0", "released under cc by sa 4 0", "this work is licensed under a creative commons attribution sharealike 4 0 international license"],
    "ccbync-mention": ["licensed under cc by nc 4 0", "released under cc by nc 4 0", "this work is licensed under a creative commons attribution noncommercial 4 0 international license"],
    "reserved": ["all rights reserved"],
    "bsd-warranty": ["this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed"],
    "boost-grant": ["permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the software to use reproduce display distribute execute and transmit the software and to prepare derivative works of the software and to permit third parties to whom the software is furnished to do so all subject to the following"],
    "zlib-grant": ["permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions"],
    "agpl3-terms": ["you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version", "you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation version 3"],
}

# Names of licences in mentions, as normalised; "the" and "license" are as usual.
NAMES = {
    "mit-mention": ["mit license", "mit licence", "mit"],
    "apache-mention": ["apache license version 2 0", "apache license 2 0", "apache 2 0 license", "apache 2 0", "apache license v2 0"],
    "bsd-mention": ["bsd license"],
    "bsd2-mention": ["bsd 2 clause license", "2 clause bsd license", "simplified bsd license"],
    "bsd3-mention": ["bsd 3 clause license", "3 clause bsd license", "new bsd license", "modified bsd license"],
    "gpl3-mention": ["gnu general public license version 3", "gnu general public license v3 0", "gnu general public license v3", "gnu gpl version 3", "gnu gpl v3", "gpl v3", "gplv3", "gpl version 3"],
    "gpl2-mention": ["gnu general public license version 2", "gnu general public license v2 0", "gnu general public license v2", "gnu gpl version 2", "gnu gpl v2", "gpl v2", "gplv2", "gpl version 2"],
    "lgpl3-mention": ["gnu lesser general public license version 3", "gnu lesser general public license v3", "gnu lgpl v3", "lgpl v3", "lgplv3", "lgpl version 3"],
    "lgpl21-mention": ["gnu lesser general public license version 2 1", "gnu lesser general public license v2 1", "gnu lgpl v2 1", "lgpl v2 1", "lgpl version 2 1"],
    "agpl3-mention": ["gnu affero general public license version 3", "gnu affero general public license v3", "gnu agpl v3", "agpl v3", "agplv3", "agpl version 3"],
    "mpl-mention": ["mozilla public license version 2 0", "mozilla public license 2 0", "mozilla public license v 2 0", "mpl 2 0"],
    "epl2-mention": ["eclipse public license version 2 0", "eclipse public license 2 0", "eclipse public license v 2 0", "eclipse public license v2 0", "epl 2 0"],
    "epl1-mention": ["eclipse public license version 1 0", "eclipse public license 1 0", "eclipse public license v1 0", "epl 1 0"],
    "boost-mention": ["boost software license version 1 0", "boost software license 1 0", "boost software license"],
    "zlib-mention": ["zlib license"],
    "artistic-mention": ["artistic license 2 0", "artistic license version 2 0"],
    "isc-mention": ["isc license"],
}
SUBJECTS = ["", *(f"{a} {b} is " for a in ("this", "the") for b in ("work", "file", "project", "software", "program", "library", "package", "code", "source code", "module"))]
VERBS = ["licensed under", "released under", "distributed under", "available under", "made available under", "provided under", "published under"]
for _name, _texts in NAMES.items():
    SENTENCES[_name] = sorted(
        {*SENTENCES.get(_name, ())}
        | {f"{a}{b} {c}{d}" for a in SUBJECTS for b in VERBS for c in ("", "the ", "the terms of the ") for d in _texts}
    )

# Rules in order of precedence.
RULES = [
    ("MIT", "text", ["mit-grant", "mit-notice", "mit-warranty"]),
    ("ISC", "text", ["isc-grant", "isc-warranty"]),
    ("Apache-2.0", "header", ["apache-header", "apache-use", "apache-copy", "apache-warranty"]),
    ("BSD-3-Clause", "text", ["bsd-grant", "bsd-source", "bsd-binary", "bsd-names", "bsd-warranty"]),
    ("BSD-3-Clause", "text", ["bsd-grant", "bsd-source", "bsd-binary", "bsd-names"]),
    ("BSD-2-Clause", "text", ["bsd-grant", "bsd-source", "bsd-binary", "bsd-warranty"]),
    ("BSD-2-Clause", "text", ["bsd-grant", "bsd-source", "bsd-binary"]),
    ("GPL-3.0-or-later", "header", ["gpl-free", "gpl3-terms", "gpl-warranty"]),
    ("GPL-2.0-or-later", "header", ["gpl-free", "gpl2-terms", "gpl-warranty"]),
    ("LGPL", "header", ["gpl-free", "lgpl-terms"]),
    ("AGPL-3.0", "header", ["gpl-free", "agpl3-terms"]),
    ("MPL-2.0", "header", ["mpl-header"]),
    ("BSL-1.0", "text", ["boost-grant"]),
    ("Zlib", "text", ["zlib-grant"]),
    ("Unlicense", "text", ["unlicense"]),
    ("MIT", "notice", ["mit-grant"]),
    ("MIT", "mention", ["mit-mention"]),
    ("Apache-2.0", "mention", ["apache-header"]),
    ("Apache-2.0", "mention", ["apache-mention"]),
    ("BSD", "mention", ["bsd-mention"]),
    ("BSD-2-Clause", "mention", ["bsd2-mention"]),
    ("BSD-3-Clause", "mention", ["bsd3-mention"]),
    ("LGPL-3.0-only", "mention", ["lgpl3-mention"]),
    ("LGPL-2.1-only", "mention", ["lgpl21-mention"]),
    ("AGPL-3.0-only", "mention", ["agpl3-mention"]),
    ("MPL-2.0", "mention", ["mpl-mention"]),
    ("EPL-2.0", "mention", ["epl2-mention"]),
    ("EPL-1.0", "mention", ["epl1-mention"]),
    ("BSL-1.0", "mention", ["boost-mention"]),
    ("Zlib", "mention", ["zlib-mention"]),
    ("Artistic-2.0", "mention", ["artistic-mention"]),
    ("ISC", "mention", ["isc-mention"]),
    ("GPL-3.0-only", "mention", ["gpl3-mention"]),
    ("GPL-2.0-only", "mention", ["gpl2-mention"]),
    ("CC0-1.0", "mention", ["cc0-mention"]),
    ("CC-BY-4.0", "mention", ["ccby-mention"]),
    ("CC-BY-SA-4.0", "mention", ["ccbysa-mention"]),
    ("CC-BY-NC-4.0", "mention", ["ccbync-mention"]),
    ("all-rights-reserved", "mention", ["reserved"]),
]

_KNOWN = {text: name for name, texts in SENTENCES.items() for text in texts}
_BEGINNINGS = {text[:k] for text in _KNOWN for k, c in enumerate(text + " ") if c == " "}
_SPDX = re.compile(r"SPDX-License-Identifier:[\x20\t]*([^\n]*)", re.I)
_SPDX_NAME = re.compile(r"(?<![A-Za-z0-9.+-])(?!(?:AND|OR|WITH)\b)[A-Za-z0-9][A-Za-z0-9.+-]*")
# every known sentence holds one of these, so other texts need no sentence split
_TRIGGER = re.compile("licen[sc]e|permi|notice|provided|redistribut|endorse|software|distributed|reserved|cc0|cc by|under", re.I)
if not all(_TRIGGER.search(text) for text in _KNOWN):
    raise ValueError("a known sentence has no trigger")
_TRIGGER = re.compile(_TRIGGER.pattern.replace("cc by", r"cc\W+by"), re.I)
_END = re.compile(r"[.!?;:](?=\s|$)|\n[\x20\t\r]*\n")
_JUNK = re.compile(r"[^a-z0-9]+")

Match = tuple[str, str, int, int]  # licence, rule, first and last code point


def normalised(sentence: str) -> str:
    return _JUNK.sub(" ", sentence.lower()).strip()


def lines_known(text: str, start: int, end: int) -> list[tuple[str, int, int]]:
    """(identifier, start, end) of known sentences made of whole lines between ``start`` and ``end``."""
    lines = []
    while start < end:
        stop = text.find("\n", start, end)
        stop = end if stop < 0 else stop
        words = normalised(text[start:stop])
        if words:
            lines.append((words, start, stop))
        start = stop + 1
    found, at = [], 0
    while at < len(lines):
        joined, last = "", None
        for k in range(at, len(lines)):
            joined = f"{joined} {lines[k][0]}".strip()
            if joined not in _BEGINNINGS:
                break
            if joined in _KNOWN:
                last = k, _KNOWN[joined]
        if last:
            found.append((last[1], lines[at][1], lines[last[0]][2]))
        at = last[0] + 1 if last else at + 1
    return found


def spdx(text: str) -> list[Match]:
    """Licences that SPDX lines name, as written; exceptions after WITH are no licences."""
    found = []
    for line in _SPDX.finditer(text):
        names = re.sub(r"\bWITH\s+\S+", lambda m: " " * len(m.group()), line.group(1))
        expression = re.match(r"[\s()]*[\w.+-]+(?:[\s()]+(?:AND|OR)[\s()]+[\w.+-]+)*", names)
        for m in _SPDX_NAME.finditer(expression.group()) if expression else ():
            found.append((m.group(), "spdx", line.start(1) + m.start(), line.start(1) + m.end()))
    return found


def known_sentences(text: str) -> list[tuple[int, str, int, int]]:
    """(position among the sentences, identifier, start, end) of the known sentences."""
    found, at = [], 0
    ends = [m.end() for m in _END.finditer(text)] + [len(text)]
    for k, end in enumerate(ends):
        start = at
        while start < end:
            name = _KNOWN.get(normalised(text[start:end]))
            if name:
                break
            start = text.find("\n", start, end) + 1 or end
        found += [(k, *x) for x in lines_known(text, at, start)]
        if start < end:
            found.append((k, name, start, end))
        at = end
    return found


def match_rules(found: list[tuple[int, str, int, int]]) -> list[Match]:
    """Apply the rules in order; each claims its sentences."""
    free, matches = [True] * len(found), []
    for licence, kind, wanted in RULES:
        for first in range(len(found)):
            if not free[first] or found[first][1] != wanted[0]:
                continue
            chain = [first]
            for name in wanted[1:]:
                at = chain[-1] + 1
                while at < len(found) and found[at][0] - found[chain[-1]][0] <= GAP + 1:
                    if free[at] and found[at][1] == name:
                        chain.append(at)
                        break
                    at += 1
                else:
                    break
            if len(chain) == len(wanted):
                for k in chain:
                    free[k] = False
                start, end = found[chain[0]][2], found[chain[-1]][3]
                matches.append((licence, kind, start, end))
    return sorted(matches, key=lambda m: (m[2], m[3], m[0]))


def find_licenses(docs: DataFrame) -> DataFrame:
    """(doc_id, n_matches, licenses, matches) of every row of ``docs``.

    licenses: distinct licence names, sorted, comma-joined. matches: licence:rule:start:end by
    start, comma-joined; offsets count code points. Both are empty where nothing is found; a null
    text is empty. Repeated rows are reported each. Other columns are not read.
    """
    schema = pa.schema(
        [("doc_id", pa.int64()), ("n_matches", pa.int64()), ("licenses", pa.string()), ("matches", pa.string())]
    )

    def fn(batches):
        for ids, texts in strings(batches):
            found = [
                sorted(match_rules(known_sentences(t)) + spdx(t), key=lambda m: (m[2], m[3], m[0]))
                if _TRIGGER.search(t)
                else []
                for t in texts
            ]
            yield frame(
                schema,
                doc_id=ids,
                n_matches=[len(f) for f in found],
                licenses=[",".join(sorted({m[0] for m in f})) for f in found],
                matches=[",".join(":".join(map(str, m)) for m in f) for f in found],
            )

    return over_texts(docs, fn, "doc_id long, n_matches long, licenses string, matches string")
