"""License scans: known sentences become identifiers, identifier sequences meet ordered rules.

A text is cut into sentences twice: at line ends as well (notices on lines of their own), and at
blank lines only (texts wrapped at a margin), where a line with nothing but comment marks is blank. Each sentence is normalised (lower case, runs of
anything but a-z and 0-9 one blank) and mapped to the identifier of a known licence
sentence or to none. A rule is an ordered sequence of identifiers; it matches where they follow
one another without a foreign sentence between them.
"""

from __future__ import annotations

import re
from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_MIT_GRANT = 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:'
_MIT_NOTICE = "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software"
_BSD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
)


def _bsd(n: int) -> tuple[str, ...]:
    """The conditions of BSD, numbered or bulleted, with or without blank lines before them."""
    return tuple(_BSD[0] + "".join(gap + (f"{i}. " if mark else "* ") + t for i, t in enumerate(_BSD[1:n], 1)) for gap in ("\n\n", " ") for mark in (True, False))


#: Licences whose SPDX lines are known.
SPDX = ("MIT", "Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "ISC", "MPL-2.0", "GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0-only", "GPL-3.0-or-later", "LGPL-2.1-or-later", "LGPL-3.0-or-later", "AGPL-3.0-only", "AGPL-3.0-or-later", "BSL-1.0", "Unlicense", "CC0-1.0", "Zlib")
#: Known sentences by identifier (fixed values: wording of the public licences and of notices that cite them).
SENTENCES = {
    1: ("This work is licensed under the GNU General Public License, version 3",),
    2: ("Licensed under CC BY-NC 4.0", "This work is licensed under CC BY-NC 4.0"),
    3: ("Released under the MIT License", "Licensed under the MIT License"),
    4: ("Licensed under the Apache License, Version 2.0",),
    5: ('Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License',),
    6: ("You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0", "You may obtain a copy of the License at https://www.apache.org/licenses/LICENSE-2.0", "You may obtain a copy of the License at\n\nhttp://www.apache.org/licenses/LICENSE-2.0", "You may obtain a copy of the License at\n\nhttps://www.apache.org/licenses/LICENSE-2.0"),
    7: ('Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied',),
    8: ("See the License for the specific language governing permissions and limitations under the License",),
    9: (
        _MIT_GRANT + " " + _MIT_NOTICE,
        _MIT_GRANT + "\n\n" + _MIT_NOTICE,
    ),
    10: ('THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT',),
    11: ("IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE",),
    12: ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies",),
    13: ("This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",),
    14: ("This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE",),
    15: ("See the GNU General Public License for more details",),
    16: ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",),
    17: ("This work is licensed under the Creative Commons Attribution 4.0 International License",),
    18: _bsd(3),
    19: _bsd(4),
    20: ('THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED',),
    21: ("This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version",),
    22: ("This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",),
    23: ("See the GNU Affero General Public License for more details",),
    24: ("This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version",),
    25: ("This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE",),
    26: ("See the GNU Lesser General Public License for more details",),
    27: ("This work is licensed under the Creative Commons Attribution-ShareAlike 4.0 International License",),
    28: ("This is free and unencumbered software released into the public domain",),
    29: ("Distributed under the Boost Software License, Version 1.0",),
    30: ("Licensed under the BSD 3-Clause License", "Released under the BSD 3-Clause License"),
    **{40 + i: (f"SPDX-License-Identifier: {x}",) for i, x in enumerate(SPDX)},
}
#: Ordered rules: (rule, licence, identifiers).
RULES = (
    ("agpl-family-notice-gpl3", "GPL-3.0-only", (1,)),
    ("cc-by-nc-4-notice", "CC-BY-NC-4.0", (2,)),
    ("mit-notice", "MIT", (3,)),
    ("apache-2-notice", "Apache-2.0", (4,)),
    ("apache-2-header", "Apache-2.0", (5, 6, 7, 8)),
    ("mit-text", "MIT", (9, 10, 11)),
    ("isc-grant", "ISC", (12,)),
    ("gpl-3-header", "GPL-3.0-or-later", (13, 14, 15)),
    ("mpl-2-notice", "MPL-2.0", (16,)),
    ("cc-by-4-notice", "CC-BY-4.0", (17,)),
    ("bsd-2-text", "BSD-2-Clause", (18, 20)),
    ("bsd-3-text", "BSD-3-Clause", (19, 20)),
    ("gpl-2-header", "GPL-2.0-or-later", (21, 14, 15)),
    ("agpl-3-header", "AGPL-3.0-or-later", (22, 14, 23)),
    ("lgpl-2.1-header", "LGPL-2.1-or-later", (24, 25, 26)),
    ("cc-by-sa-4-notice", "CC-BY-SA-4.0", (27,)),
    ("unlicense-notice", "Unlicense", (28,)),
    ("boost-notice", "BSL-1.0", (29,)),
    ("bsd-3-notice", "BSD-3-Clause", (30,)),
    *((f"spdx-{x.lower()}", x, (40 + i,)) for i, x in enumerate(SPDX)),
)
#: Where a text is cut: at line ends too, and at blank lines only.
CUTS = (r"[.!?]+\s+|[.!?]*\n+", r"[.!?]+\s+|[.!?]*\n[\s#*/;%-]*\n+")


def normalised(sentence: str) -> str:
    return re.sub("[^a-z0-9]+", " ", sentence.lower()).strip(" ")


def known_sentences(sentences=SENTENCES) -> dict[str, int]:
    """Normal forms of known sentences; a sentence with stops inside counts as the run of its parts joined."""
    return {normalised(s): i for i, forms in sentences.items() for s in forms}


def _split_known(cut: str, sentences=SENTENCES) -> tuple[dict[str, int], dict[int, tuple[int, ...]]]:
    """Parts of the known sentences under a cut, numbered, and each sentence's part numbers."""
    parts: dict[str, int] = {}
    runs: dict[int, list[tuple[int, ...]]] = {}
    for i, forms in sentences.items():
        for s in forms:
            run = tuple(parts.setdefault(p, len(parts) + 1) for p in map(normalised, re.split(cut, s)) if p)
            runs.setdefault(i, []).append(run)
    return parts, {i: tuple(r) for i, r in runs.items()}


def identifier_string(text: Column, cut: str, sentences=SENTENCES) -> Column:
    """A text as ``;id;`` of its sentences in order, ``;0;`` for unknown ones; blank ones are left out."""
    parts, _ = _split_known(cut, sentences)
    table = F.create_map(*chain.from_iterable((F.lit(p), F.lit(f";{n};")) for p, n in parts.items()))
    pieces = F.split(F.coalesce(text, F.lit("")), cut)
    forms = F.transform(pieces, lambda s: F.trim(F.regexp_replace(F.lower(s), "[^a-z0-9]+", " ")))
    return F.concat_ws("", F.transform(F.filter(forms, lambda s: s != ""), lambda s: F.coalesce(table[s], F.lit(";0;"))))


def sequences(identifiers: tuple[int, ...], cut: str, sentences=SENTENCES) -> list[str]:
    """The identifier strings that a rule accepts under a cut."""
    _, runs = _split_known(cut, sentences)
    out = [""]
    for i in identifiers:
        out = [head + "".join(f";{n};" for n in run) for head in out for run in runs[i]]
    return sorted(set(out))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules=RULES, sentences=SENTENCES) -> DataFrame:
    """``doc_id, rule, license, n_matches`` for each document row and rule it matches.

    n_matches: occurrences under the cut that finds more of them. Null and empty texts match
    nothing; null ids stay null; repeated rows each give their rows; other columns are ignored; an
    empty table gives no rows. All in built-in expressions, without a shuffle.
    """
    text = F.col(text_col).cast("string")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"))
    # A cheap look at the raw text spares the cutting: every known sentence has one of these words.
    rows = rows.where(F.lower("text").rlike("licen|permission|warrant|authors or copyright|public domain"))
    rows = rows.select("doc_id", *(identifier_string(F.col("text"), c, sentences).alias(f"ids{k}") for k, c in enumerate(CUTS)))

    def count(k: int, pattern: str) -> Column:
        ids = F.col(f"ids{k}")
        return ((F.length(ids) - F.length(F.replace(ids, F.lit(pattern), F.lit("")))) / len(pattern)).cast("long")

    found = [
        F.struct(F.lit(rule).alias("rule"), F.lit(lic).alias("license"), F.greatest(*(sum((count(k, p) for p in sequences(ids, c, sentences)), F.lit(0)) for k, c in enumerate(CUTS))).cast("long").alias("n_matches"))
        for rule, lic, ids in rules
    ]
    return rows.select("doc_id", F.explode(F.filter(F.array(*found), lambda m: m["n_matches"] > 0)).alias("m")).select("doc_id", "m.rule", "m.license", "m.n_matches")
