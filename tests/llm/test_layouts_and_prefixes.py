import random

import pytest

from maskwright.llm import licenses, token_counts

APACHE = """Copyright 2024 Jo Doe

Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and
limitations under the License.
"""
MIT = """MIT License

Copyright (c) 2024 Jo Doe

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,
OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE
SOFTWARE.
"""
BSD = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS"
AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
DISCLAIMED. IN NO EVENT
"""


def test_published_layouts(spark):
    marks = ["", "# ", " * ", "// ", "-- "]
    rows = [(10 * k + i, "".join((m + line).rstrip() + "\n" for line in t.splitlines())) for k, t in enumerate((APACHE, MIT, BSD)) for i, m in enumerate(marks)]
    rows += [(90, "// SPDX-License-Identifier: BSD-3-Clause\nint x;"), (91, "This is free and unencumbered software released into the public domain.\n")]
    got = {(r.doc_id, r.rule, r.n_matches) for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    want = {(10 * k + i, rule, 1) for k, rule in enumerate(("apache-2-header", "mit-text", "bsd-2-text")) for i in range(len(marks))}
    assert got == want | {(90, "spdx-bsd-3-clause", 1), (91, "unlicense-notice", 1)}


PIECES = ["ก่", "น้ำ", "नि", "क्", "é", "äb", "İ", "x", "7", "'s", "'", "!", "?!", "<|endoftext|>", "<|", "ß", "한", "하", "ȩ́", "२", "Σ"]


@pytest.mark.parametrize("seed", range(12))
def test_long_units_are_counted_at_every_prefix(monkeypatch, seed):
    pc, r = token_counts.PrefixCounter(), random.Random(seed)
    monkeypatch.setattr(token_counts, "BRUTE", 8)
    for _ in range(25):
        unit = "".join(r.choice(PIECES) for _ in range(r.randrange(8, 60)))
        want = [len(e.ids) for e in pc.library.encode_batch([unit[: i + 1] for i in range(len(unit))], add_special_tokens=False)]
        assert pc.brute(unit) == want, unit


def test_budget_in_a_long_unit():
    pc = token_counts.PrefixCounter()
    unit = "น้ำ" * 1200 + "<|endoftext|>" + "ab7" * 400
    blob = token_counts.stored(pc.text(unit))
    for i in (1, 5, 2049, 3000, 3606, 3613, len(unit)):
        assert token_counts.count_at(blob, i) == len(pc.library.encode(unit[:i], add_special_tokens=False).ids)
    cut = token_counts.longest_within(blob, 100)
    assert cut < 200
