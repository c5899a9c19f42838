import re
import textwrap

from latticework.llm import licenses as L


def brute(text):
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    names = {s: n for n, s in L.SENTENCES.items()}
    out = []
    for read in (text, re.sub(r"\n[^a-z0-9]*\n", "\0", text).replace("\n", " ")):
        parts = re.split(r"\0|\n|[.!?;:]+(?=[ \t-\r])|[.!?;:]+\Z", read)
        out.append([names[s] for s in (re.sub("[^a-z0-9]+", " ", p).strip() for p in parts) if s in names])
    found = []
    for name, ids in L.RULES:
        if name not in found and any(list(ids) == seq[k : k + len(ids)] for seq in out for k in range(len(seq))):
            found.append(name)
    return out, found


MIT = """Copyright (c) 2020 Someone

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
SOFTWARE."""

TEXTS = [
    None,
    "",
    "some words\nReleased under the MIT License.",
    "Words. Licensed under the Apache License, Version 2.0.\nAll rights reserved!",
    "This work is licensed under the GNU General Public License, version 3.",
    "mention of the MIT License. Nothing released under it.",
    MIT,
    MIT.replace("\n", "\r\n"),
    "x " * 50000 + ".\n" + MIT + "\nÀ la fin: all rights reserved",
    "Licensed under CC BY-NC 4.0.\nReleased under the MIT License.",
    "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Other words. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
]


def test_equals_brute_force(spark):
    rows = [(k, t, "x") for k, t in enumerate(TEXTS)] + [(None, TEXTS[2], "x"), (2, TEXTS[2], "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, license string")
    got = L.scan(df).collect()
    assert len(got) == len(rows)
    for r in got:
        lines, whole = brute(TEXTS[r.doc_id if r.doc_id is not None else 2])[0]
        assert (r.line_ids, r.text_ids) == (lines, whole), r.doc_id
        assert r.licenses == brute(TEXTS[r.doc_id if r.doc_id is not None else 2])[1]
    by = {r.doc_id: r.license for r in got}
    assert [by[k] for k in range(len(TEXTS))] == [None, None, "MIT", "Apache-2.0", "GPL-3.0-only", None, "MIT", "MIT", "MIT", "MIT", "BSD-2-Clause"]
    assert L.scan(df.limit(0)).count() == 0


def wrapped(text, width=60):
    return "\n".join(" * " + line for line in textwrap.wrap(text, width))


GPL = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."
GPL2 = "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."
LGPL = "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."
AGPL = GPL.replace("GNU General", "GNU Affero General")
HOPE = "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the GNU General Public License for more details."
APACHE = 'Licensed under the Apache License, Version 2.0 (the "License");\nyou may not use this file except in compliance with the License.\nYou may obtain a copy of the License at\n\n    http://www.apache.org/licenses/LICENSE-2.0\n\nUnless required by applicable law'
MPL = "This Source Code Form is subject to the terms of the Mozilla Public\nLicense, v. 2.0. If a copy of the MPL was not distributed with this\nfile, You can obtain one at http://mozilla.org/MPL/2.0/."
KNOWN = [
    ("GPL-3.0-or-later", GPL + "\n\n" + HOPE),
    ("GPL-2.0-or-later", wrapped(GPL2)),
    ("GPL-2.0-or-later", GPL2 + " " + HOPE),
    ("LGPL-2.1-or-later", LGPL),
    ("AGPL-3.0-or-later", AGPL),
    ("Apache-2.0", APACHE),
    ("MPL-2.0", MPL),
    ("Apache-2.0", "// SPDX-License-Identifier: Apache-2.0\npackage main"),
    ("GPL-2.0-or-later", "/* SPDX-License-Identifier: GPL-2.0-or-later */\nint main() {}"),
    ("GPL-2.0-only", "# SPDX-License-Identifier: GPL-2.0\n"),
    ("GPL-2.0-or-later", "Licensed under the GNU GPL version 2 or later."),
    ("Zlib", wrapped("This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:").replace(" * ", "")),
    ("BSL-1.0", "// Distributed under the Boost Software License, Version 1.0.\n// (See accompanying file LICENSE_1_0.txt)"),
    ("GPL-2.0-only", "The licenses for most software are designed to take away your\nfreedom to share and change it.  By contrast, the GNU General Public\nLicense is intended to guarantee your freedom to share and change free\nsoftware--to make sure the software is free for all its users.  This"),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    (None, "The word MIT or Apache-2.0 alone. MIT\nnothing licensed, this program is free software"),
]


def test_public_notices_are_told(spark):
    docs = spark.createDataFrame([(k, t) for k, (_, t) in enumerate(KNOWN)], "doc_id long, text string")
    got = {r.doc_id: r.license for r in L.scan(docs).collect()}
    assert [(got[k], t[:60]) for k, (_, t) in enumerate(KNOWN)] == [(want, t[:60]) for want, t in KNOWN]


def test_tables():
    assert len(L.SENTENCES) > 80 and len(L.RULES) > 90 and all(set(ids) <= set(L.SENTENCES) for _, ids in L.RULES)
    assert L.sentences_of("Licensed under X, v. 2.0. É: the (end)!") == ["licensed under x v", "2 0", "the end"]
