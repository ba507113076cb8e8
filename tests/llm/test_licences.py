import re

from tamarack.llm import licences as lic


def sentences(text):
    """Identifiers by trying every known sentence, word by word, at every cut."""
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    low = re.sub(r"[.!?;:](?=[^ \t-\r])", " ", low)
    words, ends = [], []
    for token in re.findall(r"[a-z0-9]+|[.!?]|[;:\n\r]", low):
        if token[0] in ".!?;:\n\r":
            if words:
                ends[-1] = max(ends[-1], 2 if token in ".!?" else 1)
        else:
            words.append(token)
            ends.append(0)
    if words:
        ends[-1] = max(ends[-1], 1)
    known = sorted(((v.split(), k) for k, v in lic.SENTENCES.items()), key=lambda x: -len(" ".join(x[0])))

    def end(at, parts):
        if not parts:
            return at if ends[at - 1] else None
        for n in range(1, 13 if parts[0] == "*" else 2):
            if at + n > len(words) or (parts[0] != "*" and words[at] != parts[0]):
                return None
            if any(e == 2 for e in ends[at : at + n - (not parts[1:])]):
                return None
            if (out := end(at + n, parts[1:])) is not None:
                return out
        return None

    out, at = [], 0
    while at < len(words):
        hit = next(((k, e) for v, k in known if (e := end(at, v))), None) if at == 0 or ends[at - 1] else None
        at = hit[1] if hit else at + 1
        out += [hit[0]] if hit else []
    return out


def follows(run, need):
    at = 0
    for x in run:
        at += at < len(need) and x == need[at]
    return at == len(need)


def brute(text):
    run, found = sentences(text), {}
    for name, licence, need in lic.RULES:
        never = {x[1:] for x in need if x[0] == "!"}
        stretches = [run]
        if never:
            starts = [i for i, x in enumerate(run) if x == need[0]] + [len(run)]
            stretches = [run[i:j] for i, j in zip(starts, starts[1:], strict=False)]
        if any(follows(r, [x for x in need if x[0] != "!"]) and not never & set(r) for r in stretches):
            found.setdefault(licence, name)
    return found


def compare(docs):
    got = {repr(r["doc_id"]): r for r in lic.scan(docs).collect()}
    for r in docs.collect():
        want = brute(r["text"])
        assert got[repr(r["doc_id"])]["licences"] == ",".join(want)
        assert got[repr(r["doc_id"])]["rules"] == ",".join(want.values())


def test_fixture(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    compare(docs)
    assert lic.scan(docs).where("licences <> ''").count() > 0


def test_wrapped_texts_order_and_odd_rows(spark, odd_docs, no_docs):
    mit = "Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files (the \"Software\"), to deal\nin the Software without restriction, including without limitation the rights\nto use, copy, modify, merge, publish, distribute, sublicense, and/or sell\ncopies of the Software, and to permit persons to whom the Software is\nfurnished to do so, subject to the following conditions:\n\nThe above copyright notice and this permission notice shall be included in all\ncopies or substantial portions of the Software.\n"
    rows = [(1, mit), (2, "x | y\nAll rights reserved.\nLicensed under CC BY-NC 4.0."), (3, "We do not say all rights reserved here"), (4, "ALL RIGHTS RESERVED")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    compare(docs)
    found = {r["doc_id"]: r["licences"] for r in lic.scan(docs).collect()}
    assert found == {1: "MIT", 2: "CC-BY-NC-4.0,Proprietary", 3: "", 4: "Proprietary"}
    compare(odd_docs)
    assert lic.scan(no_docs).count() == 0


MIT = """MIT License
{gap}Copyright (c) 2020 A. Writer
{gap}Permission is hereby granted, free of charge, to any person obtaining a copy
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
AUTHORS BE LIABLE FOR ANY CLAIM.
"""
GPL = """    demo
    Copyright (C) 2020  A. Writer

    This program is free software: you can redistribute it and/or modify
    it under the terms of the GNU General Public License as published by
    the Free Software Foundation, either version 3 of the License, or
    (at your option) any later version.

    This program is distributed in the hope that it will be useful,
    but WITHOUT ANY WARRANTY; without even the implied warranty of
    MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
    GNU General Public License for more details.
"""
APACHE = """   Copyright 2020 A. Writer

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
BSD = """Copyright (c) 2020, A. Writer
Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

{one} Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

{two} Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.
"""
MPL = """The contents of this file are subject to the Mozilla Public License
Version 1.1 (the "License"); you may not use this file except in
compliance with the License. You may obtain a copy of the License at
http://www.mozilla.org/MPL/
"""


BSD_NAME = """
3. Neither the name of the University of Somewhere nor the names of its
   contributors may be used to endorse or promote products derived from this
   software without specific prior written permission.
"""
BSD_ADVERT = """
3. All advertising materials mentioning features or use of this software must
   display the following acknowledgement:
   This product includes software developed by the University of Somewhere.
"""
MPL2 = """This Source Code Form is subject to the terms of the Mozilla Public
License, v. 2.0. If a copy of the MPL was not distributed with this
file, You can obtain one at https://mozilla.org/MPL/2.0/.
"""
GNU = """This {what} is free software; you can redistribute it and/or
modify it under the terms of the GNU {name}
License as published by the Free Software Foundation; either
version {version} of the License, or (at your option) any later version.

This {what} is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.
"""
GPL2_ONLY = """This program is free software; you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation; version 2 of the License.
"""
ISC = """Copyright (c) 2020 A. Writer

Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH
REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND
FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE.
"""
ZLIB = """This software is provided 'as-is', without any express or implied
warranty. In no event will the authors be held liable for any damages
arising from the use of this software.

Permission is granted to anyone to use this software for any purpose,
including commercial applications, and to alter it and redistribute it
freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not
   claim that you wrote the original software. If you use this software
   in a product, an acknowledgment would be appreciated.
2. Altered source versions must be plainly marked as such, and must not be
   misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution.
"""
UNLICENSE = """This is free and unencumbered software released into the public domain.

Anyone is free to copy, modify, publish, use, compile, sell, or
distribute this software, either in source code form or as a compiled
binary, for any purpose, commercial or non-commercial, and by any
means.
"""


def test_many_known_sentences_in_one_text(spark):
    text = "All rights reserved.\n" * 20_000 + (BSD + BSD_NAME).format(one="1.", two="2.") * 50
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    assert [tuple(r)[1:] for r in lic.scan(docs).select("doc_id", "n_sentences", "licences").collect()] == [(20_200, "BSD-3-Clause,Proprietary")]


def test_columns_of_any_name(spark):
    docs = spark.createDataFrame([(1, "MIT License", "a", "b", "c")], ["doc_id", "text", "known", "fit", "__t"])
    assert lic.scan(docs).first()["licences"] == "MIT"


def test_standard_texts(spark):
    texts = {
        "mit": (MIT.format(gap="\n"), "MIT", "mit-text"),
        "mit, no blank lines": (MIT.format(gap=""), "MIT", "mit-text"),
        "mit, windows": (MIT.format(gap="\n").replace("\n", "\r\n"), "MIT", "mit-text"),
        "mit, spaced": (MIT.format(gap="\n").replace("\n", "\n\n"), "MIT", "mit-text"),
        "gpl": (GPL, "GPL-3.0", "gpl3-header"),
        "gpl, comment": ("".join(f" * {x}\n" for x in GPL.split("\n")), "GPL-3.0", "gpl3-header"),
        "gpl, title": ("GNU GENERAL PUBLIC LICENSE\n   Version 3, 29 June 2007\n", "GPL-3.0", "gpl3-title"),
        "apache": (APACHE, "Apache-2.0", "apache2-header"),
        "apache, comment": ("".join(f"# {x}\n" for x in APACHE.split("\n") if x), "Apache-2.0", "apache2-header"),
        "apache, sentence": ('Licensed under the Apache License, Version 2.0 (the "License").', "Apache-2.0", "apache2-header-alone"),
        "apache, comply": (APACHE[APACHE.index("you may not") : APACHE.index("Unless")], "Apache-2.0", "apache2-comply"),
        "apache, file": ("Apache License\n  Version 2.0, January 2004\nhttp://www.apache.org/licenses/", "Apache-2.0", "apache2-title"),
        "bsd": (BSD.format(one="1.", two="2."), "BSD-2-Clause", "bsd-2-text"),
        "bsd, stars": (BSD.format(one="*", two="*"), "BSD-2-Clause", "bsd-2-text"),
        "bsd 3": (BSD.format(one="1.", two="2.") + BSD_NAME, "BSD-3-Clause", "bsd-3-text"),
        "bsd 3, then 2": ((BSD + BSD_NAME + BSD).format(one="1.", two="2."), "BSD-3-Clause,BSD-2-Clause", "bsd-3-text,bsd-2-text"),
        "bsd 4": (BSD.format(one="1.", two="2.") + BSD_ADVERT + BSD_NAME, "BSD-4-Clause", "bsd-4-text"),
        "mpl 2": (MPL2, "MPL-2.0", "mpl2-header-2"),
        "mpl 2, comment": ("".join(f"// {x}\n" for x in MPL2.split("\n")), "MPL-2.0", "mpl2-header-2"),
        "lgpl 2.1": (GNU.format(what="library", name="Lesser General Public", version="2.1"), "LGPL-2.1", "lgpl-2.1-library-0"),
        "lgpl 3": (GNU.format(what="program", name="Lesser General Public", version="3"), "LGPL-3.0", "lgpl-3.0-program-0"),
        "gpl 2": (GNU.format(what="program", name="General Public", version="2"), "GPL-2.0", "gpl-2.0-program-0"),
        "agpl": (GNU.format(what="program", name="Affero General Public", version="3"), "AGPL-3.0", "agpl-3.0-program-0"),
        "gpl 2 only": (GPL2_ONLY, "GPL-2.0", "gpl-2.0-program-1"),
        "gpl 2, title": ("GNU GENERAL PUBLIC LICENSE\n    Version 2, June 1991\n", "GPL-2.0", "gpl2-title"),
        "isc": (ISC, "ISC", "isc-text"),
        "zlib": (ZLIB, "Zlib", "zlib-text"),
        "unlicense": (UNLICENSE, "Unlicense", "unlicense-text"),
        "spdx": ("// SPDX-License-Identifier: MIT\nint main;", "MIT", "spdx-mit"),
        "spdx, hash": ("#!/bin/sh\n# SPDX-License-Identifier: GPL-2.0-or-later\n", "GPL-2.0", "spdx-gpl-2.0-or-later"),
        "spdx, c": ("/* SPDX-License-Identifier: BSD-3-Clause */\nint x;", "BSD-3-Clause", "spdx-bsd-3-clause"),
        "spdx, two": ("# SPDX-License-Identifier: MIT OR Apache-2.0\n", "", ""),
        "mit, title": ("MIT License\n\nsee below", "MIT", "mit-title"),
        "cc sa": ("This work is licensed under a Creative Commons\nAttribution-ShareAlike 4.0 International License.", "CC-BY-SA-4.0", "cc-by-sa-4.0-work"),
        "cc0": ("To the extent possible under law, A. Writer has waived all copyright and\nrelated or neighboring rights to this work.", "", ""),
        "cc0, one name": ("To the extent possible under law, Ada Writer has waived all copyright and\nrelated or neighboring rights to this work.", "CC0-1.0", "cc0-waived"),
        "cc": ("This work is licensed under a Creative Commons\nAttribution 4.0 International License.", "CC-BY-4.0", "cc-by-4-work"),
        "cc nc": ("Creative Commons Attribution-NonCommercial 4.0 International Public\nLicense\n\nBy", "CC-BY-NC-4.0", "cc-by-nc-4-title"),
        "mpl": (MPL, "", ""),
        "stop": ("All rights. Reserved.", "", ""),
    }
    docs = spark.createDataFrame([(k, t) for k, (t, _, _) in texts.items()], "doc_id string, text string")
    got = {r["doc_id"]: (r["licences"], r["rules"]) for r in lic.scan(docs).collect()}
    assert got == {k: (a, b) for k, (_, a, b) in texts.items()}
    compare(docs)
