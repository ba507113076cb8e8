"""Licence recognition by sentence rules.

Texts are normalised (A-Z lower-cased, every run of other characters than letters and digits
one space) and cut at full stops, and also at line ends, colons and semicolons. A known
sentence starts and ends at a cut of either kind and becomes its identifier. It may run over
line ends, colons and semicolons (licences are wrapped, titles stand above them without a full
stop), never over a full stop. A document is thus a short sequence of identifiers. Rules, in
order, name a licence and the identifiers that must follow each other in the sequence, unknown
sentences between them being allowed; the first rule of a licence that fits decides how it was
recognised.

A star in a known sentence stands for one to twelve words of the text's own (an owner's name).

Defined cases: a null or empty text has no sentence and no licence; repeated sentences count
each; equal rows give equal results; an empty table gives an empty result; a text of any length
is read whole, row by row; other columns are ignored, whatever their names. An SPDX line is
known if it holds one identifier; one with ``OR`` or ``AND`` isn't.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Known licence sentences, normalised.
SENTENCES = {
    "mit-notice": "released under the mit license",
    "mit-notice-2": "licensed under the mit license",
    "mit-grant": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",
    "mit-keep": "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    "as-is": "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement",
    "gpl3-notice": "this work is licensed under the gnu general public license version 3",
    "gpl-free": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "gpl-hope": "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose",
    "cc-by-nc-4-notice": "licensed under cc by nc 4 0",
    "cc-by-4-notice": "licensed under cc by 4 0",
    "gpl3-title": "gnu general public license version 3 29 june 2007",
    "cc-by-nc-4-title": "creative commons attribution noncommercial 4 0 international public license",
    "cc-by-nc-4-work": "this work is licensed under a creative commons attribution noncommercial 4 0 international license",
    "cc-by-4-title": "creative commons attribution 4 0 international public license",
    "cc-by-4-work": "this work is licensed under a creative commons attribution 4 0 international license",
    "apache2-title": "apache license version 2 0 january 2004",
    "apache2-copy": "you may obtain a copy of the license at http www apache org licenses license 2 0",
    "apache2-copy-2": "you may obtain a copy of the license at https www apache org licenses license 2 0",
    "apache2-notice": "licensed under the apache license version 2 0",
    "apache2-header": "licensed under the apache license version 2 0 the license",
    "apache2-comply": "you may not use this file except in compliance with the license",
    "apache2-basis": "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied",
    "bsd-grant": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "bsd-source": "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
    "bsd-binary": "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    "bsd-advert": "all advertising materials mentioning features or use of this software must display the following acknowledgement this product includes software developed by *",
    "bsd-name": "neither the name of * nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "bsd-name-2": "neither the name of * nor the names of * may be used to endorse or promote products derived from this software without specific prior written permission",
    "bsd-name-3": "the name of * may not be used to endorse or promote products derived from this software without specific prior written permission",
    "mit-liable": "in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software",
    "mit-title": "mit license",
    "mit-title-2": "the mit license",
    "mit-title-3": "the mit license mit",
    "lgpl-hope": "this library is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose",
    "gpl2-title": "gnu general public license version 2 june 1991",
    "lgpl2-title": "gnu lesser general public license version 2 1 february 1999",
    "lgpl3-title": "gnu lesser general public license version 3 29 june 2007",
    "agpl3-title": "gnu affero general public license version 3 19 november 2007",
    "mpl2-subject": "this source code form is subject to the terms of the mozilla public license v",
    "mpl2-copy": "if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2 0",
    "mpl2-copy-2": "if a copy of the mpl was not distributed with this file you can obtain one at https mozilla org mpl 2 0",
    "mpl2-title": "mozilla public license version 2 0",
    "isc-grant": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    "isc-grant-2": "permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    "zero-bsd-grant": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted",
    "isc-as-is": "the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness",
    "zlib-as-is": "this software is provided as is without any express or implied warranty",
    "zlib-liable": "in no event will the authors be held liable for any damages arising from the use of this software",
    "zlib-grant": "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions",
    "zlib-origin": "the origin of this software must not be misrepresented you must not claim that you wrote the original software",
    "zlib-altered": "altered source versions must be plainly marked as such and must not be misrepresented as being the original software",
    "zlib-notice": "this notice may not be removed or altered from any source distribution",
    "unlicense-free": "this is free and unencumbered software released into the public domain",
    "unlicense-anyone": "anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means",
    "cc0-title": "cc0 1 0 universal",
    "cc0-waived": "to the extent possible under law * has waived all copyright and related or neighboring rights to *",
    "boost-title": "boost software license version 1 0 august 17th 2003",
    "boost-notice": "distributed under the boost software license version 1 0",
    "epl2-notice": "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0 which is available at https www eclipse org legal epl 2 0",
    "all-rights": "all rights reserved",
}
#: Identifiers of a ``SPDX-License-Identifier`` line and what they are called here.
SPDX = {
    "MIT": "MIT", "Apache-2.0": "Apache-2.0", "BSD-2-Clause": "BSD-2-Clause", "BSD-3-Clause": "BSD-3-Clause", "BSD-4-Clause": "BSD-4-Clause",
    "GPL-2.0": "GPL-2.0", "GPL-2.0-only": "GPL-2.0", "GPL-2.0-or-later": "GPL-2.0", "GPL-2.0 WITH Linux-syscall-note": "GPL-2.0",
    "GPL-3.0": "GPL-3.0", "GPL-3.0-only": "GPL-3.0", "GPL-3.0-or-later": "GPL-3.0", "LGPL-2.1": "LGPL-2.1", "LGPL-2.1-only": "LGPL-2.1",
    "LGPL-2.1-or-later": "LGPL-2.1", "LGPL-3.0": "LGPL-3.0", "LGPL-3.0-only": "LGPL-3.0", "LGPL-3.0-or-later": "LGPL-3.0", "AGPL-3.0": "AGPL-3.0",
    "AGPL-3.0-only": "AGPL-3.0", "AGPL-3.0-or-later": "AGPL-3.0", "MPL-2.0": "MPL-2.0", "ISC": "ISC", "0BSD": "0BSD", "Zlib": "Zlib",
    "Unlicense": "Unlicense", "CC0-1.0": "CC0-1.0", "CC-BY-4.0": "CC-BY-4.0", "CC-BY-SA-4.0": "CC-BY-SA-4.0", "CC-BY-NC-4.0": "CC-BY-NC-4.0",
    "BSL-1.0": "BSL-1.0", "EPL-2.0": "EPL-2.0",
}
#: The GNU licences: the name in their notices, the version, and what they are called here.
GNU = (
    ("gnu general public license", "2", "GPL-2.0"),
    ("gnu general public license", "3", "GPL-3.0"),
    ("gnu lesser general public license", "2 1", "LGPL-2.1"),
    ("gnu lesser general public license", "3", "LGPL-3.0"),
    ("gnu affero general public license", "3", "AGPL-3.0"),
)
#: How a one-line notice names a licence.
NOTICES = {
    "bsd 2 clause license": "BSD-2-Clause", "bsd 3 clause license": "BSD-3-Clause", "isc license": "ISC", "zlib license": "Zlib",
    "mozilla public license 2 0": "MPL-2.0", "mozilla public license version 2 0": "MPL-2.0", "boost software license": "BSL-1.0",
    "gnu general public license version 2": "GPL-2.0", "gnu general public license version 3": "GPL-3.0", "gnu gplv2": "GPL-2.0", "gnu gplv3": "GPL-3.0",
    "gnu lesser general public license version 3": "LGPL-3.0", "gnu affero general public license version 3": "AGPL-3.0",
}
#: Creative Commons licences beside plain attribution and non-commercial use.
COMMONS = {"sharealike": "CC-BY-SA-4.0", "noderivatives": "CC-BY-ND-4.0", "noncommercial sharealike": "CC-BY-NC-SA-4.0", "noncommercial noderivatives": "CC-BY-NC-ND-4.0"}


def _plain(name: str) -> str:
    return "".join(c if c.isalnum() else " " for c in name.lower())


def _families() -> list[tuple[str, str, str]]:
    """Rule, licence and sentence of what is made from names and versions."""
    made = [(f"spdx-{name}".replace(" ", "-").lower(), licence, f"spdx license identifier {_plain(name)}") for name, licence in SPDX.items()]
    for family, version, licence in GNU:
        for what in ("program", "library", "file", "software"):
            for n, clause in enumerate((f"either version {version} of the license or at your option any later version", f"version {version} of the license", f"version {version}")):
                terms = f"this {what} is free software you can redistribute it and or modify it under the terms of the {family} as published by the free software foundation {clause}"
                made.append((f"{licence}-{what}-{n}".lower(), licence, terms))
    made += [(f"{verb}-{name}".replace(" ", "-"), licence, f"{verb} under the {name}") for name, licence in NOTICES.items() for verb in ("licensed", "released", "distributed")]
    for parts, licence in COMMONS.items():
        named = f"creative commons attribution {parts} 4 0 international"
        made += [(f"{licence}-title".lower(), licence, f"{named} public license"), (f"{licence}-work".lower(), licence, f"this work is licensed under a {named} license")]
        made.append((f"{licence}-notice".lower(), licence, f"licensed under {_plain(licence)}"))
    known = set(SENTENCES.values())
    return [x for x in made if x[2] not in known]


FAMILIES = _families()
SENTENCES |= {name: sentence for name, _, sentence in FAMILIES}
#: Rules in order: name, licence, identifiers in sequence. ``!x`` says that ``x``
#: doesn't follow before the rule's first identifier comes again.
RULES = (
    ("mit-text", "MIT", ("mit-grant", "mit-keep", "as-is")),
    ("mit-short-text", "MIT", ("mit-grant",)),
    ("mit-notice", "MIT", ("mit-notice",)),
    ("mit-notice-2", "MIT", ("mit-notice-2",)),
    ("gpl3-header", "GPL-3.0", ("gpl-free", "gpl-hope")),
    ("gpl3-free", "GPL-3.0", ("gpl-free",)),
    ("gpl3-notice", "GPL-3.0", ("gpl3-notice",)),
    ("gpl3-title", "GPL-3.0", ("gpl3-title",)),
    ("cc-by-nc-4-notice", "CC-BY-NC-4.0", ("cc-by-nc-4-notice",)),
    ("cc-by-nc-4-title", "CC-BY-NC-4.0", ("cc-by-nc-4-title",)),
    ("cc-by-nc-4-work", "CC-BY-NC-4.0", ("cc-by-nc-4-work",)),
    ("cc-by-4-notice", "CC-BY-4.0", ("cc-by-4-notice",)),
    ("cc-by-4-title", "CC-BY-4.0", ("cc-by-4-title",)),
    ("cc-by-4-work", "CC-BY-4.0", ("cc-by-4-work",)),
    ("apache2-header", "Apache-2.0", ("apache2-header", "apache2-comply", "apache2-basis")),
    ("apache2-short", "Apache-2.0", ("apache2-comply", "apache2-basis")),
    ("apache2-notice", "Apache-2.0", ("apache2-notice",)),
    ("apache2-header-alone", "Apache-2.0", ("apache2-header",)),
    ("apache2-comply", "Apache-2.0", ("apache2-comply", "apache2-copy")),
    ("apache2-comply-2", "Apache-2.0", ("apache2-comply", "apache2-copy-2")),
    ("apache2-title", "Apache-2.0", ("apache2-title",)),
    ("bsd-4-text", "BSD-4-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-advert")),
    *[(f"bsd-3-text{n}", "BSD-3-Clause", ("bsd-grant", "!bsd-advert", "bsd-source", "bsd-binary", f"bsd-name{n}")) for n in ("", "-2", "-3")],
    ("bsd-2-text", "BSD-2-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "!bsd-name", "!bsd-name-2", "!bsd-name-3", "!bsd-advert")),
    ("bsd-text", "BSD", ("bsd-grant", "!bsd-binary")),
    *[(f"mit-title{n}", "MIT", (f"mit-title{n}",)) for n in ("", "-2", "-3")],
    ("gpl2-title", "GPL-2.0", ("gpl2-title",)),
    ("lgpl2-title", "LGPL-2.1", ("lgpl2-title",)),
    ("lgpl3-title", "LGPL-3.0", ("lgpl3-title",)),
    ("agpl3-title", "AGPL-3.0", ("agpl3-title",)),
    ("mpl2-header", "MPL-2.0", ("mpl2-subject", "mpl2-copy")),
    ("mpl2-header-2", "MPL-2.0", ("mpl2-subject", "mpl2-copy-2")),
    ("mpl2-title", "MPL-2.0", ("mpl2-title",)),
    ("isc-text", "ISC", ("isc-grant", "isc-as-is")),
    ("isc-grant", "ISC", ("isc-grant",)),
    ("isc-grant-2", "ISC", ("isc-grant-2",)),
    ("zero-bsd-text", "0BSD", ("zero-bsd-grant",)),
    ("zlib-text", "Zlib", ("zlib-grant", "zlib-origin", "zlib-altered", "zlib-notice")),
    ("zlib-grant", "Zlib", ("zlib-grant",)),
    ("unlicense-text", "Unlicense", ("unlicense-free", "unlicense-anyone")),
    ("unlicense-free", "Unlicense", ("unlicense-free",)),
    ("cc0-title", "CC0-1.0", ("cc0-title",)),
    ("cc0-waived", "CC0-1.0", ("cc0-waived",)),
    ("boost-title", "BSL-1.0", ("boost-title",)),
    ("boost-notice", "BSL-1.0", ("boost-notice",)),
    ("epl2-notice", "EPL-2.0", ("epl2-notice",)),
    *[(name, licence, (name,)) for name, licence, _ in FAMILIES],
    ("reserved", "Proprietary", ("all-rights",)),
)
#: Every known sentence has one of these, so a text without any is done.
ANCHOR = r"(?i)licen[sc]e|permission|copyright|software|program|redistribution|rights|cc0|gplv"
#: In order: signs inside a word, other characters, soft cuts (``|``), full stops (``.``).
STEPS = (
    (r"[.!?;:](?=[^\x20\x09-\x0D])", " "),
    (r"[^a-z0-9.!?;:\n\r]+", " "),
    (r"\x20?[;:\n\r][\x20;:\n\r]*+", "|"),
    (r"[\x20|]?[.!?][\x20|.!?]*+", "."),
)
#: What ``*`` in a known sentence stands for: 1 to 12 words.
_SLOT = "[a-z0-9]+(?:[ |][a-z0-9]+){0,11}?"


def _pattern(sentence: str) -> str:
    return sentence.replace(" ", "[ |]").replace("*", _SLOT)


#: Any known sentence between cuts, the longest first.
KNOWN = "(?<=[|.])(?:" + "|".join(_pattern(s) for s in sorted(SENTENCES.values(), key=len, reverse=True)) + ")(?=[|.])"
#: Known sentences with words of the text's own, as patterns of one group each, and their identifiers.
OPEN = [(name, f"^{_pattern(s)}$") for name, s in SENTENCES.items() if "*" in s]


def identifiers(text: Column) -> Column:
    """The known sentences of a text, in order."""
    names, known = list(SENTENCES), list(SENTENCES.values())
    plain = F.concat(F.lit("\n"), F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit("\n"))
    for pattern, to in STEPS:
        plain = F.regexp_replace(plain, pattern, to)
    found = F.transform(F.regexp_extract_all(plain, F.lit(KNOWN), F.lit(0)), lambda s: F.translate(s, "|", " "))

    def name(s: Column) -> Column:
        exact = F.get(F.array(*map(F.lit, names)), F.array_position(F.array(*map(F.lit, known)), s).cast("int") - 1)
        return F.coalesce(exact, *[F.when(s.rlike(pattern), n) for n, pattern in OPEN])

    return F.transform(found, name)


def _fits(sequence: Column, needed: tuple[str, ...]) -> Column:
    """Whether the identifiers follow each other in the sequence; with ``!x``, in a stretch from
    one of the first to the next of them that holds no ``x``."""
    whole = F.concat(F.lit(","), F.array_join(sequence, ",,"), F.lit(","))
    order = lambda part, ids: part.rlike(".*".join(f",{x}," for x in ids)) if ids else F.lit(True)
    never = [f",{x[1:]}," for x in needed if x[0] == "!"]
    if not never:
        return order(whole, needed)
    rest = [x for x in needed[1:] if x[0] != "!"]
    stretches = F.split(whole, f",{needed[0]},")
    fits = lambda part: order(part, rest) & ~F.exists(F.array(*map(F.lit, never)), lambda x: part.contains(x))
    return F.exists(F.slice(stretches, F.lit(2), F.size(stretches)), fits)


def fitting(sequence: Column) -> Column:
    """The rules that fit a sequence, in their order: those of one identifier are looked up."""
    entry = lambda at, licence, name: F.struct(F.lit(at).alias("at"), F.lit(licence).alias("licence"), F.lit(name).alias("rule"))
    single = F.array(*[F.struct(entry(at, lic, name).alias("is"), F.lit(need[0]).alias("need")) for at, (name, lic, need) in enumerate(RULES) if len(need) == 1])
    looked = F.transform(F.filter(single, lambda r: F.array_contains(sequence, r["need"])), lambda r: r["is"])
    several = F.array(*[F.when(_fits(sequence, need), entry(at, lic, name)) for at, (name, lic, need) in enumerate(RULES) if len(need) > 1])
    return F.array_sort(F.concat(looked, F.filter(several, lambda r: r.isNotNull())))


def scan(docs: DataFrame) -> DataFrame:
    """``doc_id, n_sentences, sentences, licences, rules`` of every document."""
    text = F.coalesce("text", F.lit(""))
    none = F.array().cast("array<string>")
    df = docs.select("doc_id", F.when(text.rlike(ANCHOR), text).otherwise(F.lit("")).alias("__t"))
    df = df.select("doc_id", F.when(F.col("__t") != "", identifiers(F.col("__t"))).otherwise(none).alias("known"))
    df = df.withColumn("fit", F.when(F.size("known") > 0, fitting(F.col("known"))).otherwise(F.array().cast("array<struct<at:int,licence:string,rule:string>>")))
    df = df.withColumn("found", F.array_distinct(F.transform("fit", lambda r: r["licence"])))
    first = F.transform("found", lambda x: F.element_at(F.filter("fit", lambda r: r["licence"] == x), 1)["rule"])
    return df.select(
        "doc_id",
        F.size("known").cast("long").alias("n_sentences"),
        F.array_join("known", ",").alias("sentences"),
        F.array_join("found", ",").alias("licences"),
        F.array_join(first, ",").alias("rules"),
    )
