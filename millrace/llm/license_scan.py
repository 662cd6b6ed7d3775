"""Licence scan by sentence rules, in DataFrame expressions alone.

A text is cut into sentences, each normalised and looked up among known licence sentences; a known one becomes a character of
its own, any other a dot. Ordered rules (sequences of identifiers) are then matched on that string, the
most specific first; a match uses its sentences up.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Identifiers and texts of licence sentences, as published with the licences or used to refer to them.
SENTENCES = {
    "mit-ref": "Released under the MIT License.",
    "mit-ref2": "Licensed under the MIT License.",
    "mit-name": "The MIT License (MIT)",
    "mit-name2": "MIT License",
    "mit-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    "mit-notice": "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "as-is": "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.",
    "apache-ref": "Licensed under the Apache License, Version 2.0.",
    "apache-ref2": "Licensed under the Apache License, Version 2.0 (the \"License\");",
    "apache-may": "you may not use this file except in compliance with the License.",
    "apache-copy": "You may obtain a copy of the License at",
    "gpl3-ref": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-hope": "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    "gpl-see": "See the GNU General Public License for more details.",
    "bsd-redist": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "bsd-source": "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "bsd-binary": "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "bsd-names": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "cc-by-nc-ref": "Licensed under CC BY-NC 4.0.",
    "cc-by-ref": "Licensed under CC BY 4.0.",
    "cc-by-sa-ref": "Licensed under CC BY-SA 4.0.",
    "cc0-ref": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "isc-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "mpl-ref": "This Source Code Form is subject to the terms of the Mozilla Public License, v.",
    "reserved": "All rights reserved.",
    "apache-unless": "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    "apache-see": "See the License for the specific language governing permissions and limitations under the License.",
    "apache-terms": "TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION",
    "apache-title": "Apache License, Version 2.0",
    "mit-liable": "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "mit0-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so.",
    "x11-names": "Except as contained in this notice, the name of the X Consortium shall not be used in advertising or otherwise to promote the sale, use or other dealings in this Software without prior written authorization from the X Consortium.",
    "bsd-disclaimer": "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.",
    "bsd-advert": "All advertising materials mentioning features or use of this software must display the following acknowledgement:",
    "bsd2-ref": "Licensed under the BSD 2-Clause License.",
    "bsd3-ref": "Licensed under the BSD 3-Clause License.",
    "bsd3-title": "BSD 3-Clause License",
    "bsd2-title": "BSD 2-Clause License",
    "0bsd-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.",
    "isc-ref": "Licensed under the ISC License.",
    "gpl2-b": "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation;",
    "gpl3-b": "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "gpl-a": "This program is free software:",
    "gpl2-c": "either version 2 of the License, or (at your option) any later version.",
    "gpl2-ref": "This work is licensed under the GNU General Public License, version 2.",
    "gpl-title": "GNU GENERAL PUBLIC LICENSE",
    "gpl-v3": "Version 3, 29 June 2007",
    "gpl-v2": "Version 2, June 1991",
    "lgpl-a": "This library is free software;",
    "lgpl21-b": "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation;",
    "lgpl21-c": "either version 2.1 of the License, or (at your option) any later version.",
    "lgpl3-ref": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "lgpl-title": "GNU LESSER GENERAL PUBLIC LICENSE",
    "agpl-b": "you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "agpl-ref": "This work is licensed under the GNU Affero General Public License, version 3.",
    "agpl-title": "GNU AFFERO GENERAL PUBLIC LICENSE",
    "gfdl-grant": "Permission is granted to copy, distribute and/or modify this document under the terms of the GNU Free Documentation License, Version 1.3 or any later version published by the Free Software Foundation;",
    "mpl-copy": "If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "mpl-title": "Mozilla Public License Version 2.0",
    "epl-ref": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",
    "epl-title": "Eclipse Public License - v 2.0",
    "boost-ref": "Distributed under the Boost Software License, Version 1.0.",
    "boost-title": "Boost Software License - Version 1.0 - August 17th, 2003",
    "unlicense-a": "This is free and unencumbered software released into the public domain.",
    "unlicense-b": "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    "zlib-a": "This software is provided 'as-is', without any express or implied warranty.",
    "zlib-b": "In no event will the authors be held liable for any damages arising from the use of this software.",
    "zlib-c": "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:",
    "wtfpl": "DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE",
    "cc0-title": "CC0 1.0 Universal",
    "cc0-ref2": "Released under CC0 1.0.",
    "cc-by-nd-ref": "Licensed under CC BY-ND 4.0.",
    "cc-by-nc-sa-ref": "Licensed under CC BY-NC-SA 4.0.",
    "cc-by-nc-nd-ref": "Licensed under CC BY-NC-ND 4.0.",
    "cc-by-long": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-sa-long": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "cc-by-nc-long": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    "cc-by-nd-long": "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.",
    "cc-by-nc-sa-long": "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License.",
    "cc-by-nc-nd-long": "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License.",
    "public-domain": "This work is in the public domain.",
    "artistic-title": "The Artistic License 2.0",
    "cddl-title": "COMMON DEVELOPMENT AND DISTRIBUTION LICENSE (CDDL) Version 1.0",
    "psf-title": "PYTHON SOFTWARE FOUNDATION LICENSE VERSION 2",
}


@dataclass(frozen=True)
class Rule:
    licence: str
    sequence: tuple[str, ...]


#: Rules in order, the more specific first: a rule takes its sentences before any later one sees them.
RULES = (
    Rule("BSD-4-Clause", ("bsd-redist", "bsd-source", "bsd-binary", "bsd-advert")),
    Rule("BSD-3-Clause", ("bsd-redist", "bsd-source", "bsd-binary", "bsd-names", "bsd-disclaimer")),
    Rule("BSD-3-Clause", ("bsd-redist", "bsd-source", "bsd-binary", "bsd-names")),
    Rule("BSD-2-Clause", ("bsd-redist", "bsd-source", "bsd-binary", "bsd-disclaimer")),
    Rule("BSD-2-Clause", ("bsd-redist", "bsd-source", "bsd-binary")),
    Rule("X11", ("mit-grant", "mit-notice", "as-is", "x11-names")),
    Rule("MIT", ("mit-grant", "mit-notice", "as-is", "mit-liable")),
    Rule("MIT", ("mit-grant", "mit-notice", "as-is")),
    Rule("MIT", ("mit-grant", "mit-notice")),
    Rule("MIT-0", ("mit0-grant", "as-is")),
    Rule("GPL-3.0-or-later", ("gpl-a", "gpl3-b", "gpl-hope", "gpl-see")),
    Rule("GPL-2.0-or-later", ("gpl-a", "gpl2-b", "gpl2-c")),
    Rule("LGPL-2.1-or-later", ("lgpl-a", "lgpl21-b", "lgpl21-c")),
    Rule("AGPL-3.0-or-later", ("gpl-a", "agpl-b")),
    Rule("GPL-3.0-or-later", ("gpl-a", "gpl3-b")),
    Rule("GPL-3.0", ("gpl-title", "gpl-v3")),
    Rule("GPL-2.0", ("gpl-title", "gpl-v2")),
    Rule("LGPL-3.0", ("lgpl-title", "gpl-v3")),
    Rule("AGPL-3.0", ("agpl-title",)),
    Rule("Apache-2.0", ("apache-ref2", "apache-may", "apache-copy", "apache-unless", "apache-see")),
    Rule("Apache-2.0", ("apache-ref2", "apache-may", "apache-copy")),
    Rule("Apache-2.0", ("apache-title", "apache-terms")),
    Rule("Apache-2.0", ("apache-ref2",)),
    Rule("Apache-2.0", ("apache-ref",)),
    Rule("Apache-2.0", ("apache-title",)),
    Rule("GPL-3.0", ("gpl3-ref",)),
    Rule("GPL-2.0", ("gpl2-ref",)),
    Rule("LGPL-3.0", ("lgpl3-ref",)),
    Rule("AGPL-3.0", ("agpl-ref",)),
    Rule("GFDL-1.3-or-later", ("gfdl-grant",)),
    Rule("MIT", ("mit-ref",)),
    Rule("MIT", ("mit-ref2",)),
    Rule("MIT", ("mit-name",)),
    Rule("MIT", ("mit-name2",)),
    Rule("BSD-2-Clause", ("bsd2-ref",)),
    Rule("BSD-2-Clause", ("bsd2-title",)),
    Rule("BSD-3-Clause", ("bsd3-ref",)),
    Rule("BSD-3-Clause", ("bsd3-title",)),
    Rule("CC-BY-NC-4.0", ("cc-by-nc-ref",)),
    Rule("CC-BY-SA-4.0", ("cc-by-sa-ref",)),
    Rule("CC-BY-4.0", ("cc-by-ref",)),
    Rule("CC-BY-ND-4.0", ("cc-by-nd-ref",)),
    Rule("CC-BY-NC-SA-4.0", ("cc-by-nc-sa-ref",)),
    Rule("CC-BY-NC-ND-4.0", ("cc-by-nc-nd-ref",)),
    Rule("CC-BY-4.0", ("cc-by-long",)),
    Rule("CC-BY-SA-4.0", ("cc-by-sa-long",)),
    Rule("CC-BY-NC-4.0", ("cc-by-nc-long",)),
    Rule("CC-BY-ND-4.0", ("cc-by-nd-long",)),
    Rule("CC-BY-NC-SA-4.0", ("cc-by-nc-sa-long",)),
    Rule("CC-BY-NC-ND-4.0", ("cc-by-nc-nd-long",)),
    Rule("CC0-1.0", ("cc0-ref",)),
    Rule("CC0-1.0", ("cc0-ref2",)),
    Rule("CC0-1.0", ("cc0-title",)),
    Rule("ISC", ("isc-grant",)),
    Rule("ISC", ("isc-ref",)),
    Rule("0BSD", ("0bsd-grant",)),
    Rule("MPL-2.0", ("mpl-ref", "mpl-copy")),
    Rule("MPL-2.0", ("mpl-ref",)),
    Rule("MPL-2.0", ("mpl-title",)),
    Rule("EPL-2.0", ("epl-ref",)),
    Rule("EPL-2.0", ("epl-title",)),
    Rule("BSL-1.0", ("boost-ref",)),
    Rule("BSL-1.0", ("boost-title",)),
    Rule("Unlicense", ("unlicense-a", "unlicense-b")),
    Rule("Unlicense", ("unlicense-a",)),
    Rule("Zlib", ("zlib-a", "zlib-b", "zlib-c")),
    Rule("WTFPL", ("wtfpl",)),
    Rule("Artistic-2.0", ("artistic-title",)),
    Rule("CDDL-1.0", ("cddl-title",)),
    Rule("PSF-2.0", ("psf-title",)),
    Rule("public-domain", ("public-domain",)),
    Rule("all-rights-reserved", ("reserved",)),
)
#: Unknown sentences that may stand between two of a rule's.
GAP = 1


@dataclass(frozen=True)
class Licences:
    """Sentences by name, and ordered rules over them. Sentences become characters from first on, in order."""

    sentences: dict[str, str]
    rules: tuple[Rule, ...]
    gap: int = GAP

    @property
    def first(self) -> int:
        """A private use area that has room."""
        return 0xE000 if len(self.sentences) <= 6400 else 0xF0000

    def codes(self) -> dict[str, str]:
        return {name: chr(self.first + i) for i, name in enumerate(self.sentences)}

    def known(self) -> str:
        return f"[{chr(self.first)}-{chr(self.first + len(self.sentences) - 1)}]"

    def pattern(self, rule: Rule) -> str:
        code = self.codes()
        return rf"\.{{0,{self.gap}}}".join(code[s] for s in rule.sequence)

    def with_texts(self, texts: dict[str, str], opening: int = 3) -> Licences:
        """Rules of these and of whole licences (name to text) besides: the longest sequence first, each the licence's whole text or its opening sentences.

        Sentences that several texts share are one. A text without sentences gives no rule.
        """
        names = {_plain(t): n for n, t in self.sentences.items()}
        added, whole, open_ = dict(self.sentences), [], []
        for licence, text in texts.items():
            plain = [s for s in map(_plain, re.split(r"(?<=[.!?;:])[ \t\r\f\x0b]+|[\n\r]+", text)) if s]
            for s in plain:
                if s not in names:
                    names[s] = f"t{len(added)}"
                    added[names[s]] = s
            sequence = tuple(names[s] for s in plain)
            whole += [Rule(licence, sequence)] * bool(sequence)
            open_ += [Rule(licence, sequence[:opening])] * (len(sequence) > opening)
        rules = sorted([*whole, *open_, *self.rules], key=lambda r: -len(r.sequence))
        return Licences(added, tuple(rules), self.gap)


def _plain(text: str) -> str:
    """What normalised() gives, for the fixed sentences."""
    return re.sub(r"[^a-z0-9]+", " ", re.sub(r"[A-Z]", lambda m: m[0].lower(), text)).strip(" ")


def sentences(text: Column) -> Column:
    """Sentences end at a line feed, or at . ! ? ; or : before white space."""
    return F.split(text, r"(?<=[.!?;:])[ \t\r\f\u000B]+|[\n\r]+")


def normalised(sentence: Column) -> Column:
    """A-Z lowered, runs of anything but a-z and 0-9 one space, trimmed."""
    lowered = F.translate(sentence, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.trim(F.regexp_replace(lowered, "[^a-z0-9]+", " "))


#: What is recognised where nothing else is asked for.
DEFAULT = Licences(SENTENCES, RULES)
FIRST = DEFAULT.first
pattern = DEFAULT.pattern


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", licences: Licences = DEFAULT) -> DataFrame:
    """One row per input row: id, n_sentences, n_known, licenses (array, distinct, sorted), n_matches, first_sentence (from 0; null without one).

    Null and empty texts have no sentences and no licences. Repeated rows and ids are scanned each; an empty table gives an
    empty result. Other columns are not read. licences: sentences and rules, as many as one likes.
    """
    code = licences.codes()
    known = {_plain(text): code[name] for name, text in licences.sentences.items()}
    table = F.create_map(*[F.lit(x) for pair in known.items() for x in pair])
    shortest, longest = min(map(len, known)), max(map(len, known))
    cut = F.filter(sentences(F.coalesce(F.col(text_col), F.lit(""))), lambda s: F.regexp_like(s, F.lit(r"[^\x20\x09-\x0D]")))
    # punctuation and case only shrink a sentence, to a known length at least
    plain = F.transform(cut, lambda s: F.when(F.length(s) >= shortest, normalised(s)).otherwise(""))
    # a hash set tells known ones first: the map is a list
    one = lambda s: F.when((F.length(s) <= longest) & s.isin(*known), F.element_at(table, s)).otherwise(".")
    coded = docs.select(F.col(id_col), F.size(cut).alias("n_sentences"), F.array_join(F.transform(plain, one), "").alias("codes"))
    coded = coded.withColumn("n_known", F.regexp_count("codes", F.lit(licences.known())))
    rules = F.array(*[F.struct(*[F.lit(x).alias(n) for n, x in (("first", code[r.sequence[0]]), ("pattern", licences.pattern(r)), ("used", "." * len(r.sequence)), ("licence", r.licence))]) for r in licences.rules])
    start = F.struct(F.col("codes").alias("left"), F.array().cast("array<string>").alias("licences"), F.lit(0).alias("n"))

    def step(acc: Column, rule: Column) -> Column:
        n = F.regexp_count(acc["left"], rule["pattern"])
        taken = F.struct(F.regexp_replace(acc["left"], rule["pattern"], rule["used"]).alias("left"), F.array_append(acc["licences"], rule["licence"]).alias("licences"), (acc["n"] + n).alias("n"))
        return F.when(F.contains(acc["left"], rule["first"]) & (n > 0), taken).otherwise(acc)

    # rules are tried where their first sentence stands, which few texts have
    found = F.when(F.col("n_known") > 0, F.aggregate(F.filter(rules, lambda r: F.contains(F.col("codes"), r["first"])), start, step))
    coded = coded.withColumn("found", found)
    first = F.regexp_instr("codes", F.lit(licences.known())) - 1
    licenses = F.coalesce(F.array_sort(F.array_distinct("found.licences")), F.array().cast("array<string>"))
    return coded.select(F.col(id_col), "n_sentences", "n_known", licenses.alias("licenses"), F.coalesce("found.n", F.lit(0)).alias("n_matches"), F.when(first >= 0, first).alias("first_sentence"))
