"""Operator 4, licence scans: sentence rules.

A text is cut into sentences, each is normalised (lower case, letters and digits only, years and holders of copyright
lines cut off, names of holders and programs inside a sentence replaced by the usual ones) and looked up among known licence sentences. What remains of a text is a sequence of sentence numbers;
licence rules are ordered sequences of them. A rule matches where its sentences follow one another with at most GAP
other sentences between two; longer rules go first, and a sentence serves one match.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from offerlens.llm import common

GAP = 2
JOINED = 4

# Sentences of public licence texts and notices, as identifier: text.
SENTENCES = {
    "apache2-notice": "Licensed under the Apache License, Version 2.0",
    "apache2-notice-the": 'Licensed under the Apache License, Version 2.0 (the "License")',
    "apache2-compliance": "you may not use this file except in compliance with the License",
    "apache2-copy": "You may obtain a copy of the License at",
    "apache2-as-is": 'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied',
    "apache2-see": "See the License for the specific language governing permissions and limitations under the License",
    "mit-notice": "Released under the MIT License",
    "mit-notice-licensed": "Licensed under the MIT License",
    "mit-title": "The MIT License (MIT)",
    "mit-title-short": "MIT License",
    "mit-grant": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions',
    "mit-include": "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software",
    "mit-as-is": 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT',
    "mit-liability": "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE",
    "isc-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies",
    "isc-as-is": 'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS',
    "bsd-grant": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "bsd-source": "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer",
    "bsd-binary": "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution",
    "bsd-endorse": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "bsd-as-is": 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED',
    "gpl3-notice": "This work is licensed under the GNU General Public License, version 3",
    "gpl2-notice": "This work is licensed under the GNU General Public License, version 2",
    "gpl2-later": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version",
    "gpl3-later": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    "lgpl21-later": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version",
    "gpl-hope": "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE",
    "gpl-see": "See the GNU General Public License for more details",
    "mpl2-notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
    "mpl2-copy": "If a copy of the MPL was not distributed with this file, You can obtain one at",
    "unlicense-release": "This is free and unencumbered software released into the public domain",
    "unlicense-anyone": "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means",
    "cc-by-4": "Licensed under CC BY 4.0",
    "cc-by-sa-4": "Licensed under CC BY-SA 4.0",
    "cc-by-nc-4": "Licensed under CC BY-NC 4.0",
    "cc-by-nd-4": "Licensed under CC BY-ND 4.0",
    "cc-by-nc-sa-4": "Licensed under CC BY-NC-SA 4.0",
    "cc-by-4-long": "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "cc-by-sa-4-long": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License",
    "cc0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work",
    "bsd-advert": "All advertising materials mentioning features or use of this software must display the following acknowledgement",
    "bsd-advert-us": "All advertising materials mentioning features or use of this software must display the following acknowledgment",
    "isc-grant-and": "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies",
    "0bsd-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
    "apache2-title": "Apache License Version 2.0, January 2004",
    "apache2-title-at": "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/",
    "gpl2-title": "GNU GENERAL PUBLIC LICENSE Version 2, June 1991",
    "gpl3-title": "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007",
    "lgpl21-title": "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999",
    "lgpl3-title": "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007",
    "agpl3-title": "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007",
    "gpl2-only": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation",
    "gpl2-only-comma": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; version 2 of the License",
    "gpl3-only": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License version 3 as published by the Free Software Foundation",
    "gpl3-only-comma": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, version 3 of the License",
    "lgpl3-later": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    "agpl3-later": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    "agpl3-only": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, version 3 of the License",
    "agpl3-only-version": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License version 3 as published by the Free Software Foundation",
    "lgpl-see": "See the GNU Lesser General Public License for more details",
    "agpl-see": "See the GNU Affero General Public License for more details",
    "epl1-title": "Eclipse Public License - v 1.0",
    "epl2-title": "Eclipse Public License - v 2.0",
    "epl1-notice": "This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0 which accompanies this distribution, and is available at http://www.eclipse.org/legal/epl-v10.html",
    "epl2-notice": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",
    "epl2-notice-v": "This program and the accompanying materials are made available under the terms of the Eclipse Public License v2.0 which accompanies this distribution, and is available at https://www.eclipse.org/legal/epl-v20.html",
    "zlib-as-is": "This software is provided 'as-is', without any express or implied warranty",
    "zlib-liable": "In no event will the authors be held liable for any damages arising from the use of this software",
    "zlib-grant": "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions",
    "artistic2-title": "The Artistic License 2.0",
    "artistic2-notice": "Licensed under the Artistic License 2.0",
    "artistic1-title": 'The "Artistic License"',
    "artistic1-preamble": "The intent of this document is to state the conditions under which a Package may be copied, such that the Copyright Holder maintains some semblance of artistic control over the development of the package, while giving the users of the package the right to use and distribute the Package in a more-or-less customary fashion, plus the right to make reasonable modifications",
    "wtfpl-title": "DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE Version 2, December 2004",
    "wtfpl-title-short": "DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE",
    "wtfpl-notice": "You can redistribute it and/or modify it under the terms of the Do What The Fuck You Want To Public License, Version 2, as published by Sam Hocevar",
    "bsl-title": "Boost Software License - Version 1.0 - August 17th, 2003",
    "bsl-notice": "Distributed under the Boost Software License, Version 1.0",
    "cc-by-nc-nd-4": "Licensed under CC BY-NC-ND 4.0",
    "cc-by-nc-4-long": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License",
    "cc-by-nd-4-long": "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License",
    "cc-by-nc-sa-4-long": "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License",
    "cc-by-nc-nd-4-long": "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License",
    "rights-reserved": "All rights reserved",
}

# Licence rules, as (licence, ordered sentence identifiers).
RULES = [
    ("Apache-2.0", ("apache2-notice-the", "apache2-compliance", "apache2-copy", "apache2-as-is", "apache2-see")),
    ("Apache-2.0", ("apache2-notice-the", "apache2-compliance")),
    ("Apache-2.0", ("apache2-notice",)),
    ("MIT", ("mit-title", "mit-grant", "mit-include", "mit-as-is", "mit-liability")),
    ("MIT", ("mit-title-short", "mit-grant", "mit-include", "mit-as-is", "mit-liability")),
    ("MIT", ("mit-grant", "mit-include", "mit-as-is", "mit-liability")),
    ("MIT", ("mit-grant", "mit-include", "mit-as-is")),
    ("MIT", ("mit-notice",)),
    ("MIT", ("mit-notice-licensed",)),
    ("ISC", ("isc-grant", "isc-as-is")),
    ("BSD-3-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse", "bsd-as-is")),
    ("BSD-2-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-as-is")),
    ("GPL-3.0-only", ("gpl3-notice",)),
    ("GPL-2.0-only", ("gpl2-notice",)),
    ("GPL-3.0-or-later", ("gpl3-later", "gpl-hope", "gpl-see")),
    ("GPL-3.0-or-later", ("gpl3-later",)),
    ("GPL-2.0-or-later", ("gpl2-later", "gpl-hope", "gpl-see")),
    ("GPL-2.0-or-later", ("gpl2-later",)),
    ("LGPL-2.1-or-later", ("lgpl21-later",)),
    ("MPL-2.0", ("mpl2-notice", "mpl2-copy")),
    ("MPL-2.0", ("mpl2-notice",)),
    ("Unlicense", ("unlicense-release", "unlicense-anyone")),
    ("Unlicense", ("unlicense-release",)),
    ("CC-BY-4.0", ("cc-by-4",)),
    ("CC-BY-SA-4.0", ("cc-by-sa-4",)),
    ("CC-BY-NC-4.0", ("cc-by-nc-4",)),
    ("CC-BY-ND-4.0", ("cc-by-nd-4",)),
    ("CC-BY-NC-SA-4.0", ("cc-by-nc-sa-4",)),
    ("CC-BY-4.0", ("cc-by-4-long",)),
    ("CC-BY-SA-4.0", ("cc-by-sa-4-long",)),
    ("CC0-1.0", ("cc0",)),
    ("BSD-4-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-advert", "bsd-endorse", "bsd-as-is")),
    ("BSD-4-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-advert-us", "bsd-endorse", "bsd-as-is")),
    ("ISC", ("isc-grant-and", "isc-as-is")),
    ("0BSD", ("0bsd-grant", "isc-as-is")),
    ("Apache-2.0", ("apache2-title",)),
    ("Apache-2.0", ("apache2-title-at",)),
    ("GPL-2.0-only", ("gpl2-title",)),
    ("GPL-3.0-only", ("gpl3-title",)),
    ("LGPL-2.1-only", ("lgpl21-title",)),
    ("LGPL-3.0-only", ("lgpl3-title",)),
    ("AGPL-3.0-only", ("agpl3-title",)),
    ("GPL-2.0-only", ("gpl2-only",)),
    ("GPL-2.0-only", ("gpl2-only-comma",)),
    ("GPL-3.0-only", ("gpl3-only",)),
    ("GPL-3.0-only", ("gpl3-only-comma",)),
    ("LGPL-2.1-or-later", ("lgpl21-later", "gpl-hope", "lgpl-see")),
    ("LGPL-3.0-or-later", ("lgpl3-later", "gpl-hope", "lgpl-see")),
    ("LGPL-3.0-or-later", ("lgpl3-later",)),
    ("AGPL-3.0-or-later", ("agpl3-later", "gpl-hope", "agpl-see")),
    ("AGPL-3.0-or-later", ("agpl3-later",)),
    ("AGPL-3.0-only", ("agpl3-only",)),
    ("AGPL-3.0-only", ("agpl3-only-version",)),
    ("EPL-1.0", ("epl1-title",)),
    ("EPL-2.0", ("epl2-title",)),
    ("EPL-1.0", ("epl1-notice",)),
    ("EPL-2.0", ("epl2-notice",)),
    ("EPL-2.0", ("epl2-notice-v",)),
    ("Zlib", ("zlib-as-is", "zlib-liable", "zlib-grant")),
    ("Zlib", ("zlib-grant",)),
    ("Artistic-2.0", ("artistic2-title",)),
    ("Artistic-2.0", ("artistic2-notice",)),
    ("Artistic-1.0", ("artistic1-title", "artistic1-preamble")),
    ("WTFPL", ("wtfpl-title",)),
    ("WTFPL", ("wtfpl-title-short",)),
    ("WTFPL", ("wtfpl-notice",)),
    ("BSL-1.0", ("bsl-title",)),
    ("BSL-1.0", ("bsl-notice",)),
    ("CC-BY-NC-ND-4.0", ("cc-by-nc-nd-4",)),
    ("CC-BY-NC-4.0", ("cc-by-nc-4-long",)),
    ("CC-BY-ND-4.0", ("cc-by-nd-4-long",)),
    ("CC-BY-NC-SA-4.0", ("cc-by-nc-sa-4-long",)),
    ("CC-BY-NC-ND-4.0", ("cc-by-nc-nd-4-long",)),
    ("LicenseRef-all-rights-reserved", ("rights-reserved",)),
]

_PLAIN = re.compile(r"[^a-z0-9]+")
_BREAK = re.compile(r"\n(?:[ \t]*[#*/;]*[ \t]*\n)+|(?<=[.!?;:])\s+|\s*\n\s*(?=(?:[-*#/]+\s*)?(?:copyright|\(c\)|spdx-license|\d+[.)]\s))|,\s+(?=you may not use this file)|(?<=[a-z]{4})\.(?=\s|$)", re.I)
_OPENING = re.compile(r"^(?:\d+|[a-z]|all copyright .{0,80}?|copyright (?:c )?(?:\d{4} ?)*.{0,80}?)(?= redistribution| neither| all rights)")
_SPDX = re.compile(r"spdx-license-identifier:\s*([A-Za-z0-9.+\-]+)", re.I)
#: Every known sentence, and every wording that `usual` turns into one, holds one of these once normalised (tested);
#: texts whose normalised form has none need no look.
HINTS = ("licens", "permission", "redistribut", "rights reserved", "copyright", "free software", "endorse or promote", "in no event", "warrant", "mpl was not", "public domain", "anyone is free", "all advertising materials", "in the hope that", "restrictions", "artistic")
# Where a normalised sentence names a holder or a program, and the wording of the known sentence.
HOLDERS = [
    (r"(?:\d+ |[a-z] )?(?:neither the names? of|the names? of) .{1,200}? (?:be used to|used to) endorse or promote products derived from (?:this|the) software(?: without (?:specific )?(?:prior )?(?:written )?permission(?: (?:of|from) (?:(?!this software).){1,80})?)?$", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    (r"this software is provided by .{1,160}? as is and any express(?:ed)? or implied", "this software is provided by the copyright holders and contributors as is and any express or implied"),
    (r"the software is provided as is and .{1,160}? disclaims? all warranties", "the software is provided as is and the author disclaims all warranties"),
    (r"in no event shall .{1,160}? be liable for any claim", "in no event shall the authors or copyright holders be liable for any claim"),
    (r"in no event will .{1,160}? be held liable for any damages", "in no event will the authors be held liable for any damages"),
    (r"(?:\d+ |[a-z] )(?=all advertising materials)", ""),
    (r".{1,80}? is free software you can redistribute it and or modify it under the terms", "this program is free software you can redistribute it and or modify it under the terms"),
    (r".{1,80}? is distributed in the hope that it will be useful", "this program is distributed in the hope that it will be useful"),
]
_HOLDERS = [(re.compile(x), y) for x, y in HOLDERS]


def normal(sentence: str) -> str:
    return _PLAIN.sub(" ", sentence.lower()).strip()


def usual(s: str) -> str:
    """A normalised sentence with the usual names in place of its holder's or program's."""
    for pattern, wording in _HOLDERS:
        if m := pattern.match(s):
            return wording + s[m.end() :]
    return s


KNOWN = {usual(normal(text)): name for name, text in SENTENCES.items()}
#: Known sentences up to the end of any word, and the length that a normalised one may have: names take NAMES more.
NAMES = 500
BEGINNINGS = {s[:i] for s in KNOWN for i in [*(m.start() for m in re.finditer(" ", s)), len(s)]}
LONGEST = max(map(len, KNOWN)) + NAMES
_by_first: dict[str, list[tuple[str, tuple[str, ...]]]] = {}
for _rule in sorted(RULES, key=lambda r: -len(r[1])):
    _by_first.setdefault(_rule[1][0], []).append(_rule)


def _known(s: str) -> str | None:
    if not s or len(s) > LONGEST:
        return None
    if s in KNOWN:
        return KNOWN[s]
    s = usual(s)
    return KNOWN.get(s) or KNOWN.get(usual(_OPENING.sub("", s).strip()))


def identify(sentence: str) -> str | None:
    """The known sentence's identifier, or None."""
    return _known(normal(sentence))


def sentences(text: str) -> list[tuple[int, int, str]]:
    """(from, to, normalised) of the sentences of a text; lines that are sentences of their own are also cut from wrapped ones."""
    out, at = [], 0
    for m in _BREAK.finditer(text):
        if m.end() > at:
            out.append((at, m.end()))
        at = m.end()
    if at < len(text):
        out.append((at, len(text)))
    cut = []
    for a, b in out:
        whole = normal(text[a:b])
        lines = text[a:b].split("\n")
        if len(lines) > 1 and _known(whole) is None and any(identify(x) for x in lines):
            for x in lines:
                cut.append((a, a + len(x), normal(x)))
                a += len(x) + 1
        else:
            cut.append((a, b, whole))
    return [x for x in cut if x[2]]


def _goes_on(s: str) -> bool:
    """A known sentence may begin like this."""
    return s in BEGINNINGS or _OPENING.sub("", s).strip() in BEGINNINGS


def _numbered(text: str) -> list[tuple[int, str, int, int]]:
    """(number among all sentences, identifier, from, to) of the known sentences. Marks inside a known sentence may have
    cut it: as many neighbours are joined as still begin like one, and JOINED at least; the longest known one counts."""
    found, parts, i, nth = [], sentences(text), 0, 0
    while i < len(parts):
        joined, best, n = "", None, 0
        while i + n < len(parts):
            joined = f"{joined} {parts[i + n][2]}" if n else parts[i][2]
            n += 1
            if len(joined) > LONGEST or n > JOINED and not _goes_on(joined):
                break
            name = _known(joined)
            if name and not (n > 1 and _known(" ".join(x[2] for x in parts[i + 1 : i + n])) == name):  # else the first one is no part of it
                best = (nth, name, parts[i][0], parts[i + n - 1][1]), n
        if best:
            found.append(best[0])
        i, nth = i + (best[1] if best else 1), nth + 1
    return found


def _chain(found: list[tuple[int, str, int, int]], used: set[int], k: int, rule: tuple[str, ...]) -> list[int] | None:
    """Where the rule's sentences follow one another from the k-th known sentence on."""
    chain = [k]
    for want in rule[1:]:
        j = chain[-1] + 1
        while j < len(found) and found[j][0] - found[chain[-1]][0] <= GAP + 1 and (j in used or found[j][1] != want):
            j += 1
        if j == len(found) or found[j][0] - found[chain[-1]][0] > GAP + 1:
            return None
        chain.append(j)
    return chain


def scan(text: str) -> list[dict]:
    """Matches by place: license, rule (its sentences), start and stop (characters)."""
    whole = normal(text)
    if not any(h in whole for h in HINTS):
        return []
    found = _numbered(text)
    out, used = [], set()
    for size in sorted({len(r[1]) for r in RULES}, reverse=True):
        for k, (_, name, a, _) in enumerate(found):
            for license_, rule in _by_first.get(name, ()):
                if len(rule) == size and k not in used and (chain := _chain(found, used, k, rule)):
                    used.update(chain)
                    out.append({"license": license_, "rule": list(rule), "start": a, "stop": found[chain[-1]][3]})
                    break
    for m in _SPDX.finditer(text):
        out.append({"license": m[1].rstrip("."), "rule": ["spdx-identifier"], "start": m.start(), "stop": m.end()})
    return sorted(out, key=lambda x: (x["start"], x["stop"], x["license"]))


MATCHES = "array<struct<license:string,rule:array<string>,start:long,stop:long>>"


def license_scan(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns in keep and matches (array of license, rule, start, stop, by place) of every whole text.

    Null and empty texts and texts without licence sentences have no matches. Repeated rows are each scanned; an
    empty table gives no rows; other columns are left out.
    """
    common.bound_batches(docs.sparkSession)
    source = docs.select(*keep, F.col("text").cast("string").alias("__text"))
    head = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.select(*keep).schema)
    kind = pa.list_(pa.struct([("license", pa.string()), ("rule", pa.list_(pa.string())), ("start", pa.int64()), ("stop", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [scan(t) if (t := cell.as_py()) else [] for cell in batch.column("__text")]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in keep] + [pa.array(out, kind)], names=[*keep, "matches"])

    return source.mapInArrow(run, f"{head}, matches {MATCHES}")
