"""Licence recognition: sentences to known identifiers, then identifier sequences to ordered rules."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from graphloom.llm import workspace

# Sentences of public licence texts and of the usual notices, by identifier.
SENTENCES = {
    "mit-released": "Released under the MIT License.",
    "mit-licensed": "Licensed under the MIT License.",
    "mit-grant": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:',
    "mit-notice": "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "mit-warranty": 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.',
    "apache2-licensed": "Licensed under the Apache License, Version 2.0.",
    "apache2-header": 'Licensed under the Apache License, Version 2.0 (the "License");',
    "apache2-may-not": "you may not use this file except in compliance with the License.",
    "apache2-copy": "You may obtain a copy of the License at",
    "apache2-unless": 'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.',
    "gpl3-work": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-redistribute-3": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "gpl-redistribute-2": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "gpl-hope": "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    "ccbync4": "Licensed under CC BY-NC 4.0.",
    "ccby4": "Licensed under CC BY 4.0.",
    "ccbysa4": "Licensed under CC BY-SA 4.0.",
    "cc-work-by4": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "bsd-redistribution": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "bsd-source": "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "bsd-binary": "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "bsd-name": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "isc-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "mpl2": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "all-rights": "All rights reserved.",
    "mit-no-event": "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "bsd-as-is-holders": 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.',
    "bsd-no-event": "IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    "isc-as-is": 'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.',
    "zero-bsd-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.",
    "zlib-as-is": "This software is provided 'as-is', without any express or implied warranty.",
    "zlib-liable": "In no event will the authors be held liable for any damages arising from the use of this software.",
    "zlib-grant": "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:",
    "zlib-origin": "The origin of this software must not be misrepresented;",
    "zlib-altered": "Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.",
    "zlib-notice": "This notice may not be removed or altered from any source distribution.",
    "bsl-grant": 'Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:',
    "bsl-header": "Distributed under the Boost Software License, Version 1.0.",
    "unlicense-free": "This is free and unencumbered software released into the public domain.",
    "unlicense-anyone": "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    "cc0-waived": "To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide.",
    "cc0-distributed": "This software is distributed without any warranty.",
    "cc0-licensed": "Licensed under CC0 1.0.",
    "cc0-title": "Creative Commons Legal Code CC0 1.0 Universal",
    "apache2-title": "Apache License Version 2.0, January 2004",
    "apache2-terms": "TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION",
    "apache2-copyright-grant": "Subject to the terms and conditions of this License, each Contributor hereby grants to You a perpetual, worldwide, non-exclusive, no-charge, royalty-free, irrevocable copyright license to reproduce, prepare Derivative Works of, publicly display, publicly perform, sublicense, and distribute the Work and such Derivative Works in Source or Object form.",
    "gpl3-title": "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007",
    "gpl2-title": "GNU GENERAL PUBLIC LICENSE Version 2, June 1991",
    "lgpl3-title": "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007",
    "lgpl21-title": "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999",
    "agpl3-title": "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007",
    "gpl-verbatim": "Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed.",
    "lgpl-redistribute-21": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    "lgpl-redistribute-3": "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "lgpl-hope": "This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    "agpl-redistribute-3": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "mpl2-title": "Mozilla Public License Version 2.0",
    "mpl2-copy": "If a copy of the MPL was not distributed with this file, You can obtain one at",
    "epl2-title": "Eclipse Public License - v 2.0",
    "epl2-header": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0",
    "epl2-terms": 'THE ACCOMPANYING PROGRAM IS PROVIDED UNDER THE TERMS OF THIS ECLIPSE PUBLIC LICENSE ("AGREEMENT").',
    "spdx-mit": "SPDX-License-Identifier: MIT",
    "spdx-apache2": "SPDX-License-Identifier: Apache-2.0",
    "spdx-gpl3": "SPDX-License-Identifier: GPL-3.0-or-later",
}
# Identifiers of the SPDX list; a tag line is a sentence of its own for each.
TAGS = (
    "GPL-3.0-only", "GPL-2.0-only", "GPL-2.0-or-later", "LGPL-2.1-only", "LGPL-2.1-or-later", "LGPL-3.0-only", "LGPL-3.0-or-later", "AGPL-3.0-only", "AGPL-3.0-or-later",
    "BSD-2-Clause", "BSD-3-Clause", "0BSD", "ISC", "Zlib", "BSL-1.0", "Unlicense", "CC0-1.0", "CC-BY-4.0", "CC-BY-SA-4.0", "CC-BY-NC-4.0", "MPL-2.0", "EPL-2.0",
)
SENTENCES |= {f"spdx-{tag}": f"SPDX-License-Identifier: {tag}" for tag in TAGS}
# Ordered rules, the most specific first; each is a sequence of sentence identifiers.
RULES = [
    ("MIT", ("mit-grant", "mit-notice", "mit-warranty", "mit-no-event")),
    ("MIT", ("mit-grant", "mit-notice", "mit-warranty")),
    ("MIT", ("mit-grant", "mit-notice")),
    ("Apache-2.0", ("apache2-header", "apache2-may-not", "apache2-copy", "apache2-unless")),
    ("Apache-2.0", ("apache2-header", "apache2-may-not")),
    ("Apache-2.0", ("apache2-title", "apache2-terms", "apache2-copyright-grant")),
    ("Apache-2.0", ("apache2-title", "apache2-terms")),
    ("BSD-3-Clause", ("bsd-redistribution", "bsd-source", "bsd-binary", "bsd-name", "bsd-as-is-holders", "bsd-no-event")),
    ("BSD-3-Clause", ("bsd-redistribution", "bsd-source", "bsd-binary", "bsd-name")),
    ("BSD-2-Clause", ("bsd-redistribution", "bsd-source", "bsd-binary", "bsd-as-is-holders", "bsd-no-event")),
    ("BSD-2-Clause", ("bsd-redistribution", "bsd-source", "bsd-binary")),
    ("GPL-3.0", ("gpl3-title", "gpl-verbatim")),
    ("GPL-2.0", ("gpl2-title", "gpl-verbatim")),
    ("LGPL-3.0", ("lgpl3-title", "gpl-verbatim")),
    ("LGPL-2.1", ("lgpl21-title", "gpl-verbatim")),
    ("AGPL-3.0", ("agpl3-title", "gpl-verbatim")),
    ("LGPL-2.1-or-later", ("lgpl-redistribute-21", "lgpl-hope")),
    ("LGPL-3.0-or-later", ("lgpl-redistribute-3", "lgpl-hope")),
    ("AGPL-3.0-or-later", ("agpl-redistribute-3", "gpl-hope")),
    ("GPL-3.0-or-later", ("gpl-redistribute-3", "gpl-hope")),
    ("GPL-2.0-or-later", ("gpl-redistribute-2", "gpl-hope")),
    ("GPL-3.0-or-later", ("gpl-redistribute-3",)),
    ("GPL-2.0-or-later", ("gpl-redistribute-2",)),
    ("LGPL-2.1-or-later", ("lgpl-redistribute-21",)),
    ("LGPL-3.0-or-later", ("lgpl-redistribute-3",)),
    ("AGPL-3.0-or-later", ("agpl-redistribute-3",)),
    ("ISC", ("isc-grant", "isc-as-is")),
    ("0BSD", ("zero-bsd-grant", "isc-as-is")),
    ("ISC", ("isc-grant",)),
    ("0BSD", ("zero-bsd-grant",)),
    ("Zlib", ("zlib-as-is", "zlib-liable", "zlib-grant", "zlib-origin", "zlib-altered", "zlib-notice")),
    ("Zlib", ("zlib-grant", "zlib-origin", "zlib-altered")),
    ("BSL-1.0", ("bsl-grant",)),
    ("BSL-1.0", ("bsl-header",)),
    ("Unlicense", ("unlicense-free", "unlicense-anyone")),
    ("Unlicense", ("unlicense-free",)),
    ("CC0-1.0", ("cc0-waived", "cc0-distributed")),
    ("CC0-1.0", ("cc0-waived",)),
    ("CC0-1.0", ("cc0-licensed",)),
    ("CC0-1.0", ("cc0-title",)),
    ("MPL-2.0", ("mpl2", "mpl2-copy")),
    ("MPL-2.0", ("mpl2",)),
    ("MPL-2.0", ("mpl2-title",)),
    ("EPL-2.0", ("epl2-header",)),
    ("EPL-2.0", ("epl2-title", "epl2-terms")),
    ("EPL-2.0", ("epl2-title",)),
    ("MIT", ("mit-released",)),
    ("MIT", ("mit-licensed",)),
    ("MIT", ("spdx-mit",)),
    ("Apache-2.0", ("apache2-licensed",)),
    ("Apache-2.0", ("spdx-apache2",)),
    ("GPL-3.0-only", ("gpl3-work",)),
    ("GPL-3.0-or-later", ("spdx-gpl3",)),
    ("CC-BY-NC-4.0", ("ccbync4",)),
    ("CC-BY-SA-4.0", ("ccbysa4",)),
    ("CC-BY-4.0", ("ccby4",)),
    ("CC-BY-4.0", ("cc-work-by4",)),
    ("all-rights-reserved", ("all-rights",)),
    *((tag, (f"spdx-{tag}",)) for tag in TAGS),
]
#: Every known sentence holds one of these, so other texts need not be split.
TRIGGERS = ("licen", "warrant", "permi", "redistribut", "reserved", "copyright", "spdx", "misrepresented", "liable", "domain", "distribution", "purpose", "commons", "mpl")
_END = re.compile(r"(?<=[.!?;:])\s+")
_NOISE = re.compile(r"[^0-9a-z]+")


def normalised(sentence: str) -> str:
    """Lower case, words of letters and digits only, single spaces."""
    return _NOISE.sub(" ", sentence.lower()).strip()


def table() -> dict[str, str]:
    known = {normalised(text): name for name, text in SENTENCES.items()}
    assert all(any(t in text for t in TRIGGERS) for text in known)
    return known


def identifiers(text: str, known: dict[str, str], longest: int) -> list[tuple[int, str]]:
    """(place, identifier) of known sentences, in the order of the text.

    A sentence ends at a full stop, colon, semicolon, question or exclamation mark before white
    space, or at a line's end.  One wrapped over lines is found by joining the lines that follow,
    as long as a known sentence could still be that long.
    """
    parts: list[tuple[int, str]] = []  # number, normalised text
    number = 0
    for line in text.split("\n"):
        for piece in _END.split(line):
            clean = normalised(piece)
            if clean:
                parts.append((number, clean))
                number += 1
    found, k, openings = [], 0, {text.split(" ", 1)[0] for text in known}
    while k < len(parts):
        if parts[k][1].split(" ", 1)[0] not in openings:
            k += 1
            continue
        joined, j, hit = "", k, None
        while j < len(parts) and len(joined) <= longest:
            joined = f"{joined} {parts[j][1]}" if joined else parts[j][1]
            if joined in known:
                hit = (j, known[joined])
            j += 1
        if hit:
            found.append((parts[k][0], hit[1]))
            k = hit[0]
        k += 1
    return found


def matched(names: list[str], rules=RULES) -> list[str]:
    """Licences whose sequences occur, in this order, among the identifiers.

    Rules are tried in their order; a match takes up its identifiers, others may stand between them.
    """
    free, out = list(names), []
    for licence, sequence in rules:
        while True:
            at, places = 0, []
            for wanted in sequence:
                while at < len(free) and free[at] != wanted:
                    at += 1
                places.append(at)
                at += 1
            if places[-1] >= len(free):
                break
            out.append((places[0], licence))
            for p in places:
                free[p] = ""
    return [licence for _, licence in sorted(out)]


def scan(docs: DataFrame, rules: list[tuple[str, tuple[str, ...]]] | None = None, sentences: dict[str, str] | None = None) -> DataFrame:
    """doc_id, sentences, licences, n_sentences: what each document says about its licence; every row gives a row.

    ``sentences`` and ``licences`` are identifiers in the order of the text, joined by spaces; empty
    where there are none.  Whole texts are read.  A null text counts as empty, repeated rows are each
    scanned, other columns are ignored, an empty table gives none.
    """
    rules = RULES if rules is None else rules
    known = table() if sentences is None else {normalised(text): name for name, text in sentences.items()}
    triggers = re.compile("|".join(TRIGGERS)) if sentences is None else re.compile("")
    longest = max(map(len, known))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen, licences, counts = [], [], []
            for text in batch.column(1):
                text = text.as_py() or ""
                names = [name for _, name in identifiers(text, known, longest)] if triggers.search(text.lower()) else []
                seen.append(" ".join(names))
                licences.append(" ".join(matched(names, rules)) if names else "")
                counts.append(len(names))
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(seen, pa.string()), pa.array(licences, pa.string()), pa.array(counts, pa.int64())], ["doc_id", "sentences", "licences", "n_sentences"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, sentences string, licences string, n_sentences long")


workspace.ship(__name__)
