"""License scans by conditional compression.

Sentences and lines with a word of the licensing vocabulary and their neighbours form candidate blocks, across line ends and blank
lines. In a text with blocks every template is looked for over the whole text, so that no block's bound cuts a notice. A candidate is a
place with a stretch of the template's words; it is compressed alone and with the template as a raw zstandard dictionary, and the
candidates are ranked by the bytes that the template saves. A winner is confirmed by exact wording differences: words missing from it and words put in between are at
most `MOST_DIFFERENT` of the template's words, and names of licenses and version numbers don't differ at all. No rank is cut off. What was
found is taken out and the rest searched again, so that each notice is reported, with its own place; of notices over each other the one that saves most stays.

A license text that is longer than its template is found by its title and its opening words. A tag `SPDX-License-Identifier` counts with its first license.

Nulls: a null or empty text has no blocks. Texts are scanned whole; blocks of over `BLOCK_CHARS` characters are cut between
sentences and overlap, and none is dropped. Repeated rows get equal results; an empty table gives no rows; other columns are ignored,
whatever their names.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterable, Iterator, Sequence
from difflib import SequenceMatcher
from typing import NamedTuple

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches

VOCABULARY = r"(?i)licen[cs]|copyright|spdx|creative commons|\bCC[ -]BY|\bCC0\b|redistribut|without warranty|as[ -]is\b|permission is hereby|permission to use|public domain|unencumbered"
BLOCK_CHARS, MOST_DIFFERENT, LEVEL = 6000, 0.12, 6
#: Neighbours of a keyed unit: so many of at most so many characters, and all within this many characters, more than the longest wording has.
APART, SHORT, REACH = 3, 100, 800

#: Names and wordings of public licenses, as they stand in notices and at the head of the texts.
_BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_BSD_NAMES = "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_BSD_ADVERTS = "3. All advertising materials mentioning features or use of this software must display the following acknowledgement: This product includes software developed by the organization."
_MIT_GRANT = 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so'
_MIT = _MIT_GRANT + ", subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."
_MIT_AS_IS = ' THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'
_ISC = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
_WORDINGS = [
    ("Apache-1.1", "The Apache Software License, Version 1.1"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'),
    ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/ TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION"),
    ("Artistic-2.0", "The Artistic License 2.0"),
    ("BSD-2-Clause", _BSD),
    ("BSD-2-Clause", "Licensed under the BSD 2-Clause License."),
    ("BSD-3-Clause", f"{_BSD} 3. {_BSD_NAMES}"),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("BSD-4-Clause", f"{_BSD} {_BSD_ADVERTS} 4. {_BSD_NAMES}"),
    ("0BSD", f"{_ISC}."),
    ("BSL-1.0", "Distributed under the Boost Software License, Version 1.0."),
    ("BSL-1.0", 'Boost Software License - Version 1.0 - August 17th, 2003 Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so'),
    ("CC0-1.0", "CC0 1.0 Universal"),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work under CC0 1.0."),
    ("CDDL-1.0", "COMMON DEVELOPMENT AND DISTRIBUTION LICENSE (CDDL) Version 1.0"),
    ("CDDL-1.1", "COMMON DEVELOPMENT AND DISTRIBUTION LICENSE (CDDL) Version 1.1"),
    ("EPL-1.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0 which accompanies this distribution"),
    ("EPL-1.0", "Eclipse Public License - v 1.0"),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/"),
    ("EPL-2.0", "Eclipse Public License - v 2.0"),
    ("EUPL-1.2", "Licensed under the EUPL, Version 1.2"),
    ("EUPL-1.2", "EUROPEAN UNION PUBLIC LICENCE v. 1.2"),
    ("ISC", f"{_ISC}, provided that the above copyright notice and this permission notice appear in all copies."),
    ("ISC", "Licensed under the ISC License."),
    ("JSON", f"{_MIT} The Software shall be used for Good, not Evil."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", _MIT),
    ("MIT", _MIT + _MIT_AS_IS),
    ("MIT-0", f"{_MIT_GRANT}.{_MIT_AS_IS}"),
    ("MPL-1.1", "The contents of this file are subject to the Mozilla Public License Version 1.1"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("MPL-2.0", "Mozilla Public License Version 2.0"),
    ("NCSA", "University of Illinois/NCSA Open Source License"),
    ("OFL-1.1", "This Font Software is licensed under the SIL Open Font License, Version 1.1."),
    ("OFL-1.1", "SIL OPEN FONT LICENSE Version 1.1 - 26 February 2007"),
    ("PostgreSQL", "Permission to use, copy, modify, and distribute this software and its documentation for any purpose, without fee, and without a written agreement is hereby granted, provided that the above copyright notice and this paragraph and the following two paragraphs appear in all copies."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("WTFPL", "DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE Version 2, December 2004"),
    ("X11", f"{_MIT}{_MIT_AS_IS} Except as contained in this notice, the name of the X Consortium shall not be used in advertising or otherwise to promote the sale, use or other dealings in this Software without prior written authorization from the X Consortium."),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions"),
]
#: The GNU licenses, with version and date; the Creative Commons licenses and versions.
_GNU = [("GPL", "General", "2", "June 1991"), ("GPL", "General", "3", "29 June 2007"), ("LGPL", "Lesser General", "2.1", "February 1999"), ("LGPL", "Lesser General", "3", "29 June 2007"), ("AGPL", "Affero General", "3", "19 November 2007")]
_COMMONS = [("BY", "Attribution"), ("BY-NC", "Attribution-NonCommercial"), ("BY-SA", "Attribution-ShareAlike"), ("BY-ND", "Attribution-NoDerivatives"), ("BY-NC-SA", "Attribution-NonCommercial-ShareAlike"), ("BY-NC-ND", "Attribution-NonCommercial-NoDerivatives")]
#: Words of which none may be missing or put in where a notice names its license.
NAMES = frozenset(
    "gnu lesser library affero gpl lgpl agpl apache artistic boost bsd cc cc0 cddl commons creative attribution noncommercial sharealike noderivatives noderivs nc sa nd "
    "eclipse epl eupl european illinois isc mit mozilla mpl ncsa sil union wtfpl".split()
)


def _gnu() -> Iterator[tuple[str, str]]:
    for short, kind, version, date in _GNU:
        name = f"{short}-{version if '.' in version else version + '.0'}"
        yield name, f"This work is licensed under the GNU {kind} Public License, version {version}."
        yield name, f"Licensed under the GNU {kind} Public License v{version}."
        yield name, f"This program is free software: you can redistribute it and/or modify it under the terms of the GNU {kind} Public License as published by the Free Software Foundation, either version {version} of the License, or (at your option) any later version."
        yield name, f"GNU {kind} Public License Version {version}, {date}"


def _commons() -> Iterator[tuple[str, str]]:
    for code, words in _COMMONS:
        for version, where in (("3.0", "Unported"), ("4.0", "International")):
            yield f"CC-{code}-{version}", f"Licensed under CC {code} {version}."
            yield f"CC-{code}-{version}", f"This work is licensed under a Creative Commons {words} {version} {where} License."


def _templates_of() -> list[tuple[str, str]]:
    known = [*_WORDINGS, *_gnu(), *_commons()]
    return sorted(known, key=lambda x: x[0]) + [(name, f"SPDX-License-Identifier: {name}") for name in sorted({name for name, _ in known})]


TEMPLATES = _templates_of()

_KEY = re.compile(VOCABULARY)
_UNIT = re.compile(r"[^\n]+?(?:[.!?](?=\s)|(?=\n)|\Z)")
_WORD = re.compile(r"\w+")
#: What can't follow a notice: more of a version or of an identifier.
_MORE = re.compile(r"\.[1-9]|-(?!or-later\b|only\b)\w")


def units(text: str) -> Iterator[tuple[int, int]]:
    """Sentences, none across a line's end."""
    for m in _UNIT.finditer(text):
        yield m.span()


def candidates(text: str) -> list[tuple[int, int]]:
    """(start, end) of the blocks: keyed units with up to `APART` short ones and all others within `REACH` around them; those that touch are one."""
    if not _KEY.search(text):
        return []
    spans = [*units(text)]
    out: list[tuple[int, int]] = []
    until = -1  # last unit of the last block
    for i, (s, e) in enumerate(spans):
        if not _KEY.search(text, s, e):
            continue
        first, last = i, i
        while first and (s - spans[first - 1][0] <= REACH or first > i - APART and spans[first - 1][1] - spans[first - 1][0] <= SHORT):
            first -= 1
        while last < len(spans) - 1 and (spans[last + 1][1] - e <= REACH or last < i + APART and spans[last + 1][1] - spans[last + 1][0] <= SHORT):
            last += 1
        start, end = spans[first][0], spans[last][1]
        if out and first <= until + 1 and end - out[-1][0] <= BLOCK_CHARS:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
        until = max(until, last)
    return out


class Template(NamedTuple):
    name: str
    words: tuple[str, ...]
    tail: str  # what follows the last word
    most: int  # differences
    fixed: frozenset[str]  # names and numbers
    pieces: list[tuple[int, tuple[str, ...]]]  # one more than differences: a match has one of them word for word
    compressor: zstandard.ZstdCompressor

    def same_names(self, words: Sequence[str]) -> bool:
        """Whether words name the license and version that the template names; one that names none fits all."""
        return not self.fixed or fixed(words) == self.fixed


class Match(NamedTuple):
    start: int
    end: int
    license: str
    saving: float
    differences: int


def fixed(words: Iterable[str]) -> frozenset[str]:
    """Names of licenses and, as 'v2' or '2', numbers but zero."""
    return frozenset(w.removeprefix("v") for w in words if w in NAMES or (n := w.removeprefix("v")).isdigit() and n != "0")


@functools.cache
def _templates() -> list[Template]:
    out = []
    for name, wording in TEMPLATES:
        known = zstandard.ZstdCompressionDict(wording.encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        compressor = zstandard.ZstdCompressor(level=LEVEL, dict_data=known, write_content_size=False, write_checksum=False)
        words = tuple(_WORD.findall(wording.lower()))
        most = int(MOST_DIFFERENT * len(words))
        cuts = [len(words) * i // (most + 1) for i in range(most + 2)]
        pieces = [(i, words[i:j]) for i, j in zip(cuts, cuts[1:], strict=False)]
        named = fixed(words) if not NAMES.isdisjoint(words) else frozenset()
        out.append(Template(name, words, wording[[*_WORD.finditer(wording)][-1].end() :], most, named, pieces, compressor))
    return out


@functools.cache
def _pieces() -> dict[str, list[tuple[int, int, tuple[str, ...]]]]:
    """Pieces by their first word: template, place in it, words."""
    out: dict[str, list[tuple[int, int, tuple[str, ...]]]] = {}
    for t, template in enumerate(_templates()):
        for at, words in template.pieces:
            out.setdefault(words[0], []).append((t, at, words))
    return out


def _saving(text: str, compressor: zstandard.ZstdCompressor) -> tuple[int, float]:
    """Bytes that the template saves, and their share."""
    raw = text.encode("utf-8", "replace")
    alone = len(zstandard.ZstdCompressor(level=LEVEL, write_content_size=False).compress(raw))
    saved = max(0, alone - len(compressor.compress(raw)))
    return saved, saved / alone


def differences(block: list[str], template: list[str]) -> int:
    """Words missing from the template's best match in the block, and words put in between.

    The match is the run of equal stretches with the most words less those between them.
    """
    best = run = (0, 0)  # words less those between, equal words
    end = 0
    for m in SequenceMatcher(None, block, template, autojunk=False).get_matching_blocks():
        score = run[0] - (m.a - end)
        run = (score + m.size, run[1] + m.size) if score > 0 else (m.size, m.size)
        end = m.a + m.size
        best = max(best, run)
    return len(template) - best[1] + (best[1] - best[0])


def _align(block: list[str | None], template: tuple[str, ...], most: int) -> list[tuple[int, int, int]]:
    """(differences, first word, word after the last) of the template's best match for each end in the block, up to `most` differences."""
    # one row a word of the block; a cell is the least (differences, -start) with so many of the template's words behind
    above = [(i, 0) for i in range(len(template) + 1)]
    out = []
    for j, word in enumerate(block):
        row = [(0, -(j + 1))]
        for i, wanted in enumerate(template):
            a, b = row[i], above[i + 1]
            cell = (min(a[0], b[0]) + 1, a[1] if a[0] < b[0] else b[1] if b[0] < a[0] else min(a[1], b[1]))
            row.append(min(cell, above[i]) if word == wanted else cell)
        n, start = row[-1]
        if n <= most:
            out.append((n, -start, j + 1))
        above = row
    return out


def _search(words: list[str | None]) -> set[tuple[int, int, int, int]]:
    """(differences, template, first word, word after the last) of all matches in words, overlapping ones too."""
    seen: dict[int, set[int]] = {}
    for p, word in enumerate(words):
        for t, at, piece in _pieces().get(word, ()):
            if tuple(words[p : p + len(piece)]) == piece:
                seen.setdefault(t, set()).add(p - at)
    found = set()
    for t, starts in seen.items():
        wanted, most = _templates()[t].words, _templates()[t].most
        size, windows = len(wanted), []
        for s in sorted(starts):
            if s >= 0 and tuple(words[s : s + size]) == wanted:
                found.add((0, t, s, s + size))
            elif most:
                first, last = max(0, s - most), min(len(words), s + size + most)
                if windows and first <= windows[-1][0] + most:
                    windows[-1][1] = last
                else:
                    windows.append([first, last])
        for first, last in windows:
            found |= {(n, t, first + a, first + b) for n, a, b in _align(words[first:last], wanted, most)}
    return found


def _apart(found: Iterable[tuple[int, int, int, int]]) -> Iterator[tuple[int, int, int, int]]:
    """Of one template's matches over each other, those with fewest differences, then the longest."""
    taken: dict[int, list[tuple[int, int]]] = {}
    for n, t, a, b in sorted(found, key=lambda x: (x[0], x[2] - x[3], x)):
        own = taken.setdefault(t, [])
        if all(b <= s or e <= a for s, e in own):
            own.append((a, b))
            yield n, t, a, b


def matches(block: str) -> tuple[Match, ...]:
    """All notices in a block or text by place, none over another."""
    places = [*_WORD.finditer(block)]
    words: list[str | None] = [m[0].lower() for m in places]
    out = []
    taken = True
    while taken:
        ranked, taken = [], False
        confirmed = {(n, t, a, b) for n, t, a, b in _search(words) if None not in words[a:b] and _templates()[t].same_names(words[a:b]) and not (_templates()[t].fixed and _MORE.match(block, places[b - 1].end()))}
        for n, t, a, b in _apart(confirmed):
            template = _templates()[t]
            start, end = places[a].start(), places[b - 1].end()
            end += len(template.tail) * block.startswith(template.tail, end)
            saved, share = _saving(block[start:end], template.compressor)
            ranked.append((-saved, n, -len(template.words), template.name, a, b, start, end, share))
        for _, n, _, name, a, b, start, end, share in sorted(ranked):
            if None not in words[a:b]:
                words[a:b] = [None] * (b - a)
                out.append(Match(start, end, name, share, n))
                taken = True
    return tuple(sorted(out))


def identify(block: str) -> tuple[str, float, int] | None:
    """(license, saving from 0 to 1, differences) of the notice with fewest differences in a block."""
    best = min(matches(block), key=lambda m: (m.differences, m.start - m.end, -m.saving), default=None)
    return best and (best.license, best.saving, best.differences)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_blocks, found) of every document; found has start, end, license, saving and differences of each notice."""
    bounded_batches(docs.sparkSession)
    kept = F.when(F.col(text_col).rlike(VOCABULARY), F.col(text_col))  # else the text needn't leave the JVM
    slim = docs.select(F.col(id_col).alias("doc_id"), kept.alias("text"))
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("license", pa.string()), ("saving", pa.float64()), ("differences", pa.int64())]))

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, found = [], []
            for text in batch.column(1):
                text = text.as_py() or ""
                spans = candidates(text)
                counts.append(len(spans))
                found.append([m._asdict() for m in matches(text)] if spans else [])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(found, kind)], ["doc_id", "n_blocks", "found"])

    schema = slim.select("doc_id", F.lit(0).cast("long").alias("n_blocks"), F.array().cast("array<struct<start:bigint,end:bigint,license:string,saving:double,differences:bigint>>").alias("found")).schema
    return slim.mapInArrow(step, schema)


def digest(found: DataFrame) -> DataFrame:
    """One row a document: blocks, notices, the licenses' names, and the differences in all."""
    names = F.array_join(F.array_sort(F.array_distinct(F.transform("found", lambda x: x["license"]))), ",")
    return found.select("doc_id", "n_blocks", F.size("found").cast("long").alias("n_found"), names.alias("licenses"), F.aggregate("found", F.lit(0).cast("long"), lambda a, x: a + x["differences"]).alias("n_differences"))
