import random
import re
from collections import Counter

import pytest

from pagewright.llm.licenses import NAMES, TEMPLATES, candidates, differences, digest, fixed, identify, matches, scan, units
from pagewright.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"


def test_whole_table_against_exact_notices(spark):
    """The short notices are found exactly where they stand word for word."""
    short = [(name, re.compile(re.escape(wording), re.I)) for name, wording in TEMPLATES if len(wording) < 80]
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = {r.doc_id: r for r in QUERIES["op10_license_scan"](spark, SF).collect()}
    assert got.keys() == texts.keys()
    assert any(r.n_found for r in got.values())
    for d, text in texts.items():
        assert got[d].licenses == ",".join(sorted({name for name, p in short if p.search(text)})), d


@pytest.mark.parametrize(("name", "wording"), TEMPLATES)
def test_each_template(name, wording):
    assert identify(wording)[::2] == (name, 0)
    lines = "Some story here.\n" + "\n".join(re.sub("(.{60}) ", r"\1\n", wording).split("\n")) + "\nAnd the end of it."
    found = [identify(lines[s:e]) for s, e in candidates(lines)]
    assert (name, 0) in [(r[0], r[2]) for r in found if r]


@pytest.mark.parametrize(("name", "wording"), TEMPLATES)
@pytest.mark.parametrize("width", [0, 30, 120, 200])
def test_each_template_in_paragraphs(name, wording, width):
    """Unwrapped with a blank line after each sentence, or wrapped at any width."""
    cut = re.sub("(.{%d}[^ ]*) " % width, r"\1\n", wording) if width else re.sub(r"([.:;]) ", r"\1\n\n", wording)
    text = f"Some story here.\n\n{cut}\n\nAnd the end of it."
    assert (name, 0) in [(r[0], r[2]) for r in (identify(text[s:e]) for s, e in candidates(text)) if r]
    assert [(text[m.start : m.end], m.license) for m in matches(text)] == [(cut, name)]


def test_no_bound_cuts_a_notice(spark):
    mit = max((wording for name, wording in TEMPLATES if name == "MIT"), key=len)
    rows = [(i, "A license. " * (500 + i) + mit + " A license." * 700) for i in range(0, 60, 4)]
    got = scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(rows[r.doc_id // 4][1][x.start : x.end]) for r in got for x in r.found} == {mit}
    assert all(len(r.found) == 1 for r in got)


def test_every_notice_of_a_block(spark):
    pair = "Code: Licensed under the MIT License. Text: Licensed under CC BY 4.0."
    listed = "\n".join(f"lib{i}: {wording}" for i, (_, wording) in enumerate(TEMPLATES))
    twice = "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License. " * 2
    rows = [(1, pair), (2, listed), (3, twice), (4, listed[::-1])]
    got = {r.doc_id: r for r in scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [(pair[x.start : x.end], x.license, x.differences) for x in got[1].found] == [("Licensed under the MIT License.", "MIT", 0), ("Licensed under CC BY 4.0.", "CC-BY-4.0", 0)]
    assert [(listed[x.start : x.end], x.license) for x in got[2].found] == [(wording, name) for name, wording in TEMPLATES]
    assert [x.license for x in got[3].found] == ["CC-BY-NC-4.0"] * 2
    assert got[4].found == []


def words_apart(block, template):
    """Brute force: the least number of words missing and put in, over all parts of the block that name the same license and version."""
    named = fixed(template) if NAMES & {*template} else None
    best = len(template)
    if (Counter(template) - Counter(block)).total() > 0.12 * best:
        return best  # so many are missing at least
    for s in range(len(block)):
        row = [*range(len(template) + 1)]
        for j, word in enumerate(block[s:]):
            above, row = row, [j + 1]
            for i, wanted in enumerate(template):
                row.append(min(row[i] + 1, above[i + 1] + 1, above[i] if word == wanted else 10**9))
            if row[-1] < best and (named is None or fixed(block[s : s + j + 1]) == named):
                best = row[-1]
    return best


def test_matches_against_brute_force():
    rng = random.Random(5)
    for name, wording in TEMPLATES:
        template = re.findall(r"\w+", wording.lower())
        for changes in range(4 if len(template) > 40 else 3):
            words = [*template]
            for _ in range(changes):
                at = rng.randrange(1, len(words) - 1)
                words[at : at + rng.randrange(2)] = ["other"] * rng.randrange(2)
            text = " ".join(["some", "words", *words, "and", "more"])
            fits = {n for n, w in TEMPLATES if words_apart(text.split(), t := re.findall(r"\w+", w.lower())) <= 0.12 * len(t)}
            got = {m.license for m in matches(text)}
            assert got <= fits and bool(got) == bool(fits), text
            least = words_apart(text.split(), template)
            if least <= 0.12 * len(template) and fits == {name}:
                assert min(m.differences for m in matches(text)) <= least


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("This work is licensed under the GNU Lesser General Public License, version 3.", ["LGPL-3.0"]),
        ("This work is licensed under the GNU Affero General Public License, version 3.", ["AGPL-3.0"]),
        ("This work is licensed under the GNU Library General Public License, version 3.", []),
        ("This work is licensed under the GNU General Public License, version 2.", ["GPL-2.0"]),
        ("This work is licensed under the GNU General Public License, version 4.", []),
        ("This work is licensed under the GNU Lesser General Public License, version 2.1.", ["LGPL-2.1"]),
        ("This work is licensed under the GNU General Public License, version 2.1.", []),
        ("GNU GENERAL PUBLIC LICENSE\n Version 2, June 1991\n\nCopyright (C) 1989, 1991 Free Software Foundation, Inc.", ["GPL-2.0"]),
        ("GNU LESSER GENERAL PUBLIC LICENSE\n Version 3, 29 June 2007\n\nThis version of the GNU Lesser General Public License incorporates the terms of version 3 of the GNU General Public License.", ["LGPL-3.0"]),
        ("Licensed under the MIT License. Licensed under the Apache License, Version 2.0.", ["MIT", "Apache-2.0"]),
        ("# SPDX-License-Identifier: MIT\nimport x", ["MIT"]),
        ("# SPDX-License-Identifier: MIT-0\nimport x", ["MIT-0"]),
        ("# SPDX-License-Identifier: MIT-Modern-Variant\nimport x", []),
        ("// SPDX-License-Identifier: GPL-2.0-or-later", ["GPL-2.0"]),
        ("Licensed under CC BY 3.0. Licensed under CC BY-NC-SA 4.0.", ["CC-BY-3.0", "CC-BY-NC-SA-4.0"]),
        ("Licensed under CC BY 2.5.", []),
    ],
)
def test_names_and_versions(text, want):
    assert [m.license for m in matches(text)] == want


def wording(name, opening):
    return max((w for n, w in TEMPLATES if n == name and w.startswith(opening)), key=len)


def test_look_alikes():
    """Each of a family gets its own name from its text as it stands in files, with another holder's name and list marks."""
    texts = {
        "BSD-2-Clause": wording("BSD-2-Clause", "Redis").replace(" 1. ", "\n * ").replace(" 2. ", "\n * "),
        "BSD-3-Clause": wording("BSD-3-Clause", "Redis").replace("the copyright holder", "Some University").replace(" 1. ", "\n\n1) ").replace(" 3. ", "\n\n3) "),
        "BSD-4-Clause": wording("BSD-4-Clause", "Redis").replace("the organization.", "Some University and its people."),
        "MIT": "The MIT License (MIT)\n\nCopyright (c) 2001 A. Person\n\n" + wording("MIT", "Permission").replace("AUTHORS OR", "AUTHORS, CONTRIBUTORS OR"),
        "MIT-0": wording("MIT-0", "Permission"),
        "X11": wording("X11", "Permission"),
        "JSON": wording("JSON", "Permission"),
        "ISC": wording("ISC", "Permission").replace("and/or", "and"),
        "0BSD": wording("0BSD", "Permission"),
        "PostgreSQL": wording("PostgreSQL", "Permission"),
        "BSL-1.0": wording("BSL-1.0", "Boost"),
    }
    for name, text in texts.items():
        assert [m.license for m in matches(f"Some words before.\n\n{text}\n\nSome words after.")] == [name]
    many = "\n\n".join(f"{i}: {text}" for i, text in enumerate(texts.values()))
    assert [m.license for m in matches(many)] == [*texts]


def test_ties_and_all_columns(spark):
    """Equal notices each count; the digest's columns against the texts' own."""
    rows = [(1, "Licensed under the MIT License. " * 3), (2, "Released under the MIT License. Licensed under CC BY 4.0."), (3, "A license. " * 3), (4, "None here.")]
    got = digest(scan(spark.createDataFrame(rows, "doc_id long, text string"))).collect()
    assert [tuple(r) for r in sorted(got)] == [(1, 1, 3, "MIT", 0), (2, 1, 2, "CC-BY-4.0,MIT", 0), (3, 1, 0, "", 0), (4, 0, 0, "", 0)]


def test_wording_differences():
    assert differences("released under the MIT license".lower().split(), "released under the mit license".split()) == 0
    assert differences("x released under a mit license y".split(), "released under the mit license".split()) == 2
    assert differences(["x"], ["a", "b"]) == 2
    assert identify("The license of this car was renewed.") is None
    assert identify("Licensed under CC BY-SA 4.0.")[0] == "CC-BY-SA-4.0"


def test_edges(spark):
    far = "word " * 50_000 + "\nReleased under the MIT License.\n" + "word " * 50_000
    rows = [(1, None), (2, ""), (3, far), (3, far), (None, "Licensed under CC BY 4.0."), (5, "license " * 3000), (6, "\n\n \n"), (7, "É" * 1000)]
    frame = spark.createDataFrame([(d, t, "x", 1) for d, t in rows], "doc_id long, text string, found string, n_blocks int")
    got = sorted(map(str, [tuple(r)[:4] for r in digest(scan(frame)).collect()]))
    assert got == sorted(map(str, [(1, 0, 0, ""), (2, 0, 0, ""), (3, 1, 1, "MIT"), (3, 1, 1, "MIT"), (None, 1, 1, "CC-BY-4.0"), (5, 1, 0, ""), (6, 0, 0, ""), (7, 0, 0, "")]))
    spans = [r.found for r in scan(frame).collect() if r.doc_id == 3]
    assert far[spans[0][0].start : spans[0][0].end] == "Released under the MIT License."
    assert digest(scan(frame.limit(0))).collect() == []


def test_units_cover_the_text():
    text = "One. Two!\nThree 4.0 five\n\nEnd"
    assert [text[s:e] for s, e in units(text)] == ["One.", " Two!", "Three 4.0 five", "End"]
    assert "".join(text[s:e] for s, e in units(text)) == text.replace("\n", "")
