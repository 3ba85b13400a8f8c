"""Licence scan against a per-document version in plain Python, and wrapped texts."""

import re

from geodrift.llm import license_scan as L

MIT = "MIT License\n\nCopyright (c) 2020 Someone\n\n" + "\n".join(re.findall(r".{1,60}(?:\s|$)", L.SENTENCES["mit-grant"][0])) + "\n\n" + L.SENTENCES["mit-notice"][0] + ".\n\n" + L.SENTENCES["mit-warranty"][0] + "."
BSD = "; ".join(L.SENTENCES[k][0].rstrip(":") for k in ("bsd-grant", "bsd-source", "bsd-binary"))
TEXTS = [
    None, "", "No words of the kind.", MIT, BSD + ".", BSD + ". " + L.SENTENCES["bsd-endorse"][0] + ".", "Some prose.\nReleased under the MIT License.\nMore.\nLicensed under CC BY-NC 4.0.",
    "A licence plate and a permission slip.", "This work is licensed under the GNU General Public License, version 3.", "RELEASED   under the mit license!", "Released under the MIT License\nand more", "software " * 20000,
    "Licensed under the Apache License, Version 2.0 (the \"License\");\nyou may not use this file except in compliance with the License.", BSD + ".",
]


def matched(ids, rule):
    """Whether a rule matches the identifiers, and those that no match uses; by index, without patterns."""
    steps = [name.split("+") for name in rule]
    used, at = set(), 0
    while at < len(ids):
        here, places = at, []
        for k, step in enumerate(steps):
            while here + len(step) <= len(ids) and ids[here : here + len(step)] != step:
                here += 1
            if here + len(step) > len(ids):
                return bool(used), [x for i, x in enumerate(ids) if i not in used]
            places += range(here, here + len(step))
            here += len(step)
        used.update(places)
        at = here
    return bool(used), [x for i, x in enumerate(ids) if i not in used]


def brute(text):
    known, out = L.known_sentences(), set()
    for units in (re.split(L.ENDS, text or ""), (text or "").split("\n")):
        found = [known[L.normal(u)] for u in units if L.normal(u) in known]
        ids = [x for k, x in enumerate(found) if (k == 0 or found[k - 1] != x) and (x not in L.VERSION_CLAUSES or k and found[k - 1] in L.TERMS_CLAUSES)]
        for licence, rule in L.RULES:
            hit, ids = matched(ids, rule)
            if hit:
                out.add(licence)
    return sorted(out)


def test_hints_cover_sentences():
    for forms in L.SENTENCES.values():
        for form in forms:
            assert any(h in form.lower() for h in L.HINTS), form


def test_scan(spark):
    docs = spark.createDataFrame([(i, t, 5) for i, t in enumerate(TEXTS)], "doc_id long, text string, licenses int")
    got = {r.doc_id: r.licenses for r in L.scan(docs).collect()}
    assert got == {i: brute(t) for i, t in enumerate(TEXTS)}
    assert got[3] == ["MIT"] and got[4] == got[13] == ["BSD-2-Clause"] and got[5] == ["BSD-3-Clause"] and got[6] == ["CC-BY-NC-4.0", "MIT"] and got[12] == ["Apache-2.0"]
    assert L.scan(docs.limit(0)).count() == 0


def test_every_name_gives_its_licence(spark):
    texts = [(licence, f"Some prose here.\n{notice}{name}.\nMore of it.") for licence, names in L.NAMES.items() for name in names for notice in ("", "Licensed under the ")]
    docs = spark.createDataFrame([(i, t, "x", 1) for i, (_, t) in enumerate(texts)], "doc_id long, text string, `a.b` string, _found int")
    got = {r.doc_id: (r.licenses, r["a.b"], r._found) for r in L.scan(docs).collect()}
    assert got == {i: ([licence], "x", 1) for i, (licence, _) in enumerate(texts)} and len({licence for licence, _ in L.RULES}) >= 40


def test_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    rows = L.scan(docs).collect()
    assert [r.licenses for r in rows] == [brute(r.text) for r in rows] and sum(bool(r.licenses) for r in rows) > 5


def test_versions_and_blank_lines(spark):
    start = "it under the terms of the GNU General Public License as\npublished by the Free Software Foundation"
    program, other = f"This program is free software; you can redistribute it and/or modify\n{start}", f"Foo is free software: you can redistribute it and/or modify\n{start}"
    grant = "\n".join(re.findall(r".{1,60}(?:\s|$)", L.SENTENCES["mit-grant"][0])) + "\n\n" + L.SENTENCES["mit-notice"][0] + ".\n"
    commented = "".join(f" * {x}\n" for x in f"Copyright 2024 A B\n\n{L.SENTENCES['isc-grant'][0]}.".split("\n"))
    mpl = "This Source Code Form is subject to the terms of the Mozilla Public\nLicense, v. {}. If a copy of the MPL was not distributed, get one."
    texts = {
        f"{program}; either version 3 of the License, or\n(at your option) any later version.": ["GPL-3.0-or-later"],
        f"{program}; either version 2 of the License, or\n(at your option) any later version.": ["GPL-2.0-or-later"],
        f"{program}, either version 2 of the License, or\n(at your option) any later version.": ["GPL-2.0-or-later"],
        f"{other}, either version 3 of the License, or\n(at your option) any later version.": ["GPL-3.0-or-later"],
        f"{other}; either version 2, or (at your option)\nany later version.": ["GPL-2.0-or-later"],
        f"{program}; version 2 of the License.": ["GPL-2.0-only"],
        f"{program}; version 3 of the License.": ["GPL-3.0-only"],
        f"{other}, version 2.": ["GPL-2.0-only"],
        f"{program}; version 2 of the License.\n\n{program}; either version 3 of the License, or (at your option) any later version.": ["GPL-2.0-only", "GPL-3.0-or-later"],
        f"{program}.\n\nSome software, version 3.": [],
        f"{program}.\n\nNews.": [],
        f"Copyright (c) 2024 A B\n\n{grant}": ["MIT"],
        f"Copyright (c) 2024 A B\r\n \r\n{grant}": ["MIT"],
        commented: ["ISC"],
        mpl.format("2.0"): ["MPL-2.0"],
        mpl.format("1.1"): [],
        f"{program.replace('program', 'library').replace('General', 'Lesser General')}; either version 2.1 of the License, or (at your option) any later version.": ["LGPL-2.1-or-later"],
        f"{program.replace('General', 'Affero General')}, either version 3 of the License, or (at your option) any later version.": ["AGPL-3.0-or-later"],
        f"{L.SENTENCES['bsd-source'][0]}.\nReleased under the MIT License.\n{L.SENTENCES['bsd-binary'][0]}.": ["MIT"],
        f"{L.SENTENCES['bsd-grant'][0]}\n{L.SENTENCES['bsd-source'][0]}.\nReleased under the MIT License.\n{L.SENTENCES['bsd-binary'][0]}.": ["BSD-2-Clause", "MIT"],
        "# SPDX-License-Identifier: EPL-2.0\n": ["EPL-2.0"],
        "// SPDX-License-Identifier: LGPL-2.1-or-later\nint x;": ["LGPL-2.1-or-later"],
        f"{L.SENTENCES['zlib-as-is'][0]}.\n\n1. {L.SENTENCES['zlib-origin'][0]}; you must not claim.": ["Zlib"],
        "Distributed under the Boost Software License, Version 1.0.\nThis Font Software is licensed under the SIL Open Font License, Version 1.1.": ["BSL-1.0", "OFL-1.1"],
        "MIT License\n" * 30000: ["MIT"],
    }
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.text: r.licenses for r in L.scan(docs).collect()} == texts
    assert all(brute(t) == want for t, want in texts.items())
    alone = spark.createDataFrame([(1, "Software news.\nVersion 2.\nVersion 3.")], "doc_id long, text string")
    assert L.scan(alone).first().license_sentences == []


def test_no_part_stands_for_a_version():
    known = L.known_sentences()
    for rule in L.RULES:
        numbers = re.findall("[0-9]", rule[0]) if re.match("[AL]?GPL|MPL|EPL|LGPL", rule[0]) else []
        for form, name in known.items():
            if numbers and [name] == rule[1]:
                assert numbers[0] in form, (rule, form)
