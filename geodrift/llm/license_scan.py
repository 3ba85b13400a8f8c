"""Licence recognition by sentences, in DataFrame operations only.

A text is cut into sentences; each is normalised (lower case, runs of characters
that are neither letters nor digits become one space) and looked up among known
licence sentences.  The identifiers found, in order, form a sequence that is
matched against ordered licence rules.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .names import unused

#: Parts of the notice of the GPL and its kin; what follows the terms, after a comma or as a clause of its own, gives the version.
TERMS = {
    kind: f"you can redistribute it and/or modify it under the terms of the GNU {name} as published by the Free Software Foundation"
    for kind, name in (("gpl", "General Public License"), ("lgpl", "Lesser General Public License"), ("agpl", "Affero General Public License"))
}
LATER = ("(at your option) any later version", "at your option any later version", "any later version")
VERSIONS = {n: [f"version {n} of the License", f"version {n}", f"version {n} of the GNU General Public License"] for n in ("2", "2.1", "3")}
#: Licences of the kin by version.
KIN = {("gpl", "2"): "GPL-2.0", ("gpl", "3"): "GPL-3.0", ("lgpl", "2.1"): "LGPL-2.1", ("lgpl", "3"): "LGPL-3.0", ("agpl", "3"): "AGPL-3.0"}

#: Names by which notices call a licence.
NAMES = {
    "MIT": ["MIT License", "MIT License (MIT)"],
    "Apache-2.0": ["Apache License, Version 2.0", "Apache License, Version 2.0 (the \"License\")", "Apache License Version 2.0, January 2004", "Apache License 2.0"],
    "GPL-3.0-only": ["GNU General Public License, version 3", "GNU General Public License v3.0", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"],
    "GPL-2.0-only": ["GNU General Public License, version 2", "GNU General Public License v2.0", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991"],
    "LGPL-3.0-only": ["GNU Lesser General Public License, version 3", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007"],
    "LGPL-2.1-only": ["GNU Lesser General Public License, version 2.1", "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999"],
    "AGPL-3.0-only": ["GNU Affero General Public License, version 3", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007"],
    "MPL-2.0": ["Mozilla Public License, version 2.0", "Mozilla Public License Version 2.0"],
    "MPL-1.1": ["Mozilla Public License, version 1.1", "Mozilla Public License Version 1.1"],
    "EPL-2.0": ["Eclipse Public License 2.0", "Eclipse Public License v2.0", "Eclipse Public License - v 2.0"],
    "EPL-1.0": ["Eclipse Public License 1.0", "Eclipse Public License v1.0", "Eclipse Public License - v 1.0"],
    "BSD-3-Clause": ["BSD 3-Clause License", "BSD 3-Clause \"New\" or \"Revised\" License"],
    "BSD-2-Clause": ["BSD 2-Clause License", "BSD 2-Clause \"Simplified\" License"],
    "BSD-4-Clause": ["BSD 4-Clause License"],
    "0BSD": ["BSD Zero Clause License"],
    "ISC": ["ISC License"],
    "Zlib": ["zlib License", "zlib/libpng License"],
    "BSL-1.0": ["Boost Software License, Version 1.0", "Boost Software License - Version 1.0 - August 17th, 2003"],
    "OFL-1.1": ["SIL Open Font License, Version 1.1", "SIL OPEN FONT LICENSE Version 1.1 - 26 February 2007"],
    "Artistic-2.0": ["Artistic License 2.0", "Artistic License, Version 2.0"],
    "CDDL-1.0": ["Common Development and Distribution License, Version 1.0", "Common Development and Distribution License (CDDL) Version 1.0"],
    "EUPL-1.2": ["EUPL, Version 1.2", "European Union Public Licence, Version 1.2"],
    "MS-PL": ["Microsoft Public License", "Microsoft Public License (Ms-PL)"],
    "MS-RL": ["Microsoft Reciprocal License", "Microsoft Reciprocal License (Ms-RL)"],
    "NCSA": ["University of Illinois/NCSA Open Source License"],
    "PostgreSQL": ["PostgreSQL License"],
    "Python-2.0": ["Python Software Foundation License Version 2"],
    "WTFPL": ["Do What The Fuck You Want To Public License"],
    "MulanPSL-2.0": ["Mulan PSL v2", "Mulan Permissive Software License, Version 2"],
    "ODbL-1.0": ["Open Database License", "Open Database License (ODbL) v1.0"],
    "GFDL-1.3-only": ["GNU Free Documentation License, Version 1.3"],
    "OSL-3.0": ["Open Software License version 3.0"],
    "AFL-3.0": ["Academic Free License version 3.0"],
    "Unlicense": ["Unlicense"],
    "CC0-1.0": ["CC0 1.0", "CC0 1.0 Universal", "Creative Commons CC0 1.0 Universal License"],
    "CC-BY-4.0": ["CC BY 4.0", "Creative Commons Attribution 4.0 International License"],
    "CC-BY-SA-4.0": ["CC BY-SA 4.0", "Creative Commons Attribution-ShareAlike 4.0 International License"],
    "CC-BY-ND-4.0": ["CC BY-ND 4.0", "Creative Commons Attribution-NoDerivatives 4.0 International License"],
    "CC-BY-NC-4.0": ["CC BY-NC 4.0", "Creative Commons Attribution-NonCommercial 4.0 International License"],
    "CC-BY-NC-SA-4.0": ["CC BY-NC-SA 4.0", "Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License"],
    "CC-BY-NC-ND-4.0": ["CC BY-NC-ND 4.0", "Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License"],
}
#: Known sentences (or clauses between full stops) by identifier, as licences print them.
SENTENCES = {
    "mit-grant": ["Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"],
    "mit-notice": ["The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software"],
    "mit-warranty": ["THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT"],
    "apache-use": ["you may not use this file except in compliance with the License"],
    "apache-copy": ["You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0", "You may obtain a copy of the License at"],
    "apache-as-is": ["Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied"],
    "bsd-grant": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"],
    "bsd-source": ["Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer"],
    "bsd-binary": ["Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution"],
    "bsd-endorse": ["Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"],
    "isc-grant": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies"],
    "mpl2-form": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"],
    "epl2-terms": ["This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0"],
    "epl1-terms": ["This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0 which accompanies this distribution"],
    "zlib-as-is": ["This software is provided 'as-is', without any express or implied warranty"],
    "zlib-origin": ["The origin of this software must not be misrepresented"],
    "zlib-altered": ["Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software"],
    "bsl-see": ["Distributed under the Boost Software License, Version 1.0. (See accompanying file LICENSE_1_0.txt or copy at http://www.boost.org/LICENSE_1_0.txt)"],
    "ofl-font": ["This Font Software is licensed under the SIL Open Font License, Version 1.1"],
    "0bsd-grant": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"],
    "bsd-advertise": ["All advertising materials mentioning features or use of this software must display the following acknowledgement:"],
    "cc0-domain": ["This work is dedicated to the public domain under CC0 1.0"],
    "unlicense": ["This is free and unencumbered software released into the public domain"],
}

#: The kin's notices in one sentence, the terms alone and the versions alone.
for _kind, _terms in TERMS.items():
    SENTENCES[f"{_kind}-terms"] = [_terms]
for _n, _forms in VERSIONS.items():
    SENTENCES[f"version-{_n}"] = _forms
    SENTENCES[f"version-{_n}-later"] = [f"either {v}, or {later}" for v in _forms for later in LATER]
for (_kind, _n), _licence in KIN.items():
    SENTENCES[f"{_licence}-grant"] = [f"{TERMS[_kind]}, {v}" for v in VERSIONS[_n]]
    SENTENCES[f"{_licence}-later-grant"] = [f"{TERMS[_kind]}, either {v}, or {later}" for v in VERSIONS[_n] for later in LATER]
for _licence, _names in NAMES.items():
    SENTENCES[f"{_licence}-name"] = [*_names, f"SPDX-License-Identifier: {_licence}"]
for _licence in KIN.values():
    SENTENCES[f"{_licence}-later-name"] = [f"SPDX-License-Identifier: {_licence}-or-later"]

#: Clauses that say nothing without the terms before them.
VERSION_CLAUSES = tuple(f"version-{n}{later}" for n in VERSIONS for later in ("", "-later"))
TERMS_CLAUSES = tuple(f"{kind}-terms" for kind in TERMS)

#: Ordered rules, first match wins for the sentences it names; those of one sentence follow the others.  A rule is a
#: licence and a sequence of identifiers that must follow each other, other sentences between allowed
#: (they stay for later rules) except where a plus joins two.
RULES = [
    ("BSD-4-Clause", ["bsd-grant", "bsd-source", "bsd-binary", "bsd-advertise", "bsd-endorse"]),
    ("BSD-3-Clause", ["bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse"]),
    ("BSD-2-Clause", ["bsd-grant", "bsd-source", "bsd-binary"]),
    ("MIT", ["mit-grant", "mit-notice", "mit-warranty"]),
    ("MIT", ["mit-grant", "mit-notice"]),
    ("ISC", ["isc-grant"]),
    ("0BSD", ["0bsd-grant"]),
    ("Zlib", ["zlib-as-is", "zlib-origin", "zlib-altered"]),
    ("Zlib", ["zlib-as-is", "zlib-origin"]),
    ("Apache-2.0", ["Apache-2.0-name", "apache-use", "apache-copy", "apache-as-is"]),
    ("Apache-2.0", ["apache-use", "apache-as-is"]),
    ("Apache-2.0", ["apache-use", "apache-copy"]),
    ("MPL-2.0", ["mpl2-form"]),
    ("EPL-2.0", ["epl2-terms"]),
    ("EPL-1.0", ["epl1-terms"]),
    ("BSL-1.0", ["bsl-see"]),
    ("OFL-1.1", ["ofl-font"]),
    ("CC0-1.0", ["cc0-domain"]),
    ("Unlicense", ["unlicense"]),
    *[(f"{x}-or-later", [f"{x}-later-grant"]) for x in KIN.values()],
    *[(f"{x}-or-later", [f"{kind}-terms+version-{n}-later"]) for (kind, n), x in KIN.items()],
    *[(f"{x}-only", [f"{x}-grant"]) for x in KIN.values()],
    *[(f"{x}-only", [f"{kind}-terms+version-{n}"]) for (kind, n), x in KIN.items()],
    *[(f"{x}-or-later", [f"{x}-later-name"]) for x in KIN.values()],
    *[(x, [f"{x}-name"]) for x in NAMES],
]
RULES.sort(key=lambda rule: len(rule[1]) == 1 and "+" not in rule[1][0])

#: Every known sentence holds one of these in lower case (checked by a test), so other texts need no look-up.
HINTS = ("licen", "permission", "redistribut", "software", "public domain", "names of its contributors", "creative commons", "cc by", "cc0", "mozilla public", "warranty", "any later version", "version 2", "version 3", "eupl", "mulan psl", "altered source")
#: A sentence ends at a mark before white space or the end, but not after "v." before a number, and at a line without letters and digits.
ENDS = r"(?!(?<=\b[Vv])\.\s+[0-9])[.!?;:]+(?=\s|$)|\n[^A-Za-z0-9\n]*\n"


#: What may stand before a name or the terms in a notice, in normal form.
NOTICE = "^(?:this (?:program|library|software) is free software )?(?:this (?:work|project|software|file) is )?(?:(?:licensed|released|distributed) under )?(?:the |a )?"


def normal(text: str) -> str:
    """Normal form of a sentence: ASCII letters in lower case and digits, other runs one space, without NOTICE."""
    return re.sub(NOTICE, "", re.sub("[^a-z0-9]+", " ", text.lower()).strip())


def known_sentences() -> dict[str, str]:
    """Normal form of every sentence to its identifier.

    Of a form that ENDS would cut, a part counts only if it is the longest and
    no sentence of its own, so no part stands for a version that it lacks.
    """
    found = {normal(form): name for name, forms in SENTENCES.items() for form in forms}
    for name, forms in SENTENCES.items():
        for form in forms:
            if not form.startswith("SPDX"):
                found.setdefault(normal(max(re.split(ENDS, form), key=len)), name)
    return found


def rule_patterns(rules: list[tuple[str, list[str]]]) -> list[tuple[str, str, str]]:
    """(licence, pattern over spaced identifiers, what stays of a match: the sentences between)."""
    made = []
    for licence, names in rules:
        parts = [" +".join(map(re.escape, name.split("+"))) for name in names]
        made.append((licence, "(?<= )" + r"((?: +\S+)*?) +".join(parts) + "(?= )", "".join(f"${k}" for k in range(1, len(parts)))))
    return made


def _ids(units: Column, known: Column) -> Column:
    """Identifiers of the units that are known sentences, in order; one that is repeated at once counts once, a version only after the terms."""
    normals = F.transform(units, lambda x: F.regexp_replace(F.trim(F.regexp_replace(F.lower(x), "[^a-z0-9]+", " ")), NOTICE, ""))
    found = F.filter(F.transform(normals, lambda x: F.element_at(known, x)), lambda x: x.isNotNull())

    def kept(ids: Column) -> Column:
        before = lambda i: F.coalesce(F.get(ids, i - 1), F.lit(""))
        return F.filter(ids, lambda x, i: (x != before(i)) & (~x.isin(*VERSION_CLAUSES) | before(i).isin(*TERMS_CLAUSES)))

    return F.get(F.transform(F.array(found), kept), F.lit(0))


def _match(ids: Column, sequences: Column, single: Column) -> Column:
    """Licences whose rule matches what earlier rules left of the sequence; rules of one sentence come last, by look-up."""
    start = F.struct(F.concat(F.lit(" "), F.array_join(ids, "  "), F.lit(" ")).alias("left"), F.array().cast("array<string>").alias("hits"))
    done = F.aggregate(
        sequences,
        start,
        lambda state, rule: F.struct(
            F.regexp_replace(state["left"], rule["pattern"], rule["stays"]).alias("left"),
            F.when(F.regexp_like(state["left"], rule["pattern"]), F.array_append(state["hits"], rule["licence"])).otherwise(state["hits"]).alias("hits"),
        ),
    )
    alone = lambda state: F.filter(F.transform(F.split(F.trim(state["left"]), " +"), lambda x: F.element_at(single, x)), lambda x: x.isNotNull())
    return F.get(F.transform(F.array(done), lambda state: F.array_union(state["hits"], alone(state))), F.lit(0))


def scan(docs: DataFrame, *, text: str = "text", licenses: str = "licenses", sentences: str = "license_sentences") -> DataFrame:
    """``docs`` plus the sorted licences found and the identifiers of the known sentences in order.

    Sentences are taken twice, cut at ENDS with other line feeds as spaces (a
    sentence may run over lines, but not over a blank one) and as whole lines (a title has no mark); a licence
    counts if its rule matches either sequence, and the longer one is returned.
    Null, empty and other texts give empty arrays; an empty table no rows.  Rows do not
    depend on each other, so repeated rows get equal results; no shuffle; columns of docs
    with a new one's name are replaced, others pass through whatever their names.
    """
    column = docs[f"`{text}`"]
    held = unused("found", docs.columns)
    known = F.create_map(*[F.lit(x) for pair in sorted(known_sentences().items()) for x in pair])
    several = [rule for rule in RULES if len(rule[1]) > 1 or "+" in rule[1][0]]
    sequences = F.array(*[F.struct(F.lit(a).alias("licence"), F.lit(b).alias("pattern"), F.lit(c).alias("stays")) for a, b, c in rule_patterns(several)])
    single = F.create_map(*[F.lit(x) for licence, names in RULES if (licence, names) not in several for x in (names[0], licence)])
    low = F.lower(column)
    hinted = F.lit(False)
    for hint in HINTS:
        hinted = hinted | F.contains(low, F.lit(hint))
    runs = _ids(F.split(column, ENDS), known)
    lines = _ids(F.split(column, "\n"), known)
    none = F.array().cast("array<string>")
    kept = [docs[f"`{c}`"] for c in docs.columns if c not in (licenses, sentences)]
    found = docs.select(*kept, F.when(hinted, F.struct(runs.alias("runs"), lines.alias("lines"))).alias(held))
    either = F.array_sort(F.array_union(_match(F.col(held)["runs"], sequences, single), _match(F.col(held)["lines"], sequences, single)))
    some = F.size(F.col(held)["runs"]) + F.size(F.col(held)["lines"]) > 0
    longer = F.when(F.size(F.col(held)["lines"]) > F.size(F.col(held)["runs"]), F.col(held)["lines"]).otherwise(F.col(held)["runs"])
    names = [F.col(f"`{c}`") for c in docs.columns if c not in (licenses, sentences)]
    return found.select(*names, F.coalesce(F.when(some, either), none).alias(licenses), F.coalesce(longer, none).alias(sentences))
