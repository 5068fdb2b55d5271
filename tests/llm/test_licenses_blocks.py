"""Licence notices inside long lines, wrapped over lines, and beside each other."""

import random

from loomgraph.llm import licenses

PROSE = "The river runs below the old mill, and nobody remembers who had built its wheel with so much care. "


def prose(n):
    """Text that doesn't compress to nothing."""
    r = random.Random(n)
    return " ".join("".join(r.choice("abdefghiklmnoprstuvw") for _ in range(r.randrange(2, 10))) for _ in range(n)) + ". "


def names(make, docs):
    return {x["doc_id"]: x["licenses"] for x in licenses.scan(make(list(enumerate(docs)))).collect()}


def test_notice_in_a_paragraph(make):
    mit, gpl = "Released under the MIT License. ", "This work is licensed under the GNU General Public License, version 3. "
    docs = [prose(n) + x + prose(n + 1) for n in (50, 150, 2500) for x in (mit, gpl)]
    assert names(make, docs) == {k: [["MIT"], ["GPL-3.0"]][k % 2] for k in range(len(docs))}


def test_paragraphs_without_a_notice(make):
    docs = [
        PROSE * 5 + "We went mit ihm to get a driving license. " + PROSE * 5,
        PROSE * 5 + "Licensed under CC BY-NC-ND 4.0. " + PROSE * 5,
        PROSE * 5 + "MIT released a report under embargo. " + PROSE * 5,
    ]
    assert names(make, docs) == {0: [], 1: [], 2: []}
    one = PROSE * 9 + "This work is licensed under the GNU General Public License, version 2. See section 3. " + PROSE
    assert names(make, [one]) == {0: ["GPL-2.0"]}


WRAPPED = {
    "MIT": """// Permission is hereby granted, free of charge, to any
// person obtaining a copy of this software and
// associated documentation files (the "Software"), to deal""",
    "Apache-2.0": """# Licensed under the Apache License,
# Version 2.0 (the "License"); you may not use this file
# except in compliance with the License.""",
    "GPL-3.0": """ * This program is free software: you can redistribute it and/or
 * modify it under the terms of the GNU General Public License as
 * published by the Free Software Foundation, either
 * version 3 of the License, or (at your option) any later version.""",
    "BSD-3-Clause": "Redistribution and use in source and binary\n\tforms, with or without modification, are\n\tpermitted provided that the following conditions are met:",
}


def test_notice_over_several_lines(make):
    assert names(make, [f"{prose(9)}\n\n{x}\n{prose(8)}" for x in WRAPPED.values()]) == {k: [x] for k, x in enumerate(WRAPPED)}
    found = licenses.scan(make([(1, f"{prose(9)}\n\n{WRAPPED['GPL-3.0']}")])).collect()[0]["found"]
    assert [(x["line"], x["license"], x["missing"]) for x in found] == [(2, "GPL-3.0", 0)]


def test_two_licences_beside_each_other(make):
    docs = {
        "Licensed under the MIT License and the Apache License, Version 2.0.": ["Apache-2.0", "MIT"],
        "Released under the MIT License. Licensed under CC BY 4.0. Licensed under CC BY-SA 4.0.": ["CC-BY-4.0", "CC-BY-SA-4.0", "MIT"],
        "This work is licensed under the GNU General Public License, version 2 or version 3.": ["GPL-2.0", "GPL-3.0"],
        "\n".join(WRAPPED.values()): sorted(WRAPPED),
        "This work is licensed under the GNU Lesser General Public License, version 3.": ["LGPL-3.0"],
        "This work is licensed under the GNU General Public License.\n\n3 cups of flour": [],
    }
    assert names(make, list(docs)) == dict(enumerate(docs.values()))


TAKEN_BACK = {
    "This is not released under the MIT License.": [],
    "Formerly licensed under the Apache License, Version 2.0, it is now proprietary.": [],
    "The code is no longer released under the MIT License. Licensed under CC BY 4.0.": ["CC-BY-4.0"],
    "This software isn't licensed under CC BY 4.0.": [],
    "It doesn't matter, we do not care. Released under the MIT License.": ["MIT"],
}
TAGS = {
    "# SPDX-License-Identifier: MIT": ["MIT"],
    "/* SPDX-License-Identifier: (GPL-2.0-or-later OR Apache-2.0) */": ["Apache-2.0", "GPL-2.0"],
    "SPDX-License-Identifier: GPL-2.0 WITH Linux-syscall-note\nx": ["GPL-2.0"],
    "SPDX-License-Identifier: \n": [],
}


def test_notices_that_are_taken_back_and_tags(make):
    docs = {**TAKEN_BACK, **TAGS}
    assert names(make, list(docs)) == dict(enumerate(docs.values()))


def test_the_longer_text_counts(make):
    bsd3 = licenses.TEMPLATES["BSD-3-Clause"][0][2]
    docs = [bsd3, licenses.BSD, licenses.BSD.replace(" ", "\n * "), bsd3[:140], prose(400) + bsd3 + prose(30)]
    assert names(make, docs) == {0: ["BSD-3-Clause"], 1: ["BSD-2-Clause"], 2: ["BSD-2-Clause"], 3: ["BSD-3-Clause"], 4: ["BSD-3-Clause"]}


def every_wording(text):
    """Each template at each of its words in the text, confirmed by wording alone, without candidates or compression."""
    s = licenses.Scanner()
    at = list(licenses.WORD.finditer(text))
    told = [s.code.get(m[0].lower(), -1 if m[0][0].isdigit() else 0) for m in at]
    found = []
    for i, (name, mine, tell, foreign, *_) in enumerate(s.templates):
        for a, c in enumerate(told):
            if c in tell and c in s.at:
                reach = len(mine) + max(licenses.SLACK, len(mine))
                for same in (False, True):
                    lo = next((k + 1 for k in range(a - 1, max(-1, a - reach - 1), -1) if told[k] in foreign or same and told[k] == c), max(0, a - reach))
                    hi = next((k for k in range(a + 1, min(len(told), a + reach + 1)) if told[k] in foreign or same and told[k] == c), min(len(told), a + reach + 1))
                    got = s.confirmed(i, told_array(told), lo, hi, a, lambda x, y: text[at[x].end() : at[y].start()])
                    if got:
                        found.append((*got, name, len(mine)))
    return sorted({f[4] for f in found if not any(g[0] <= f[0] and f[1] <= g[1] and 3 * (g[5] - g[2]) >= 4 * (f[5] - f[2]) for g in found)})


def told_array(told):
    from array import array

    return array("i", told)


def test_scan_is_every_wording(make):
    r = random.Random(3)
    notices = [t for texts, _ in licenses.TEMPLATES.values() for t in texts] + list(TAKEN_BACK)
    docs = []
    for n in range(60):
        parts = [prose(r.choice([2, 20, 90])) + "\n\n" * r.randrange(2)]
        for _ in range(r.choice([0, 1, 1, 2])):
            x = r.choice(notices).split(" ")
            if r.random() < 0.3 and len(x) > 8:
                x[r.randrange(len(x))] = r.choice(["such", "any", "MIT", "not", "2"])
            parts += [r.choice([" ", "\n# ", "\n"]).join(x) if r.random() < 0.3 else " ".join(x), r.choice([" ", "\n\n"]) + prose(r.choice([3, 30]))]
        docs.append("".join(parts))
    assert names(make, docs) == {k: every_wording(t) for k, t in enumerate(docs)}


def test_long_texts_nulls_and_repeated_rows(make):
    rows = [(1, None), (2, ""), (3, prose(200_000) + "Released under the MIT License."), (3, "Licensed under CC BY 4.0."), (None, "Licensed under CC BY 4.0."), (4, "mit " * 20_000)]
    got = sorted((x["doc_id"] or 0, x["licenses"]) for x in licenses.scan(make(rows)).collect())
    assert got == [(0, ["CC-BY-4.0"]), (1, []), (2, []), (3, ["CC-BY-4.0"]), (3, ["MIT"]), (4, [])]
