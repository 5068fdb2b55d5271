"""Licence scans by conditional compression.

Each template has a telling word that no confirmed wording lacks. Around each such word, a window of the
template's length and as many words more on either side (at least SLACK) is a candidate block, if it has enough of
the template's words; a word that tells another licence ends it. A block is compressed on its own and with each of
its templates as raw zstandard dictionary; the templates are ranked by the bytes that this saves, relative to their
size. Blocks don't end at line breaks: notices are wrapped, and marks of comments are no words. Exact wording confirms:
the differences between the words of the block and of a template may not touch the words that tell the licence, nor
be more than a share of the template. Between a version and the words before it there may be no other version,
except in a list ('version 2 or version 3'), and no end of a sentence, except before the word 'version' itself.
A notice that its sentence takes back ('not', 'no longer', 'formerly' within it or in the ``BEFORE`` words before it)
isn't confirmed. Every licence that is confirmed counts; of the wordings of one licence over the same words, the first
does, and a wording inside another one of a third more words doesn't count beside it (the first sentence of a
longer text). Tags 'SPDX-License-Identifier:' are read as they stand, with every licence of their expression.

Null and empty texts have no blocks. Long texts are scanned whole. Of templates that save equally much, the one that
TEMPLATES lists first is confirmed first. Every row gets its own result; repeated rows get equal ones. Other
columns aren't read. An empty table gives an empty result.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Callable, Iterator
from difflib import SequenceMatcher

import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from loomgraph.llm.common import two

WORD = re.compile(r"[^\W_]+(?:[.+][^\W_]+)*")
BSD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
    "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
)
#: name: (wordings, words that tell the licence)
TEMPLATES: dict[str, tuple[list[str], str]] = {
    "MIT": (["Released under the MIT License.", "Licensed under the MIT License.", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"], "mit|permission granted charge copy"),
    "Apache-2.0": (["Licensed under the Apache License, Version 2.0.", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License."], "apache 2.0"),
    "GPL-3.0": (["This work is licensed under the GNU General Public License, version 3.", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."], "gnu general public 3"),
    "GPL-2.0": (["This work is licensed under the GNU General Public License, version 2.", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."], "gnu general public 2"),
    "LGPL-3.0": (["This library is licensed under the GNU Lesser General Public License, version 3.", "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."], "gnu lesser public 3"),
    "AGPL-3.0": (["This work is licensed under the GNU Affero General Public License, version 3.", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."], "gnu affero public 3"),
    "BSD-3-Clause": (["Licensed under the BSD 3-Clause License.", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", BSD + " 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."], "bsd 3|redistribution source neither endorse promote|redistribution source binary permitted conditions"),
    "BSD-2-Clause": (["Licensed under the BSD 2-Clause License.", BSD], "bsd 2|redistribution source binary retain reproduce"),
    "ISC": (["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.", "Licensed under the ISC License."], "fee granted appear copies|isc"),
    "Unlicense": (["This is free and unencumbered software released into the public domain."], "unencumbered public domain"),
    "MPL-2.0": (["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "Licensed under the Mozilla Public License, version 2.0."], "mozilla public 2.0"),
    "CC-BY-4.0": (["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."], "cc by 4.0|creative commons attribution 4.0"),
    "CC-BY-SA-4.0": (["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."], "cc by sa 4.0|creative commons attribution sharealike 4.0"),
    "CC-BY-NC-4.0": (["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."], "cc by nc 4.0|creative commons attribution noncommercial 4.0"),
    "CC0-1.0": (["Dedicated to the public domain under CC0 1.0."], "cc0 1.0"),
    "Proprietary": (["Copyright. All rights reserved."], "all rights reserved"),
}
#: words that make another licence of it when only the block has them
TELLING = {w for _, told in TEMPLATES.values() for x in told.split("|") for w in x.split()} - {"by", "all", "copy", "source", "charge", "conditions", "permission", "granted", "permitted", "binary", "public", "general", "2", "3", "4.0", "1.0", "2.0", "fee", "appear", "copies", "domain", "neither", "endorse", "promote", "retain", "reproduce"} | {"nd", "noderivatives"}
SLACK = 20
#: the words that may stand between the versions of a list
LISTED = {"or", "and", "either", "version", "versions", "v", "any", "later", "clause"}
#: words that take a notice back, within it or among so many words before it
TAKEN_BACK = {"not", "never", "isn", "wasn", "aren", "weren", "longer", "formerly", "previously", "neither", "nor", "cannot"}
BEFORE = 6
SPDX = re.compile(r"(?i)SPDX-License-Identifier:[ \t]*([A-Za-z0-9.+\-() \t]+)")
STOP = re.compile(r"[.!?]\s|\n\W*\n")


def words(text: str) -> list[str]:
    return [w.lower() for w in WORD.findall(text)]


def anchor(tell: set[str]) -> str:
    """The rarest of the words that tell a licence; no template has it twice."""
    return next(w for w in ("affero", "lesser", "gnu", "apache", "mozilla", "bsd", "redistribution", "cc0", "cc", "commons", "reserved", "charge", "mit", "isc", "unencumbered", "fee") if w in tell)


class Scanner:
    def __init__(self, most: float = 0.34):
        self.most, self.templates, self.at = most, [], {}
        self.code = {w: k for k, w in enumerate(sorted(TELLING | LISTED | TAKEN_BACK | {w for texts, _ in TEMPLATES.values() for t in texts for w in words(t)}), 1)}
        self.back = {self.code[w] for w in TAKEN_BACK}
        self.listed = {self.code[w] for w in LISTED}
        self.numbers = {c for w, c in self.code.items() if w[0].isdigit()} | {-1}
        for name, (texts, told) in TEMPLATES.items():
            for t in texts:
                d = zstandard.ZstdCompressionDict(t.encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
                tell = next(set(x.split()) for x in told.split("|") if set(x.split()) <= set(words(t)))
                mine = [self.code[w] for w in words(t)]
                self.at.setdefault(self.code[anchor(tell)], []).append(len(self.templates))
                self.templates.append((name, mine, {self.code[w] for w in tell}, {self.code[w] for w in TELLING} - set(mine), zstandard.ZstdCompressor(level=3, dict_data=d, write_content_size=False, write_dict_id=False), len(t.encode())))
        self.alone = zstandard.ZstdCompressor(level=3, write_content_size=False)
        self.likely = "(?i)SPDX-License-Identifier:|(?:^|[^A-Za-z0-9])(?:" + "|".join(sorted(w for w, c in self.code.items() if c in self.at)) + ")(?:$|[^A-Za-z0-9])"
        self.hint = re.compile(self.likely)

    def candidates(self, told: array) -> Iterator[tuple[int, int, int, int]]:
        """Template, first word, end and telling word of each block; one that reaches a second telling word is also given cut there."""
        for a in (k for k, c in enumerate(told) if c in self.at):
            for i in self.at[told[a]]:
                _, mine, tell, foreign, _, _ = self.templates[i]
                reach, n = len(mine) + max(SLACK, len(mine)), len(told)
                lo = next((k + 1 for k in range(a - 1, max(-1, a - reach - 1), -1) if told[k] in foreign), max(0, a - reach))
                hi = next((k for k in range(a + 1, min(n, a + reach + 1)) if told[k] in foreign), min(n, a + reach + 1))
                near = next((k + 1 for k in range(a - 1, lo - 1, -1) if told[k] == told[a]), lo)
                far = next((k for k in range(a + 1, hi) if told[k] == told[a]), hi)
                for x, y in dict.fromkeys(((lo, hi), (near, far))):
                    there = set(told[x:y])
                    if tell <= there and sum(w not in there for w in mine) <= self.most * len(mine):
                        yield i, x, y, a

    def confirmed(self, i: int, told: array, lo: int, hi: int, a: int, gap: Callable[[int, int], str]) -> tuple[int, int, int, int] | None:
        """First word, end, template words missing and words beside the template, if the wording is the template's and has word a; gap tells what is between two words."""
        _, mine, tell, foreign, _, _ = self.templates[i]
        block = told[lo:hi].tolist()
        same = [m for m in SequenceMatcher(None, block, mine, autojunk=False).get_matching_blocks() if m.size]
        at = [k for m in same for k in range(m.a, m.a + m.size)]
        common = len(at)
        if a - lo not in at or not tell <= {block[k] for k in at} or len(mine) - common > self.most * len(mine):
            return None
        back = self.back.difference(mine)
        for k in range(lo + at[0] - 1, max(-1, lo + at[0] - 1 - BEFORE), -1):
            if STOP.search(gap(k, k + 1)):
                break
            if told[k] in back:
                return None
        for before, k in zip(at, at[1:]):
            between = block[before + 1 : k]
            if foreign.intersection(between) or back.intersection(between):
                return None
            if block[k] in tell & self.numbers:
                if self.numbers.intersection(between) and not self.listed.union(self.numbers).issuperset(between):
                    return None
                if block[k - 1] not in self.listed and STOP.search(gap(lo + before, lo + k)):
                    return None
        return lo + at[0], lo + at[-1] + 1, len(mine) - common, at[-1] + 1 - at[0] - common

    def scan(self, text: str) -> tuple[int, list[tuple[int, str, float, int, int]]]:
        """How many blocks, and of each notice its first character, licence, share of the block's bytes saved, template words missing and words beside the template."""
        told, starts, ends = array("i"), array("q"), array("q")
        if not self.hint.search(text):
            return 0, []
        for w in WORD.finditer(text):
            x = w[0].lower()
            told.append(self.code.get(x, -1 if x[0].isdigit() else 0))
            starts.append(w.start())
            ends.append(w.end())
        ranked, alone, sure, kept = [], {}, [], []
        for i, lo, hi, a in self.candidates(told):
            block = text[starts[lo] : ends[hi - 1]].encode()
            if block not in alone:
                alone[block] = len(self.alone.compress(block))
            saved = alone[block] - len(self.templates[i][4].compress(block))
            ranked.append((-saved / self.templates[i][5], i, lo, hi, a, saved / alone[block]))
        for _, i, lo, hi, a, saved in sorted(ranked):
            got = self.confirmed(i, told, lo, hi, a, lambda x, y: text[ends[x] : starts[y]])
            if got:
                sure.append((got[0], got[1], self.templates[i][0], saved, *got[2:], len(self.templates[i][1]) - got[2]))
        for k in sure:
            inside = any(j[0] <= k[0] and k[1] <= j[1] and 3 * j[-1] >= 4 * k[-1] for j in sure)
            if not inside and not any(name == k[2] and x < k[1] and k[0] < y for x, y, name, *_ in kept):
                kept.append(k)
        tags = [(m.start(), x, 0.0, 0, 0) for m in SPDX.finditer(text) for x in tagged(m[1])]
        return len({a for _, _, _, _, a, _ in ranked}) + len({x for x, *_ in tags}), sorted([*tags, *((starts[x], *rest[:-1]) for x, _, *rest in kept)])


def tagged(expression: str) -> list[str]:
    """The licences of an SPDX expression, without exceptions; 'only', 'or-later' and '+' don't make another one."""
    found, before = [], "OR"
    for w in re.findall(r"[A-Za-z0-9.+\-]+", expression):
        if w.upper() not in ("AND", "OR", "WITH"):
            if not before:
                break  # without an operator the expression has ended
            if before != "WITH":
                found.append(re.sub(r"(-only|-or-later|\+)$", "", w))
            before = ""
        else:
            before = w.upper()
    return found


FOUND = T.ArrayType(T.StructType([T.StructField("line", T.IntegerType()), T.StructField("license", T.StringType()), T.StructField("saved", T.DoubleType()), T.StructField("missing", T.IntegerType()), T.StructField("extra", T.IntegerType())]))


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For each row n_blocks (telling words with candidate blocks), licenses (distinct, sorted), found (line from 0, licence, share saved, words missing and, within the notice, extra)."""
    small = two(df, id_col, text_col)
    out = T.StructType([T.StructField(id_col, small.schema["id"].dataType), T.StructField("n_blocks", T.IntegerType()), T.StructField("licenses", T.ArrayType(T.StringType())), T.StructField("found", FOUND)])

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner, schema = Scanner(), to_arrow_schema(out)
        for b in batches:
            n, names, found = [0] * b.num_rows, [[] for _ in range(b.num_rows)], [[] for _ in range(b.num_rows)]
            likely = pc.fill_null(pc.match_substring_regex(b.column(1), scanner.likely), False)
            rows = pc.indices_nonzero(likely).to_pylist()
            for i, text in zip(rows, b.column(1).filter(likely).to_pylist()):
                n[i], got = scanner.scan(text)
                found[i] = [dict(zip(("line", "license", "saved", "missing", "extra"), (text.count("\n", 0, x[0]), *x[1:]))) for x in got]
                names[i] = sorted({f["license"] for f in found[i]})
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(x, f.type) for x, f in zip((n, names, found), list(schema)[1:]))], schema=schema)

    return small.mapInArrow(apply, out)
