"""License scans by conditional compression.

Lines with a word that license statements use (a cue) are candidates, alone and together with adjoining ones. A candidate block
is compressed with zstandard, plain and with each template as raw-content dictionary; the template that saves the largest share
of the bytes wins. The winner is confirmed by exact wording: words of template and block are aligned, and of the template's
fixed words at most DIFFER of them may be missing or changed, with no more of other words between; places for years, names and
versions are free. Blocks that no template confirms are not reported.

A cue that no such block accounts for may stand in a notice wrapped over lines, or in a statement within a longer line. Each template
is laid over the words around it, up to the next blank lines; of the parts that its wording confirms, compressed alone, the one that
saves most bytes wins. It is reported unless the same license is already reported of an overlapping block.

Defined cases: null and empty texts have no blocks. Templates that save equally much rank by their name. Rows each have their own
results; a block that occurs twice in a text is reported at each place. Very long texts and lines are read whole. Within a line or paragraph, a place for names holds at most
SLOT words. Other columns are not read, whatever they are called, and an empty table gives an empty result.
"""

from __future__ import annotations

import difflib
import re
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shipped

LEVEL = 9
#: A template must save at least this share of the bytes that a block takes alone.
LEAST_SAVED = 0.25
DIFFER = 0.15
SLOT = 12

#: Wording of public license statements; * stands for years, names and versions.
TEMPLATES = {
    "Apache": [
        "Licensed under the Apache License, Version *.",
        'Licensed under the Apache License, Version * (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at *',
    ],
    "MIT": [
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "Distributed under the MIT License.",
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software',
    ],
    "GPL": [
        "This work is licensed under the GNU General Public License, version *.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version * of the License, or (at your option) any later version.",
    ],
    "LGPL": [
        "This work is licensed under the GNU Lesser General Public License, version *.",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License, version *.",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version * of the License, or (at your option) any later version.",
    ],
    "AGPL": [
        "This work is licensed under the GNU Affero General Public License, version *.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version * of the License, or (at your option) any later version.",
    ],
    "MPL": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. *."],
    "BSD": [
        "Released under the BSD License.",
        "Licensed under the BSD License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    ],
    "ISC": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."],
    "CC-BY": ["Licensed under CC BY *.", "This work is licensed under a Creative Commons Attribution * International License."],
    "CC-BY-SA": ["Licensed under CC BY-SA *.", "This work is licensed under a Creative Commons Attribution-ShareAlike * International License."],
    "CC-BY-NC": ["Licensed under CC BY-NC *.", "This work is licensed under a Creative Commons Attribution-NonCommercial * International License."],
    "CC-BY-ND": ["Licensed under CC BY-ND *."],
    "CC0": ["To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."],
    "Unlicense": ["This is free and unencumbered software released into the public domain."],
    "Proprietary": ["Copyright * All rights reserved.", "All rights reserved."],
}
#: Identifiers of SPDX lines, by license.
SPDX = {
    "Apache": "Apache-2.0", "MIT": "MIT", "MPL": "MPL-2.0", "BSD": "BSD-2-Clause BSD-3-Clause", "ISC": "ISC", "CC0": "CC0-1.0", "Unlicense": "Unlicense",
    "GPL": "GPL-2.0 GPL-2.0-only GPL-2.0-or-later GPL-3.0 GPL-3.0-only GPL-3.0-or-later",
    "LGPL": "LGPL-2.1 LGPL-2.1-only LGPL-2.1-or-later LGPL-3.0 LGPL-3.0-only LGPL-3.0-or-later", "AGPL": "AGPL-3.0 AGPL-3.0-only AGPL-3.0-or-later",
    "CC-BY": "CC-BY-4.0", "CC-BY-SA": "CC-BY-SA-4.0", "CC-BY-NC": "CC-BY-NC-4.0", "CC-BY-ND": "CC-BY-ND-4.0",
}
for _name, _ids in SPDX.items():
    TEMPLATES[_name] += [f"SPDX-License-Identifier: {x}" for x in _ids.split()]
#: Words that mark a line as a candidate.
CUES = r"(?i)licen[cs]e|copyright|all\W+rights\W+reserved|public\W+domain|permission|redistribut|waived|free\W+software"
CUE = re.compile(CUES)
WORD = re.compile(r"[^\W_]+(?:[-.'][^\W_]+)*|\*")


@lru_cache(1)
def templates() -> list[tuple[str, str, zstandard.ZstdCompressor, list[str]]]:
    out = []
    for name, texts in sorted(TEMPLATES.items()):
        for text in texts:
            raw = zstandard.ZstdCompressionDict(text.replace("*", "").encode().rjust(8), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            out.append((name, text, zstandard.ZstdCompressor(level=LEVEL, dict_data=raw), words(text)))
    return out


PLAIN = zstandard.ZstdCompressor(level=LEVEL)


def words(text: str) -> list[str]:
    return [w.lower() for w in WORD.findall(text)]


def aligned(template: list[str], block: list[str]) -> tuple[int, int, int, int]:
    """(fixed words of the template that are missing or changed, words between matched ones that the template has not,
    first and last matched word of the block)."""
    missing = extra = 0
    fixed = [w for w in template if w != "*"]
    slots = {sum(w != "*" for w in template[:i]) for i, w in enumerate(template) if w == "*"}
    ops = difflib.SequenceMatcher(None, fixed, block, autojunk=False).get_opcodes()
    for tag, a, b, c, d in ops:
        if tag != "equal":
            missing += b - a
            inside = 0 < a < len(fixed) or tag == "replace"
            free = any(a <= s <= b for s in slots)
            extra += 0 if free or not inside else d - c
    same = [(c, d) for tag, _, _, c, d in ops if tag == "equal"]
    return missing, extra, *((same[0][0], same[-1][1] - 1) if same else (0, -1))


def differences(template: list[str], block: list[str]) -> tuple[int, int]:
    return aligned(template, block)[:2]


def tokens(text: str, start: int, stop: int) -> list[tuple[int, int, str]]:
    """(begin, end, word) of the words of a part of a text; * only marks places of templates."""
    return [(m.start(), m.end(), m[0].lower()) for m in WORD.finditer(text, start, stop) if m[0] != "*"]


#: Blocks up to this long are remembered, so that the 20,000 of them that a worker keeps stay in bounds.
REMEMBERED = 2_000


def best(block: str) -> tuple | None:
    return _remembered(block) if len(block) <= REMEMBERED else _best(block)


@lru_cache(20_000)
def _remembered(block: str) -> tuple | None:
    return _best(block)


def _best(block: str) -> tuple | None:
    """(license, template, plain size, size with the template, missing, extra, begin and end of the matched part) of the
    winner, if its wording confirms it."""
    raw = block.encode()
    plain = len(PLAIN.compress(raw))
    ranked = sorted((len(z.compress(raw)), name, text, own) for name, text, z, own in templates())
    mine = tokens(block, 0, len(block))
    for size, name, text, own in ranked:
        if (plain - size) / plain < LEAST_SAVED:
            return None
        missing, extra, first, last = aligned(own, [w for _, _, w in mine])
        if missing + extra <= DIFFER * sum(w != "*" for w in own):
            return name, text, plain, size, missing, extra, mine[first][0], mine[last][1]
    return None


def blocks(text: str) -> Iterator[tuple[int, int, str]]:
    """(first line, last line, text) of the candidates: each line with a cue, and each run of two or more of them."""
    lines = text.split("\n")
    run: list[int] = []
    for i, line in enumerate([*lines, ""]):
        if i < len(lines) and CUE.search(line):
            run.append(i)
            yield i, i, line
        else:
            if len(run) > 1:
                yield run[0], run[-1], " ".join(lines[run[0] : run[-1] + 1])
            run = []


def cue_key(cue: str) -> str:
    return re.sub(r"\W+", " ", cue.lower()).replace("licence", "license")


@lru_cache(1)
def by_cue() -> dict[str, list[tuple]]:
    """For each cue: (license, template, compressor, words, fixed words, words to read before the cue and from it on)."""
    out: dict[str, list[tuple]] = {}
    for name, text, z, own in templates():
        starts = [m.start() for m in WORD.finditer(text)]
        slack = 1 + int(DIFFER * len(own))
        reach = [SLOT if w == "*" else 1 for w in own]
        for cue in CUE.finditer(text):
            at = bisect_right(starts, cue.start()) - 1
            out.setdefault(cue_key(cue[0]), []).append((name, text, z, own, {w for w in own if w != "*"}, sum(reach[:at]) + slack, sum(reach[at:]) + slack))
    return out


def around(text: str, own: list[tuple[int, int, str]], at: int, cue: str) -> tuple | None:
    """What best() returns, of the part of a paragraph around the cue in its word ``at``; places are those in the text."""
    found = []
    for name, template, z, wanted, fixed, before, behind in by_cue().get(cue_key(cue), ()):
        lo = max(0, at - before)
        near = [w for _, _, w in own[lo : at + behind]]
        least = DIFFER * sum(w != "*" for w in wanted)
        if len(fixed.difference(near)) > least:
            continue
        missing, extra, first, last = aligned(wanted, near)
        if missing + extra > least or not lo + first <= at <= lo + last:
            continue
        last = min(lo + last + (wanted[-1] == "*"), len(own) - 1)
        begin, end = own[lo + first][0], own[last][1]
        raw = unwrapped(text[begin:end]).encode()
        plain, size = len(PLAIN.compress(raw)), len(z.compress(raw))
        if (plain - size) / plain >= LEAST_SAVED:
            found.append((size - plain, name, template, plain, size, missing, extra, begin, end))
    return min(found)[1:] if found else None


def unwrapped(text: str) -> str:
    """Without line breaks and the marks of comments behind them."""
    return re.sub(r"\s*\n[\s*#/;%>-]*", " ", text)


def statements(text: str) -> list[tuple]:
    """(first line, last line, license, template, plain size, size with the template, missing, extra, block) of a text."""
    out, spans = [], []
    starts = [0, *[m.end() for m in re.finditer("\n", text)]]
    for first, last, block in blocks(text):
        if (got := best(block)) and not (last > first and any(first <= x[0] <= last and x[2] == got[0] for x in out)):
            out.append((first, last, *got[:6], block))
            spans.append((starts[first] + got[6], starts[first] + got[7], got[0]))
    paragraph, own = (0, -1), []
    for cue in CUE.finditer(text):
        at = cue.start()
        if any(lo <= at < hi for lo, hi, _ in spans):
            continue
        if not paragraph[0] <= at < paragraph[1]:
            line = stop = bisect_right(starts, at) - 1
            blank = lambda i: not text[starts[i] : starts[i + 1] if i + 1 < len(starts) else len(text)].strip()
            while line > 0 and not blank(line - 1):
                line -= 1
            while stop + 1 < len(starts) and not blank(stop + 1):
                stop += 1
            paragraph = starts[line], starts[stop + 1] if stop + 1 < len(starts) else len(text)
            own = tokens(text, *paragraph)
            begins = [x[0] for x in own]
        got = around(text, own, bisect_right(begins, at) - 1, cue[0])
        if got and not any(lo < got[7] and got[6] < hi and name == got[0] for lo, hi, name in spans):
            lines = (bisect_right(starts, x) - 1 for x in (got[6], got[7] - 1))
            out.append((*lines, *got[:6], unwrapped(text[got[6] : got[7]])))
            spans.append((got[6], got[7], got[0]))
    return sorted(out, key=lambda x: x[:2])


SCHEMA = "doc_id long, first_line int, last_line int, license string, template string, plain_bytes int, conditional_bytes int, saved double, n_missing int, n_extra int, block string"


def scan(docs: DataFrame) -> DataFrame:
    """License statements of every (doc_id, text). A run of lines is reported if no line of it is of the same license."""
    types = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "double": pa.float64()}
    schema = pa.schema([(n, types[t]) for n, t in (x.split(" ") for x in SCHEMA.split(", "))])

    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for first, last, name, template, plain, size, missing, extra, block in statements(text):
                    rows.append((doc_id, first, last, name, template, plain, size, (plain - size) / plain, missing, extra, block))
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows) if rows else [()] * len(schema), schema.types)], schema=schema)

    return shipped(docs).select("doc_id", "text").filter(F.col("text").rlike(CUES)).mapInArrow(run, SCHEMA)
