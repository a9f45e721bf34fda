"""License notices found by conditional compression and exact wording.

A text that names a licensing term is read as words, over line breaks. Wherever enough of a template's
word pairs stand near one diagonal, a candidate block is proposed: a window sized from the template.
Every proposed block is compressed plain and with each template as a zstandard raw-content dictionary:
the more of a template's wording the block repeats, the more bytes its dictionary saves. The templates
are ranked by that, and only those that save nearly as much as the best, ``NEARLY`` of its bytes, are
compared word by word. A template is confirmed if the words of it that the block lacks and the
words inside the matched span that the template lacks are at most ``MAX_DIFFERENCE`` of its words, no
lacking word has a digit (a version), no differing word belongs to the name of a license, and the
sentence does not deny it right before the span (``NEGATIONS``).

What no confirmed notice covers is cut into sentences and lines; runs of them that name licensing
terms, with ``MAX_GAP`` others between them at most, form the other candidate blocks. They are ranked in
the same way; of those that save nearly as much as the best, the template with the fewest differences is
named as the nearest, unconfirmed. The two limits decide what is reported of unconfirmed blocks, no notice.

Defined results: a row per confirmed notice and per other candidate block, in text order; ``begin`` is
where the line or sentence of its first word begins; documents without a candidate give no row. A null
or empty text has no block. Texts are read whole; equal blocks of one document are separate rows. Rows
that repeat an id are scanned one by one. An empty table gives an empty result. Other columns are not
read.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import defaultdict
from collections.abc import Iterator
from difflib import SequenceMatcher
from functools import lru_cache, reduce
from operator import or_

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Public license notices.
TEMPLATES = {
    "MIT": (
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "SPDX-License-Identifier: MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
        'associated documentation files (the "Software"), to deal in the Software without restriction, including '
        "without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell "
        "copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the "
        "following conditions: The above copyright notice and this permission notice shall be included in all "
        'copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF '
        "ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS "
        "FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.",
        "License: MIT",
    ),
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        "SPDX-License-Identifier: Apache-2.0",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in '
        "compliance with the License. You may obtain a copy of the License at "
        "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, "
        'software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR '
        "CONDITIONS OF ANY KIND, either express or implied.",
        "License: Apache-2.0",
        "Licensed under the Apache License 2.0.",
    ),
    "GPL-3.0": (
        "This work is licensed under the GNU General Public License, version 3.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU "
        "General Public License as published by the Free Software Foundation, either version 3 of the License, or "
        "(at your option) any later version.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU "
        "General Public License as published by the Free Software Foundation, version 3 of the License.",
        "SPDX-License-Identifier: GPL-3.0-only",
    ),
    "GPL-2.0": (
        "This work is licensed under the GNU General Public License, version 2.",
        "SPDX-License-Identifier: GPL-2.0-only",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU "
        "General Public License as published by the Free Software Foundation; either version 2 of the License, or "
        "(at your option) any later version.",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU "
        "General Public License as published by the Free Software Foundation; version 2 of the License.",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU "
        "General Public License version 2 as published by the Free Software Foundation.",
        "SPDX-License-Identifier: GPL-2.0-or-later",
    ),
    "AGPL-3.0": (
        "This work is licensed under the GNU Affero General Public License, version 3.",
        "SPDX-License-Identifier: AGPL-3.0-or-later",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero "
        "General Public License as published by the Free Software Foundation, either version 3 of the License, or "
        "(at your option) any later version.",
        "SPDX-License-Identifier: AGPL-3.0-only",
    ),
    "LGPL-3.0": (
        "This work is licensed under the GNU Lesser General Public License, version 3.",
        "SPDX-License-Identifier: LGPL-3.0-or-later",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser "
        "General Public License as published by the Free Software Foundation, either version 3 of the License, or "
        "(at your option) any later version.",
        "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser "
        "General Public License as published by the Free Software Foundation, either version 3 of the License, or "
        "(at your option) any later version.",
        "SPDX-License-Identifier: LGPL-3.0-only",
    ),
    "LGPL-2.1": (
        "This work is licensed under the GNU Lesser General Public License, version 2.1.",
        "SPDX-License-Identifier: LGPL-2.1-or-later",
        "SPDX-License-Identifier: LGPL-2.1-only",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser "
        "General Public License as published by the Free Software Foundation; either version 2.1 of the License, or "
        "(at your option) any later version.",
    ),
    "EPL-2.0": (
        "SPDX-License-Identifier: EPL-2.0",
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License "
        "2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",
    ),
    "BSL-1.0": ("Distributed under the Boost Software License, Version 1.0.", "SPDX-License-Identifier: BSL-1.0"),
    "Zlib": (
        "SPDX-License-Identifier: Zlib",
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be "
        "held liable for any damages arising from the use of this software. Permission is granted to anyone to use "
        "this software for any purpose, including commercial applications, and to alter it and redistribute it freely",
    ),
    "MPL-2.0": (
        "SPDX-License-Identifier: MPL-2.0",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL "
        "was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    ),
    "BSD-3-Clause": (
        "Released under the 3-Clause BSD License.",
        "SPDX-License-Identifier: BSD-3-Clause",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided "
        "that the following conditions are met: Redistributions of source code must retain the above copyright "
        "notice, this list of conditions and the following disclaimer. Redistributions in binary form must "
        "reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
        "documentation and/or other materials provided with the distribution. Neither the name of the copyright "
        "holder nor the names of its contributors may be used to endorse or promote products derived from this "
        "software without specific prior written permission.",
    ),
    "BSD-2-Clause": (
        "Released under the 2-Clause BSD License.",
        "SPDX-License-Identifier: BSD-2-Clause",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided "
        "that the following conditions are met: Redistributions of source code must retain the above copyright "
        "notice, this list of conditions and the following disclaimer. Redistributions in binary form must "
        "reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
        "documentation and/or other materials provided with the distribution.",
    ),
    "ISC": (
        "SPDX-License-Identifier: ISC",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is "
        "hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    ),
    "CC-BY-4.0": ("Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    "CC-BY-SA-4.0": (
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    ),
    "CC-BY-NC-4.0": (
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    ),
    "CC-BY-ND-4.0": (
        "Licensed under CC BY-ND 4.0.",
        "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.",
    ),
    "CC-BY-NC-SA-4.0": (
        "Licensed under CC BY-NC-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License.",
    ),
    "CC-BY-NC-ND-4.0": (
        "Licensed under CC BY-NC-ND 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License.",
    ),
    "CC0-1.0": (
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights "
        "to this work.",
    ),
    "Unlicense": ("This is free and unencumbered software released into the public domain.",),
}
#: What a unit must name, lower-cased, to be a candidate; also the prefilter of whole texts.
TERMS = (
    "licens", "licenc", "spdx-", "copyright", "creative commons", "public domain", "free software",
    "permission is", "permission to", "redistribut", "without warrant", '"as is"', "source code form",
    "mozilla public", "unencumbered", "eclipse public",
)
#: Units without a term that a block may span, so that a long notice stays one block.
MAX_GAP = 1
NEARLY = 0.8
MAX_DIFFERENCE = 0.25
#: Words, or parts of hyphenated words, that tell the names of licenses apart.
NAMES = frozenset(
    "affero lesser library sharealike share alike noncommercial commercial noderivatives noderivs derivs attribution "
    "version apache mozilla mit bsd isc gnu cc nc sa nd eclipse boost zlib".split()
)
#: Words that deny a notice, if they stand in its sentence within so many words before it.
NEGATIONS, DENIED_WITHIN = frozenset("not never neither nor isn aren wasn weren".split()), 4
SPDX = "spdx-license-identifier"
OUTPUT = (
    "block int, begin long, n_words long, license string, variant int, plain_bytes long, saved_bytes long, "
    "n_missing long, n_extra long, exact boolean, confirmed boolean"
)

UNIT = re.compile(r"[^\n]+?(?:[.!?](?=\s)|(?=\n)|\Z)")
TERM = re.compile("|".join(map(re.escape, TERMS)))
WORDS = re.compile(r"[\w.+-]*\w")


def words_of(text: str) -> list[str]:
    return WORDS.findall(text.lower())


def candidates(text: str) -> Iterator[tuple[int, str]]:
    """(offset, text) of each run of units that name licensing terms."""
    begin = end = None
    gap = 0
    for unit in UNIT.finditer(text):
        if TERM.search(unit[0].lower()):
            if begin is None or gap > MAX_GAP:
                if begin is not None:
                    yield begin, text[begin:end]
                begin = unit.start()
            end, gap = unit.end(), 0
        elif begin is not None and not unit[0].isspace():
            gap += 1
    if begin is not None:
        yield begin, text[begin:end]


@lru_cache(maxsize=1)
def templates() -> list[tuple[str, int, list[str], zstandard.ZstdCompressor]]:
    """(license, variant, words, compressor with the wording as raw dictionary)."""
    out = []
    for name, variants in TEMPLATES.items():
        for number, wording in enumerate(variants):
            words = words_of(wording)
            raw = zstandard.ZstdCompressionDict(" ".join(words).encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            raw.precompute_compress(level=12)
            out.append((name, number, words, zstandard.ZstdCompressor(dict_data=raw, write_content_size=False)))
    return out


@lru_cache(maxsize=1)
def plain() -> zstandard.ZstdCompressor:
    return zstandard.ZstdCompressor(level=12, write_content_size=False)


def differences(template: list[str], block: list[str]) -> tuple[list[str], int]:
    """Template words that the block lacks, and how many words it adds inside the matched span."""
    runs = [m for m in SequenceMatcher(None, template, block, autojunk=False).get_matching_blocks() if m.size]
    if not runs:
        return template, 0
    held = {k for m in runs for k in range(m.a, m.a + m.size)}
    return [w for k, w in enumerate(template) if k not in held], runs[-1].b + runs[-1].size - runs[0].b - len(held)


def parts_of_names(words: list[str]) -> set[str]:
    return {part for w in words for part in w.split("-")} & NAMES


def aligned(template: list[str], words: list[str]) -> tuple[list[str], list[str], int, int] | None:
    """(missing words, extra words, first, end) of the best place of ``template`` in ``words``."""
    runs = [m for m in SequenceMatcher(None, template, words, autojunk=False).get_matching_blocks() if m.size]
    # an outer run further away than it is long is a chance match
    while len(runs) > 1 and runs[0].size < runs[1].b - runs[0].b - runs[0].size:
        del runs[0]
    while len(runs) > 1 and runs[-1].size < runs[-1].b - runs[-2].b - runs[-2].size:
        del runs[-1]
    if not runs:
        return None
    held = {k for m in runs for k in range(m.a, m.a + m.size)}
    said = {k for m in runs for k in range(m.b, m.b + m.size)}
    first, end = runs[0].b, runs[-1].b + runs[-1].size
    return [w for k, w in enumerate(template) if k not in held], [words[k] for k in range(first, end) if k not in said], first, end


def confirmed(template: list[str], missing: list[str], extra: list[str]) -> bool:
    # another version is another license, and so is another name
    return (
        len(missing) + len(extra) <= MAX_DIFFERENCE * len(template)
        and not any(re.search(r"\d", w) for w in missing)
        and not parts_of_names(missing + extra)
    )


@lru_cache(maxsize=1)
def pairs() -> dict[tuple[str, str], list[tuple[int, int]]]:
    """(template, position) of every pair of neighbouring words."""
    out = defaultdict(list)
    for t, (_, _, words, _) in enumerate(templates()):
        for k, pair in enumerate(zip(words, words[1:])):
            out[pair].append((t, k))
    return dict(out)


def proposed(words: list[str]) -> Iterator[tuple[int, int]]:
    """Candidate blocks: windows where word pairs of a template stand near one diagonal."""
    index, shifts = pairs(), defaultdict(list)
    for j, pair in enumerate(zip(words, words[1:])):
        for t, k in index.get(pair, ()):
            shifts[t].append(j - k)
    for t, found in shifts.items():
        size = len(templates()[t][2])
        found.sort()
        slack = int(MAX_DIFFERENCE * size)
        # a differing word breaks two pairs at most, and shifts what follows by one
        need = max(1, size - 1 - 2 * slack)
        at = 0
        while at < len(found):
            if bisect_right(found, found[at] + slack) - at < need:
                at += 1
                continue
            yield max(found[at], 0), min(found[at] + 2 * slack + size, len(words))
            at = bisect_right(found, found[at] + slack)


def ranked(words: list[str]) -> tuple[int, list[tuple[int, int]]]:
    """Compressed size of a block, and (bytes saved, template) of the templates, those that save most first."""
    data = " ".join(words).encode()
    alone = len(plain().compress(data))
    saved = [(alone - len(c.compress(data)), t) for t, (_, _, _, c) in enumerate(templates())]
    return alone, sorted(saved, key=lambda x: (-x[0], x[1]))


def nearly_best(words: list[str]) -> list[int]:
    """The templates whose dictionaries save nearly as much of a block as the best one's."""
    saved = ranked(words)[1]
    return [t for n, t in saved if n > 0 and n >= NEARLY * saved[0][0]]


def hits(words: list[str]) -> list[tuple[int, int, int, int, int, int]]:
    """(score, first, end, template, n_missing, n_extra) of the confirmed alignments, overlaps included."""
    out = []
    for low, high in sorted(set(proposed(words))):
        block = words[low:high]
        for t in nearly_best(block):
            wording = templates()[t][2]
            got = aligned(wording, block)
            if got and confirmed(wording, got[0], got[1]):
                missing, extra = len(got[0]), len(got[1])
                out.append((len(wording) - 2 * missing - extra, low + got[2], low + got[3], t, missing, extra))
    return out


def notices(words: list[str]) -> list[tuple[int, int, int, int, int]]:
    """(first, end, template, n_missing, n_extra) of every confirmed notice, in text order.

    Of overlapping alignments the one that explains most words wins; the words left are searched
    again until nothing is confirmed.
    """
    out, todo = [], [(0, len(words))]
    while todo:
        low, high = todo.pop()
        taken = []
        for _, first, end, *rest in sorted(hits(words[low:high]), key=lambda h: (-h[0], h[1], h[3])):
            at = bisect_right(taken, (first, high))
            if (at == 0 or taken[at - 1][1] <= first) and (at == len(taken) or taken[at][0] >= end):
                taken.insert(at, (first, end, *rest))
        if taken:
            out += [(low + first, low + end, *rest) for first, end, *rest in taken]
            edges = [low, *(low + x for span in taken for x in span[:2]), high]
            todo += [(a, b) for a, b in zip(edges[::2], edges[1::2]) if b - a > 1]
    return sorted(out + listed(words, out))


def listed(words: list[str], found: list[tuple[int, int, int, int, int]]) -> list[tuple[int, int, int, int, int]]:
    """The further licenses of SPDX expressions, ``MIT OR Apache-2.0``."""
    ids = {wording[1]: t for t, (_, _, wording, _) in enumerate(templates()) if wording[0] == SPDX}
    taken = {k for first, end, *_ in found for k in range(first, end)}
    out = []
    for k, word in enumerate(words):
        if word == SPDX:
            k += 1
            while k + 2 < len(words) and words[k + 1] in ("or", "and", "with"):
                k += 2
                if words[k - 1] != "with" and words[k] in ids and k not in taken:
                    out.append((k, k + 1, ids[words[k]], 0, 0))
    return out


def row(words: list[str], found: tuple[int, int, int]) -> dict:
    """The row of a confirmed notice with these words."""
    t, missing, extra = found
    name, number, _, compressor = templates()[t]
    data = " ".join(words).encode()
    alone = len(plain().compress(data))
    return {
        "n_words": len(words), "plain_bytes": alone, "saved_bytes": max(alone - len(compressor.compress(data)), 0),
        "license": name, "variant": number, "n_missing": missing, "n_extra": extra,
        "exact": missing + extra == 0, "confirmed": True,
    }


def nearest(words: list[str]) -> dict:
    """The nearest template of a block that has no confirmed notice."""
    alone, saved = ranked(words)
    most = saved[0][0]
    found = {"n_words": len(words), "plain_bytes": alone, "saved_bytes": max(most, 0), "exact": False, "confirmed": False}
    best = None
    for n, t in saved:
        if n <= 0 or n < NEARLY * most:
            break
        name, number, wording, _ = templates()[t]
        missing, extra = differences(wording, words)
        # of equally exact wordings the longer one says more
        rank = ((len(missing) + extra) / len(wording), -len(wording))
        if best is None or rank < best[0]:
            best = rank, n, name, number, missing, extra
    if best is None:
        return found
    _, n, name, number, missing, extra = best
    return found | {"license": name, "variant": number, "saved_bytes": n, "n_missing": len(missing), "n_extra": extra}


def denied(text: str, places: list[tuple[int, int]], first: int) -> bool:
    """Whether a word right before the span, in the same sentence, takes the notice back."""
    for k in range(first - 1, max(first - 1 - DENIED_WITHIN, -1), -1):
        if re.search(r"[.!?;:\n]", text[places[k][1] : places[k + 1][0]]):
            return False
        if text[slice(*places[k])].lower() in NEGATIONS:
            return True
    return False


def identify(block: str) -> dict:
    """The notice of a block that explains most of its words, else its nearest template."""
    words = words_of(block)
    found = notices(words)
    if not found:
        return nearest(words)
    return row(words, max(found, key=lambda x: x[1] - x[0])[2:])


def rows_of(text: str) -> Iterator[dict]:
    """The confirmed notices of a text and its other candidate blocks, in text order."""
    places = [m.span() for m in WORDS.finditer(text)]
    words = [text[a:b].lower() for a, b in places]
    found = [n for n in notices(words) if not denied(text, places, n[0])]
    units = [m.start() for m in UNIT.finditer(text)] if found else []
    at = 0
    for first, end, *rest in found:
        start = places[first][0]
        for begin, block in candidates(text[at:start]):
            yield {"begin": at + begin} | nearest(words_of(block))
        yield {"begin": units[bisect_right(units, start) - 1]} | row(words[first:end], rest)
        at = places[end - 1][1]
    for begin, block in candidates(text[at:]):
        yield {"begin": at + begin} | nearest(words_of(block))


def scan(docs: DataFrame) -> DataFrame:
    """One row per confirmed notice and other candidate block of every document."""
    low = F.lower("text")
    rows = docs.select("doc_id", "text").where(reduce(or_, (F.contains(low, F.lit(t)) for t in TERMS)))
    id_type = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = None
        for batch in batches:
            kind = kind or pa.schema(
                [
                    ("doc_id", batch.schema.field("doc_id").type), ("block", pa.int32()), ("begin", pa.int64()),
                    ("n_words", pa.int64()), ("license", pa.string()), ("variant", pa.int32()),
                    ("plain_bytes", pa.int64()), ("saved_bytes", pa.int64()), ("n_missing", pa.int64()),
                    ("n_extra", pa.int64()), ("exact", pa.bool_()), ("confirmed", pa.bool_()),
                ]
            )
            out = [
                {"doc_id": doc_id.as_py(), "block": k} | found
                for doc_id, text in zip(batch["doc_id"], batch["text"], strict=True)
                for k, found in enumerate(rows_of(text.as_py()))
            ]
            yield pa.RecordBatch.from_pylist(out, schema=kind)

    return rows.mapInArrow(run, f"doc_id {id_type}, {OUTPUT}")
