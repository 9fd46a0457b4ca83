"""License scans by conditional compression.

Words of licensing are gathered into candidate blocks that reach as far around them as the longest
template, and long blocks are scanned in pieces that overlap by one notice, so a text costs its length.
A piece is compressed alone and with each template as a raw zstandard dictionary. The templates are
gone through from the greatest reduction of the size; one that reduces it by too little for a notice is
not looked at. The first whose wording is there (few of its words missing, few strange words between)
is confirmed; templates of nearly the same reduction are weighed against it by their differing words.
All its places in the piece take their words, and what is left is compressed and compared again until
no template is confirmed.

Cases: a null, empty or unlicensed text has no blocks; line breaks count as spaces, so wrapping and
blank lines do not matter; spans are the lines of the confirmed words; equal blocks give equal
findings; equal rows are scanned alike; bytes that are not UTF-8 are read as U+FFFD; columns of the
input with the name of an added one give way to it."""

from __future__ import annotations

import random
import re
from bisect import bisect_left, bisect_right
from collections import Counter
from difflib import SequenceMatcher
from functools import lru_cache

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StringType, StructField, StructType

from keelson.llm.common import bounded_batches, map_columns
from keelson.registry import query

#: License notices to scan for (fixed values): name, wording.
TEMPLATES = (
    ("apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("mit", "Released under the MIT License."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("gpl-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("lgpl-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("bsd-3-clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("cc-by-4.0", "Licensed under CC BY 4.0."),
    ("cc-by-sa-4.0", "Licensed under CC BY-SA 4.0."),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0."),
    ("cc0-1.0", "To the extent possible under law, the author has waived all copyright and related rights to this work under CC0 1.0."),
    ("all-rights-reserved", "All rights reserved."),
    ("bsd-2-clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("bsd-3-clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("agpl-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("gpl-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("lgpl-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
)

#: Words that make a line a candidate (fixed values).
ANCHORS = ("licens", "licenc", "copyright", "rights reserved", "permission", "redistribut", "public domain", "creative commons", "cc by", "cc0", "free software", "mozilla public")

MOST_DIFFERENT = 0.2  # share of a template's words that may differ
LEAST_GAIN = 0.15  # of a template's bytes must its dictionary save for it to be looked at
NEAR_GAIN = 12  # bytes: reductions that differ by so little rank alike
EDGE = 4  # words around a place that are judged with it
CACHE_PIECES = 20_000

_ANCHOR = re.compile("|".join(re.escape(x) for x in ANCHORS), re.IGNORECASE)
_WORD = re.compile(r"[\w.\-]*\w")


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


@lru_cache(1)
def _wordings(templates: tuple) -> list[tuple[list[str], Counter]]:
    return [(w, Counter(w)) for w in (words_of(text) for _, text in templates)]


def candidate_blocks(text: str | None, templates: tuple = TEMPLATES) -> list[tuple[int, int]]:
    """(start, end) of the blocks in the text: around each anchor as many words as a notice can have."""
    anchors = [m.start() for m in _ANCHOR.finditer(text)] if text else []
    if not anchors:
        return []
    starts, ends = zip(*[m.span() for m in _WORD.finditer(text)], strict=True)
    around = int((1 + MOST_DIFFERENT) * max(len(w) for w, _ in _wordings(templates))) + 1
    groups: list[list[int]] = []
    for at in anchors:
        word = max(0, min(bisect_right(starts, at), len(starts)) - 1)
        low, high = max(0, word - around), min(len(starts) - 1, word + around)
        if groups and low <= groups[-1][1] + 1:
            groups[-1][1] = high
        else:
            groups.append([low, high])
    return [(starts[a], ends[b]) for a, b in groups]


@lru_cache(1)
def _compressors(templates: tuple) -> list:
    raw = zstandard.DICT_TYPE_RAWCONTENT
    return [zstandard.ZstdCompressor(level=6, dict_data=zstandard.ZstdCompressionDict(" ".join(w).encode(), dict_type=raw)) for w, _ in _wordings(templates)]


_ALONE = zstandard.ZstdCompressor(level=6)
#: Stands before what is compressed: below some 60 literals zstandard does not code them, and a match could seem to cost bytes.
_FILL = bytes(random.Random(1).choices(b"etaoinshrdlucmfwypvbgkjqxz 0123456789.-", k=400)) + b" "


def gains(words: list[str], templates: tuple) -> list[int]:
    """Bytes that each template as dictionary saves in the compressed words."""
    data = _FILL + " ".join(words).encode()
    alone = len(_ALONE.compress(data))
    return [alone - len(z.compress(data)) for z in _compressors(templates)]


def differences(block: list[str], template: list[str]) -> int:
    """Words of the template that the block lacks, and strange words between those it has."""
    runs = [m for m in SequenceMatcher(None, block, template, autojunk=False).get_matching_blocks() if m.size]
    if not runs:
        return len(template)
    common = sum(m.size for m in runs)
    return len(template) - common + runs[-1].a + runs[-1].size - runs[0].a - common


def _match(words: list[str], low: int, high: int, template: list[str], counts: Counter) -> tuple[int, int, int, int] | None:
    """(start, end, common words, differing words) of the template's best place in words[low:high]."""
    most, ranges = MOST_DIFFERENT * len(template), [(low, high)]
    while ranges:
        low, high = ranges.pop()
        if len(template) - sum((counts & Counter(words[low:high])).values()) > most:
            continue  # too many of its words are nowhere in the range
        runs = [m for m in SequenceMatcher(None, words[low:high], template, autojunk=False).get_matching_blocks() if m.size]
        best = None
        for i in range(len(runs)):  # words that match far off on either side do not belong to the notice
            common = 0
            for j in range(i, len(runs)):
                common += runs[j].size
                end = runs[j].a + runs[j].size
                n = len(template) - common + end - runs[i].a - common
                if best is None or n < best[3]:
                    best = (low + runs[i].a, low + end, common, n)
        if best and best[3] <= most:
            return best
        longest = max(runs, key=lambda m: m.size)
        ranges += [(low + longest.a + longest.size, high), (low, low + longest.a)]
    return None


def _places(words: list[str], low: int, high: int, template: list[str]) -> list[tuple[int, int]]:
    """Places in words[low:high] where the template stands word for word, without overlap."""
    out, at, n = [], low, len(template)
    while at + n <= high:
        try:
            at = words.index(template[0], at, high - n + 1)
        except ValueError:
            break
        if words[at : at + n] == template:
            out.append((at, at + n))
            at += n
        else:
            at += 1
    return out


def _best(words: list[str], low: int, high: int, templates: tuple) -> tuple[int, tuple[int, int, int, int], float] | None:
    """(template, match, share of bytes saved) of the first template by saved bytes that is there.

    Of templates that rank alike the one with most common less differing words counts."""
    saved, best = gains(words[low:high], templates), None
    for i in sorted((i for i in range(len(templates)) if saved[i] >= LEAST_GAIN * len(templates[i][1])), key=lambda i: (-saved[i], i)):
        if best and saved[i] < saved[best[0]] - NEAR_GAIN:
            break
        hit = _match(words, low, high, *_wordings(templates)[i])
        if hit and (best is None or (hit[3] - hit[2], hit[3]) < (best[1][3] - best[1][2], best[1][3])):
            best = i, hit
    return (*best, saved[best[0]] / len(" ".join(words[low:high]))) if best else None


@lru_cache(CACHE_PIECES)
def _found(words: tuple[str, ...], templates: tuple) -> tuple[tuple[int, float, int, int, int], ...]:
    """(template, share of the piece's bytes saved, differing words, first word, end) of all confirmed notices in order."""
    words, wordings, out = list(words), _wordings(templates), []
    ranges = [(0, len(words))]
    while ranges:
        low, high = ranges.pop()
        if high == low:
            continue
        best = _best(words, low, high, templates)
        if best:  # the range can hold several notices: the place found is judged once more, by itself
            a, b = best[1][:2]
            best = _best(words, max(low, a - EDGE), min(high, b + EDGE), templates) or best
        if best is None:
            continue
        i, (a, b, _, n), share = best
        # its other places in the piece need no further search, if they are word for word the same
        taken = [(a, b, n)] + [(x, y, 0) for x, y in _places(words, low, high, wordings[i][0]) if y <= a or x >= b]
        edge = low
        for x, y, differ in sorted(taken):
            out.append((i, share, differ, x, y))
            ranges.append((edge, x))
            edge = y
        ranges.append((edge, high))
    return tuple(sorted(out, key=lambda x: x[3]))


def scan_words(words: list[str], templates: tuple = TEMPLATES) -> list[tuple[int, float, int, int, int]]:
    """The confirmed notices of a block: its words are scanned in pieces of some notices, from left to right.

    A notice that begins in the last part of a piece, where it may be cut off, is left to the next piece."""
    out, at = [], 0
    reach = int((1 + MOST_DIFFERENT) * max(len(w) for w, _ in _wordings(templates))) + 1
    while at < len(words):
        end = min(len(words), at + 4 * reach)
        cut = end if end == len(words) else end - reach
        kept = [(i, share, n, at + a, at + b) for i, share, n, a, b in _found(tuple(words[at:end]), templates) if at + a < cut]
        out += kept
        at = max([cut, *(x[4] for x in kept)])
    return out


SPANS = ArrayType(StructType([
    StructField("license", StringType()), StructField("first_line", IntegerType()), StructField("last_line", IntegerType()),
    StructField("saved", DoubleType()), StructField("differing_words", IntegerType()),
]))


def license_scan(documents: DataFrame, text: str = "text", templates: tuple = TEMPLATES) -> DataFrame:
    """Adds license_spans (confirmed blocks) and n_candidates (blocks looked at) to every row."""
    bounded_batches(documents.sparkSession)

    def compute(batch: pa.RecordBatch) -> list:
        spans, looked = [], []
        for body in batch.column(0).to_pylist():
            body = body.decode("utf-8", "replace") if body else ""
            blocks = candidate_blocks(body, templates)
            breaks = [i for i, x in enumerate(body) if x == "\n"] if blocks else []
            line = lambda at: bisect_left(breaks, at) + 1  # noqa: B023, E731
            found = []
            for a, b in blocks:
                at = [(a + m.start(), a + m.end()) for m in _WORD.finditer(body[a:b])]
                found += [(line(at[x][0]), line(at[y - 1][1] - 1), (templates[i][0], share, n)) for i, share, n, x, y in scan_words([body[x:y].lower() for x, y in at], templates)]
            spans.append([{"license": h[0], "first_line": a, "last_line": b, "saved": h[1], "differing_words": h[2]} for a, b, h in found])
            looked.append(len(blocks))
        kind = pa.list_(pa.struct([("license", pa.string()), ("first_line", pa.int32()), ("last_line", pa.int32()), ("saved", pa.float64()), ("differing_words", pa.int32())]))
        return [pa.array(spans, kind), pa.array(looked, pa.int32())]

    return map_columns(documents, [F.col(text).cast("binary")], [StructField("license_spans", SPANS), StructField("n_candidates", IntegerType())], compute, documents.columns)


@query("op2_license_zstd")
def op2_license_zstd(t):
    scanned = license_scan(t.documents.select("doc_id", "text"))
    names = F.array_sort(F.array_distinct(F.transform("license_spans", lambda s: s["license"])))
    return scanned.select("doc_id", F.array_join(names, ",").alias("licenses"), F.size("license_spans").alias("n_spans"), "n_candidates")
