"""License scans: MinHash bands retrieve templates, exact shingle containment verifies.

Texts and templates are lower-cased words (letters and digits); shingles are
word pairs, as license lines may have three words only. Templates are grouped
by length class c = 4, 8, 16, ... words; a class scans windows of 2c words
every c words, so every occurrence of up to c words lies whole in one window.

A window and a template that it contains to at least ``CONTAINMENT`` have a
Jaccard similarity of at least J (both sizes are known), so with b bands of
one MinHash each they collide with probability 1 - (1 - J)^b; b is the least
number that makes this ``COLLISION``. Each collision is verified exactly: the
share of the template's shingles in the window must reach ``CONTAINMENT``.

A window that contains k of a template's n shingles holds one of any n - k + 1
of them. The longest such word pairs of each template are its *marks*: texts
without a mark are passed by with one regular expression, and windows without
a mark of their class are not hashed. That loses nothing.

The templates are the standard notices of common licenses (``NOTICES``), the
short lines in which they are named (``LINES``) and the SPDX tags of
``SPDX_IDS``. The notices of the GPL, LGPL and AGPL differ by a word, so one
template stands for them (``gnu-notice``) and the names of the last two are
lines; likewise ``cc-notice``. A version that a notice doesn't state is not
told apart. Other texts are a parameter (``scan(templates=...)``).

Only built-in functions run, row by row, without a shuffle. Templates are
constants of the plan (a bounded parameter).

Defined cases: null and empty texts have no spans; texts of any length are
scanned whole; repeated rows are scanned one by one; spans of one template
inside another span of it count once; equal starts sort by end, then name;
empty tables give empty results; extra columns pass through, and columns named
like an output are replaced. Templates of one word are rejected.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read_documents, text_or_empty
from .native import let

#: Short lines that name a license.
LINES = {
    "all-rights-reserved": "All rights reserved.",
    "apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0.",
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "mit": "Released under the MIT License.",
    "agpl": "GNU Affero General Public License",
    "boost-1.0": "Distributed under the Boost Software License, Version 1.0.",
    "cc-by-nc": "Creative Commons Attribution-NonCommercial",
    "cc-by-sa": "Creative Commons Attribution-ShareAlike",
    "cc-by-sa-4.0": "Licensed under CC BY-SA 4.0.",
    "lgpl": "GNU Lesser General Public License",
    "unlicense": "This is free and unencumbered software released into the public domain.",
}
#: Standard notices.
NOTICES = {
    "apache-2.0-notice": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file
        except in compliance with the License. You may obtain a copy of the License at
        http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software
        distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND,
        either express or implied. See the License for the specific language governing permissions and limitations
        under the License.""",
    "bsd-notice": """Redistribution and use in source and binary forms, with or without modification, are permitted
        provided that the following conditions are met: Redistributions of source code must retain the above copyright
        notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the
        above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other
        materials provided with the distribution.""",
    "bsd-3-clause": """Neither the name of the copyright holder nor the names of its contributors may be used to endorse
        or promote products derived from this software without specific prior written permission.""",
    "cc-notice": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc0-notice": """To the extent possible under law, the author has waived all copyright and related or neighboring
        rights to this work.""",
    "epl-notice": """This program and the accompanying materials are made available under the terms of the Eclipse Public
        License""",
    "gnu-notice": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU
        General Public License as published by the Free Software Foundation, either version 3 of the License, or (at
        your option) any later version.""",
    "isc-notice": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee
        is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.""",
    "mit-notice": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and
        associated documentation files (the "Software"), to deal in the Software without restriction, including without
        limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the
        Software, and to permit persons to whom the Software is furnished to do so, subject to the following
        conditions: The above copyright notice and this permission notice shall be included in all copies or
        substantial portions of the Software.""",
    "mpl-2.0-notice": """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of
        the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.""",
    "zlib-notice": """This software is provided 'as-is', without any express or implied warranty. In no event will the
        authors be held liable for any damages arising from the use of this software.""",
}
#: Beginnings of SPDX identifiers (up to the major version).
SPDX_IDS = ("AGPL-3", "Apache-2", "BSD-2", "BSD-3", "BSL-1", "CC-BY", "CC0-1", "EPL-2", "GPL-2", "GPL-3", "ISC", "LGPL-2",
            "LGPL-3", "MIT", "MPL-2", "Unlicense", "Zlib")
TEMPLATES = LINES | NOTICES | {f"spdx-{i.lower()}": f"SPDX-License-Identifier: {i}" for i in SPDX_IDS}
CONTAINMENT = 0.8
COLLISION = 0.99999
SEED = 42
SPAN = "array<struct<start:int,end:int,name:string>>"


def words_of(text: str) -> list[str]:
    return re.findall(r"[^\W_]+", text.lower())


def _hash(data: bytes, seed: int) -> int:
    got = xxhash.xxh64_intdigest(data, seed=seed % (1 << 64))
    return got - (1 << 64) if got >> 63 else got


def shingle_hash(a: str, b: str) -> int:
    """What Spark's ``xxhash64(a, b)`` gives."""
    return _hash(b.encode(), _hash(a.encode(), SEED))


def band_hash(shingle: int, band: int) -> int:
    """What Spark's ``xxhash64(shingle, band)`` gives for a long and a long."""
    first = _hash(shingle.to_bytes(8, "little", signed=True), SEED)
    return _hash(band.to_bytes(8, "little", signed=True), first)


@dataclass
class Template:
    name: str
    words: list[str]
    size: int
    shingles: list[int]
    bands: list[int]
    marks: list[tuple[str, str]]


def bands_needed(shingles: int, size: int, containment: float = CONTAINMENT, collision: float = COLLISION) -> int:
    """Bands of one row that find a template of so many shingles in its class's windows."""
    shared = math.ceil(containment * shingles - 1e-9)
    least = shared / (2 * size - 1 + shingles - shared)
    return max(1, math.ceil(math.log(1 - collision) / math.log(1 - least)))


def marks_of(words: list[str], containment: float = CONTAINMENT) -> list[tuple[str, str]]:
    """Word pairs of which every window that contains the template has one: the longest ones, as they are rare."""
    pairs = sorted(set(zip(words, words[1:], strict=False)), key=lambda p: (-min(map(len, p)), -len("".join(p)), p))
    return pairs[:len(pairs) - math.ceil(containment * len(pairs) - 1e-9) + 1]


def prepare(templates: dict[str, str], containment: float = CONTAINMENT) -> list[Template]:
    out = []
    for name, text in sorted(templates.items()):
        words = words_of(text)
        if len(words) < 2:
            raise ValueError(f"template {name!r} has fewer than two words")
        size = 4
        while size < len(words):
            size *= 2
        shingles = sorted({shingle_hash(a, b) for a, b in zip(words, words[1:], strict=False)})
        bands = [min(band_hash(s, j) for s in shingles)
                 for j in range(bands_needed(len(shingles), size, containment))]
        out.append(Template(name, words, size, shingles, bands, marks_of(words, containment)))
    return out


def _longs(values: list[int]) -> Column:
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>")


def _span(window: Column, mins: Column, t: Template, start: Column, containment: float) -> Column:
    """The span of a template in a window whose MinHashes are ``mins``, or null."""
    own = _longs(t.shingles)
    collide = F.exists(F.zip_with(F.slice(mins, 1, len(t.bands)), _longs(t.bands), lambda a, b: a == b),
                       lambda same: same)
    inside = F.size(F.array_intersect(window, own)) >= math.ceil(containment * len(t.shingles) - 1e-9)
    at = F.filter(F.transform(window, lambda h, i: F.when(F.array_contains(own, h), i)), lambda i: i.isNotNull())
    return F.when(collide & inside, F.struct(
        (start + F.array_min(at)).alias("start"), (start + F.array_max(at) + 2).alias("end"),
        F.lit(t.name).alias("name")))


def _marks(group: list[Template]) -> Column:
    return _longs(sorted({shingle_hash(a, b) for t in group for a, b in t.marks}))


def _mark_pattern(templates: list[Template]) -> str:
    """Pattern of a text that has a mark; marks are grouped by first letter and first word."""
    tree: dict[str, dict[str, set[str]]] = {}
    for a, b in (p for t in templates for p in t.marks):
        tree.setdefault(a[0], {}).setdefault(a[1:], set()).add(b)
    gap = r"[^\p{L}\p{N}]+"
    letters = [first + "(?:" + "|".join(f"{rest}{gap}(?:{'|'.join(sorted(seconds))})" for rest, seconds in sorted(by.items())) + ")"
               for first, by in sorted(tree.items())]
    return r"(?iu)(?<![\p{L}\p{N}])(?:" + "|".join(letters) + r")(?![\p{L}\p{N}])"


def _window_spans(shingles: Column, start: Column, group: list[Template], containment: float) -> Column:
    """Spans of the templates of one length class in one window (``shingles`` of the window)."""
    most = max(len(t.bands) for t in group)

    def retrieve(x):
        mins = F.transform(F.sequence(F.lit(0).cast("bigint"), F.lit(most - 1).cast("bigint")),
                           lambda j: F.array_min(F.transform(x, lambda h: F.xxhash64(h, j))))

        def verify(m):
            found = []
            return F.filter(F.array(*[_span(x, m, t, start, containment) for t in group]), lambda s: s.isNotNull())
        return let(mins, verify)

    return let(shingles, lambda x: F.when(F.arrays_overlap(x, _marks(group)), retrieve(x)).otherwise(F.array().cast(SPAN)))


def license_spans(text: Column, templates: list[Template], containment: float = CONTAINMENT) -> Column:
    """``array<struct<start, end, name>>``: word positions, end exclusive, by start."""
    classes: dict[int, list[Template]] = {}
    for t in templates:
        classes.setdefault(t.size, []).append(t)

    def in_class(h, size, group):
        starts = F.sequence(F.lit(0), F.greatest(F.size(h) - 1, F.lit(0)), F.lit(size))
        spans = F.flatten(F.transform(starts, lambda s: _window_spans(
            F.slice(h, s + 1, F.lit(2 * size - 1)), s, group, containment)))
        return F.when(F.arrays_overlap(h, _marks(group)), spans).otherwise(F.array().cast(SPAN))

    def scan(words):
        def by_class(h):
            return F.array_distinct(F.concat(*[in_class(h, size, group) for size, group in sorted(classes.items())]))
        pairs_of = F.when(F.size(words) > 1, F.transform(
            F.sequence(F.lit(0), F.size(words) - 2), lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1)))) \
            .otherwise(F.array().cast("array<bigint>"))
        return let(pairs_of, by_class)

    words = F.filter(F.split(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "), " "), lambda w: w != "")
    whole = let(let(words, scan), lambda spans: F.array_sort(F.filter(spans, lambda s: ~F.exists(
        spans, lambda o: (o["name"] == s["name"]) & (o["start"] <= s["start"]) & (o["end"] >= s["end"])
        & (o["end"] - o["start"] > s["end"] - s["start"])))))
    return F.when(text.rlike(_mark_pattern(templates)), whole).otherwise(F.array()).cast(SPAN)


def scan(docs: DataFrame, templates: dict[str, str] | None = None, text_col: str = "text",
         containment: float = CONTAINMENT) -> DataFrame:
    """Add ``licenses``: the spans of the templates in each text."""
    return docs.withColumn("licenses", license_spans(
        text_or_empty(text_col), prepare(TEMPLATES if templates is None else templates, containment), containment))


def op2_license(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License lines of every document."""
    docs = scan(read_documents(spark, sf_dir).select("doc_id", "text"))
    return docs.select(
        "doc_id", F.size("licenses").cast("long").alias("n_spans"),
        F.array_join(F.array_sort(F.array_distinct(F.transform("licenses", lambda s: s["name"]))), ",").alias("names"),
        F.array_join(F.transform("licenses", lambda s: F.concat_ws(
            ":", s["name"], s["start"].cast("string"), s["end"].cast("string"))), ",").alias("spans"))
