"""License scans against brute force over every window."""

import math
import random

from pyspark.sql import functions as F

from conftest import SF_SMALL
from ragloom.llm import op2_license as L


def brute(text, templates):
    """Containment of every template in every window of its class, without retrieval."""
    words = L.words_of(text or "")
    pairs = [L.shingle_hash(a, b) for a, b in zip(words, words[1:], strict=False)]
    spans = set()
    for t in templates:
        for s in range(0, max(len(pairs), 1), t.size):
            window = pairs[s:s + 2 * t.size - 1]
            at = [i for i, h in enumerate(window) if h in t.shingles]
            if at and len(set(window) & set(t.shingles)) >= math.ceil(L.CONTAINMENT * len(t.shingles) - 1e-9):
                spans.add((s + at[0], s + at[-1] + 2, t.name))
    return sorted(s for s in spans if not any(
        o != s and o[2] == s[2] and o[0] <= s[0] and o[1] >= s[1] and o[1] - o[0] > s[1] - s[0] for o in spans))


def got(df):
    return [[tuple(s) for s in r["licenses"]] for r in L.scan(df).collect()]


def test_planted_lines_and_defined_cases(spark):
    lines = list(L.TEMPLATES.values())
    texts = [None, "", "word", *lines, "ALL RIGHTS\nRESERVED", "x " * 3000 + lines[1] + " y" * 3000,
             "this work is licensed under the gnu general public licence version 3", "licensed under the sea",
             " ".join(lines), lines[0] * 40, "é " + lines[4] + " é"]
    df = spark.createDataFrame([(i, t, i) for i, t in enumerate(texts + texts)], "doc_id int, text string, licenses int")
    want = [brute(t, L.prepare(L.TEMPLATES)) for t in texts]
    assert got(df) == want + want
    assert all(want[3:8]) and not any(want[:3])
    assert L.scan(df.limit(0)).count() == 0


def test_random_mixtures(spark):
    rnd = random.Random(3)
    vocabulary = [w for t in L.TEMPLATES.values() for w in L.words_of(t)] + ["the", "x", "y", "z"]
    texts = []
    for _ in range(300):
        parts = [rnd.choice([rnd.choice(vocabulary), rnd.choice(list(L.TEMPLATES.values()))])
                 for _ in range(rnd.randint(0, 30))]
        texts.append(" ".join(parts))
    want = [brute(t, L.prepare(L.TEMPLATES)) for t in texts]
    assert got(spark.createDataFrame([(t,) for t in texts], "text string")) == want


def test_query_matches_brute_force(spark):
    rows = {r["doc_id"]: r for r in L.op2_license(spark, SF_SMALL).collect()}
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()
    templates, hits = L.prepare(L.TEMPLATES), 0
    assert len(rows) == len(docs)
    for d in docs:
        want = brute(d["text"], templates)
        hits += len(want)
        assert rows[d["doc_id"]]["spans"] == ",".join(f"{n}:{a}:{b}" for a, b, n in want)
        assert rows[d["doc_id"]]["n_spans"] == len(want)
    assert hits


def test_hashes_are_sparks(spark):
    r = spark.range(1).select(F.xxhash64(F.lit("ab"), F.lit("é")).alias("a"),
                              F.xxhash64(F.lit(-5).cast("bigint"), F.lit(7).cast("bigint")).alias("b")).first()
    assert (r["a"], r["b"]) == (L.shingle_hash("ab", "é"), L.band_hash(-5, 7))


def test_bands_reach_the_collision_probability():
    for shingles in (2, 4, 10):
        size = 4 if shingles < 4 else 8 if shingles < 8 else 16
        b = L.bands_needed(shingles, size)
        shared = math.ceil(0.8 * shingles)
        j = shared / (2 * size - 1 + shingles - shared)
        assert 1 - (1 - j) ** b >= L.COLLISION > 1 - (1 - j) ** (b - 1)


MIT = """/*
 * Copyright (c) 2019 Some One
 *
 * Permission is hereby granted, free of charge, to any person obtaining a copy
 * of this software and associated documentation files (the "Software"), to deal
 * in the Software without restriction, including without limitation the rights
 * to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
 * copies of the Software, and to permit persons to whom the Software is
 * furnished to do so, subject to the following conditions:
 *
 * The above copyright notice and this permission notice shall be included in
 * all copies or substantial portions of the Software.
 */"""
LGPL = """This library is free software; you can redistribute it and/or
modify it under the terms of the GNU Lesser General Public
License as published by the Free Software Foundation; either
version 2.1 of the License, or (at your option) any later version."""
BSD = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.
3. Neither the name of the copyright holder nor the names of its contributors may
   be used to endorse or promote products derived from this software without
   specific prior written permission."""


def test_standard_notices_and_tags(spark):
    cases = [(MIT, {"mit-notice"}), (LGPL, {"gnu-notice", "lgpl"}), (BSD, {"bsd-notice", "bsd-3-clause"}),
             ("# SPDX-License-Identifier: MIT\nimport os", {"spdx-mit"}),
             ("// SPDX-License-Identifier: GPL-2.0-or-later", {"spdx-gpl-2"}),
             ("<!-- SPDX-License-Identifier: CC-BY-SA-4.0 -->", {"spdx-cc-by"}),
             ("long text " * 5000 + LGPL.upper() + " and more" * 5000, {"gnu-notice", "lgpl"}),
             (L.NOTICES["apache-2.0-notice"], {"apache-2.0", "apache-2.0-notice"}),
             ("The terms of the contract and the rights of the public are subject to the conditions of the notice.", set()),
             ("Permission to use the copy is granted by the authors of this software for any purpose.", set()),
             ("The license identifier of the car is hereby granted without restriction.", set())]
    df = spark.createDataFrame([(t,) for t, _ in cases], "text string")
    rows = got(df)
    assert [{s[2] for s in r} for r in rows] == [names for _, names in cases]
    templates = L.prepare(L.TEMPLATES)
    assert rows == [brute(t, templates) for t, _ in cases]


def test_marks_lose_no_window_at_the_threshold(spark):
    """Notices with words deleted or replaced at random, on both sides of the containment, as brute force finds them."""
    rnd = random.Random(9)
    templates, texts = L.prepare(L.TEMPLATES), []
    for name, text in L.NOTICES.items():
        words = L.words_of(text)
        for share in (0.02, 0.05, 0.08, 0.1, 0.15):
            texts.append(" ".join(w if rnd.random() > share else rnd.choice(["", "other"]) for w in words))
        # all marks of the template are broken: no window can contain it any more
        marks = set(L.marks_of(words))
        broken = [w for i, w in enumerate(words) if (words[i - 1], w) not in marks]
        assert not any(s[2] == name and marks & set(zip(broken, broken[1:], strict=False)) == set()
                       for s in brute(" ".join(broken), templates))
        texts.append(" ".join(broken))
    want = [brute(t, templates) for t in texts]
    found = sum(map(bool, want))
    assert 10 < found < len(want)
    assert got(spark.createDataFrame([(t,) for t in texts], "text string")) == want


def test_bands_of_all_templates_reach_the_collision_probability():
    for t in L.prepare(L.TEMPLATES):
        shared = math.ceil(L.CONTAINMENT * len(t.shingles) - 1e-9)
        j = shared / (2 * t.size - 1 + len(t.shingles) - shared)
        assert 1 - (1 - j) ** len(t.bands) >= L.COLLISION and len(t.bands) <= 100
