"""Removal of repeated byte strings against brute force."""

import random

import numpy as np
from pyspark.sql import functions as F

from brute import without_repeats
from conftest import SF_SMALL
from ragloom.llm import op4_suffix_dedup as S


def run(df):
    return {r["doc_id"]: (bytes(r["kept"]), r["n_removed"], r["n_spans"]) for r in S.remove_repeats(df).collect()}


def mixtures(rnd, n):
    passages = ["".join(rnd.choice("abcdé fgh") for _ in range(rnd.randint(80, 400))) for _ in range(8)]
    docs = []
    for i in range(n):
        parts = []
        for _ in range(rnd.randint(0, 6)):
            c, p = rnd.random(), rnd.choice(passages)
            x = rnd.randint(0, len(p))
            parts.append(p if c < .3 else p[x:x + rnd.randint(60, 300)] if c < .6
                         else rnd.choice(["a", "ab", "abc ", "x" * 50 + "y"]) * rnd.randint(1, 120) if c < .7
                         else "".join(rnd.choice("abcdefghijklmnop ") for _ in range(rnd.randint(1, 300))))
        docs.append((i * 3, "".join(parts)))
    return docs


def test_mixtures_match_brute_force(spark, monkeypatch):
    docs = mixtures(random.Random(3), 150)
    docs += [(1000, None), (1001, ""), (1002, docs[5][1])]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(6)
    want = without_repeats(docs)
    assert sum(w[1] for w in want.values()) > 10_000
    assert run(df) == want
    monkeypatch.setattr(S, "BUCKET", 3)     # split buckets give the same
    assert run(df) == want


def test_query_matches_brute_force(spark):
    import hashlib
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()]
    want = without_repeats(docs)
    rows = S.op4_suffix_dedup(spark, SF_SMALL).collect()
    assert len(rows) == len(docs)
    for r in rows:
        kept, removed, spans = want[r["doc_id"]]
        assert (r["n_removed"], r["n_spans"], r["kept_sha256"]) == (removed, spans, hashlib.sha256(kept).hexdigest())
        assert r["n_bytes"] == removed + len(kept)


def test_sorted_suffixes():
    rnd = random.Random(6)
    for _ in range(25):
        base = bytes(rnd.choice(b"ab") for _ in range(30))
        t = b"".join(rnd.choice([base, base[:7], bytes([rnd.choice(b"abc")]) * rnd.randint(1, 140)]) for _ in range(30))
        starts = np.arange(max(0, len(t) - 99))
        order, same = S.sort_suffixes(np.frombuffer(t, np.uint8), starts)
        w = [t[i:i + 100] for i in starts[order]]
        assert w == sorted(w)
        assert list(same) == [i > 0 and w[i] == w[i - 1] for i in range(len(w))]


def test_difference_cover():
    for size in (4, 16, 25, 30):
        c = S.cover(size)
        assert {(a - b) % size for a in c for b in c} == set(range(size))


def test_defined_cases(spark):
    rnd = random.Random(1)
    long = "".join(rnd.choice("abcdefgh") for _ in range(160))
    rows = [(1, long, "k"), (1, long, "k"), (None, long[:120], "n"), (2, "short", "s"), (3, None, "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, kept string")
    got = sorted((r["doc_id"] or 0, r["n_bytes"], r["n_removed"]) for r in S.remove_repeats(df).collect())
    assert got == [(0, 120, 0), (1, len(long), 120), (1, len(long), 120), (2, 5, 0), (3, 0, 0)]
    assert S.remove_repeats(df.limit(0)).count() == 0


def test_stage_keeps_columns_and_whole_characters(spark):
    rnd = random.Random(2)
    passage = "".join(rnd.choice("éèàüabcdef") for _ in range(130))     # doesn't repeat itself
    rows = [(1, passage + " first", "en", "s", 100), (2, "x " + passage, "en", "s", 100), (3, passage, "en", "s", 100)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    out = S.suffix_stage(spark, docs, "")
    assert out.columns == docs.columns
    got = {r["doc_id"]: (r["text"], r["n_chars"]) for r in out.collect()}
    assert set(got) == {1, 2} and got[2] == ("x ", 2) and got[1][1] == 100
    assert out.where(F.length("text") != F.col("n_chars")).count() <= 1


def test_many_contexts_of_one_line_are_split_by_content(spark, monkeypatch):
    rnd = random.Random(8)
    line = "".join(rnd.choice("abcdefgh ") for _ in range(53))

    def noise():
        return "".join(rnd.choice("ijklmnop ") for _ in range(90))

    twice = [noise() + line + noise() for _ in range(5)]
    docs = [(i, noise() + line + noise()) for i in range(400)]
    docs += [(1000 + i, noise() + twice[i % 5] + noise()) for i in range(20)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    seen, deal = [], S._sorted_buckets
    monkeypatch.setattr(S, "BUCKET", 50)
    monkeypatch.setattr(S, "_sorted_buckets", lambda contexts: (seen.append(contexts), deal(contexts))[1])
    assert run(df) == without_repeats(docs)
    largest = seen[0].groupBy("gram").agg(F.sum(F.length("bytes")).alias("b")).agg(F.max("b")).first()[0] or 0
    assert largest <= 50 * 172      # bytes that meet in one task
    windows = seen[0].where("bytes is null")
    assert windows.count() > 0 and windows.groupBy("doc", "tk", "lo").count().where("count > 1").count() == 0
