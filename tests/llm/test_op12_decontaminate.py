"""Decontamination: index parts, whole tables against SQL, defined cases against brute force."""

import random
import re

import duckdb
import numpy as np

from conftest import SF_MID
from ragloom.llm import op12_decontaminate as S

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def tokens(text):
    return re.findall(r"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (text or "").translate(LOWER))


def brute(docs, bench, window=10):
    windows = {}
    for item, text in bench:
        w = tokens(text)
        for i in range(max(len(w) - window, 0) + 1 if w else 0):
            windows.setdefault(tuple(w[i:i + window]), set()).add("" if item is None else str(item))
    sizes = {len(p) for p in windows}
    out = []
    for d, text in docs:
        w, hit, items = tokens(text), set(), set()
        for i in range(len(w)):
            for size in sizes:
                if i + size <= len(w) and tuple(w[i:i + size]) in windows:
                    hit |= set(range(i, i + size))
                    items |= windows[tuple(w[i:i + size])]
        out.append((d, len(w), len(hit), sorted(items)))
    return sorted(out, key=str)


def result(df):
    return sorted(((r["doc_id"], r["n_words"], r["n_hit"], r["items"]) for r in df.collect()), key=str)


def test_query_equals_sql_on_all_documents(spark):
    got = sorted(tuple(r) for r in S.op12_decontaminate(spark, SF_MID).collect())
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF_MID}/{t}.parquet'")
    assert got == sorted(con.sql(S.SQL).fetchall())
    assert any(r[5] for r in got) and not all(r[5] for r in got)


def test_random_texts_pieces_and_blocks(spark):
    """Small shards, pieces and blocks, and few words: many overlaps, ties and repeats."""
    rnd = random.Random(12)

    def text(n):
        return "".join(rnd.choice(["A", "b", "c9", "é", "Long"]) + rnd.choice([" ", ", ", "-", "\n"]) for _ in range(n))

    docs = [(i, text(rnd.choice([0, 1, 3, 9, 30, 200]))) for i in range(80)] + [(None, text(40)), (5, None), (5, "")]
    docs += [(1000 + i, docs[4][1]) for i in range(30)]
    bench = [(i, text(rnd.choice([1, 2, 5, 6, 7, 9]))) for i in range(25)] + [(3, None), (None, "a b c9 é"), (9, "--")]
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in docs], "doc_id long, text string, n_words int, doc_row string")
    bf = spark.createDataFrame([(i, t, 1) for i, t in bench], "item_id long, text string, phrase int")
    want = brute(docs, bench, 4)
    assert any(r[2] for r in want)
    for kw in ({}, {"shard": 50, "piece": 11}, {"shard": 300, "piece": 300, "block_windows": 7}, {"block_bytes": 60}):
        assert result(S.decontaminate(df, bf, window=4, **kw)) == want
    spans = S.decontaminate(df, bf, window=4, shard=50, piece=11).select("n_hit", "removal_spans").collect()
    for r in spans:
        flat = [x for s in r["removal_spans"] for x in s]
        assert flat == sorted(flat) and len(set(flat)) == len(flat)      # disjoint and not touching
        assert sum(s["end"] - s["start"] for s in r["removal_spans"]) == r["n_hit"]


def test_defined_cases(spark):
    ten = "one two three four five six seven eight nine ten"
    long = " ".join(f"w{i}" for i in range(60_000))
    docs = [(1, None), (2, ""), (3, "...!"), (4, ten.upper()), (5, ten[:-4]), (6, f"x {ten} y " * 3), (7, "SHORT, item"),
            (8, long + " " + ten), (9, long), (9, long)]
    bench = [("b", ten), ("a", ten + " eleven"), ("c", "short item"), ("d", None), ("e", "?")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    bf = spark.createDataFrame(bench, "item_id string, text string")
    got = result(S.decontaminate(df, bf))
    assert got == [(1, 0, 0, []), (2, 0, 0, []), (3, 0, 0, []), (4, 10, 10, ["a", "b"]), (5, 9, 0, []),
                   (6, 36, 30, ["a", "b"]), (7, 2, 2, ["c"]), (8, 60_010, 10, ["a", "b"]), (9, 60_000, 0, []),
                   (9, 60_000, 0, [])]
    assert [r[2:] for r in result(S.decontaminate(df, bf.limit(0)))] == [(0, [])] * len(docs)
    assert S.decontaminate(df.limit(0), bf).count() == 0


def test_index_parts():
    rng = np.random.default_rng(3)
    for n, top in ((1, 2), (2, 3), (400, 4), (400, 3), (3000, 900), (500, 1 << 40)):
        s = np.concatenate([rng.integers(1, top, n), [0]]).astype(np.int64)
        order = S.suffix_order(s)
        assert order.tolist() == sorted(range(len(s)), key=lambda i: s[i:].tolist())
    s = np.concatenate([np.ones(300, np.int64) * 2, [1], np.ones(300, np.int64) * 2, [1, 0]])
    order = S.suffix_order(s)
    assert order.tolist() == sorted(range(len(s)), key=lambda i: s[i:].tolist())
    levels, zeros = S.wavelet(s[order - 1])
    counts = np.bincount(s)
    marked = order % S.SAMPLE == 0
    index = S.FMIndex(levels, zeros, len(s), S._packed(marked), order[marked].astype(np.int32), np.cumsum(counts) - counts)
    assert index.locate(np.arange(len(s))).tolist() == order.tolist()
    low, high = index.search(np.array([[2, 2, 1], [1, 2, 0], [1, 1, 0]]), np.array([3, 2, 2]))
    assert (high - low).tolist() == [2, 1, 0]
