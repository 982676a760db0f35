"""Packing: ids as the library's, gapless sequences, near the least possible number."""

import collections
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from conftest import SF_SMALL
from ragloom.llm import op9_packing as P
from ragloom.llm.common import materialize
from ragloom.llm.op1_bpe import Vocabulary, vocabulary_path


def check_rows(rows, capacity):
    by = collections.defaultdict(list)
    for r in rows:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


def test_query_matches_the_library(spark):
    library = Tokenizer.from_file(vocabulary_path(P.VOCABULARY))
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text").collect()
    want = {}
    for d in docs:
        ids = [*library.encode(d["text"] or "", add_special_tokens=False).ids, 1]
        for k in range(0, len(ids), 4096):
            part = ids[k:k + 4096]
            want[d["doc_id"], k // 4096] = (k, len(part), zlib.crc32(np.array(part, "<u4").tobytes()))
    rows = P.op9_pack(spark, SF_SMALL).collect()
    assert {(r["doc_id"], r["piece"]): (r["start"], r["length"], r["ids_crc32"]) for r in rows} == want
    assert len(rows) == len(want)
    n = check_rows(rows, 4096)
    assert n <= -(-sum(w[1] for w in want.values()) // 4096) + 1


def test_chunks_give_the_librarys_ids():
    with open(vocabulary_path(P.VOCABULARY), encoding="utf-8") as fh:
        tok = P.WordTokenizer(fh.read())
    rnd = random.Random(4)
    alphabet = "ab the\n\t \r\x1c\x85\xa0é́Ñß漢😀1२'s'll.,!İΣς<|endoftext|>　ﬁ"
    texts = ["".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 30))) for _ in range(1500)]
    texts += ["<|endoftext|> a<|startoftext|>b", "x" * 300 + " y", None]
    for t, got in zip(texts, tok.encode_all(texts), strict=True):
        assert np.frombuffer(got, "<u4").tolist() == tok.tokenizer.encode(t or "", add_special_tokens=False).ids, t


def test_plain_words_give_the_librarys_ids():
    """Words of Latin letters skip the library's splitting; so do none with other marks or letters."""
    with open(vocabulary_path(P.VOCABULARY), encoding="utf-8") as fh:
        tok = P.WordTokenizer(fh.read())
    rnd = random.Random(9)
    letters = [chr(c) for c in [*range(65, 91), *range(97, 123), *range(0xc0, 0x100), 0xaa, 0xb5, 0xba, 0x130, 0x131, 0x17f]]
    texts = letters + ["".join(rnd.choice(letters) for _ in range(rnd.randint(1, 14))) for _ in range(3000)]
    texts += ["".join(rnd.choice(letters[:52]) for _ in range(rnd.randint(60, 90))) for _ in range(50)]
    for t, got in zip(texts, tok.encode_all(texts), strict=True):
        assert np.frombuffer(got, "<u4").tolist() == tok.tokenizer.encode(t, add_special_tokens=False).ids, t
    small, used = P.CACHE_CHUNKS, tok.used
    try:
        P.CACHE_CHUNKS = 10                                   # the memo starts anew
        assert tok.encode_all(texts[:40]) == tok.encode_all(texts[:40]) and tok.used < used
    finally:
        P.CACHE_CHUNKS = small


@pytest.mark.parametrize("seed", range(6))
def test_plans(seed):
    rnd = random.Random(seed)
    capacity = rnd.choice([7, 64, 4096])
    histogram = collections.Counter(min(capacity, max(1, int(rnd.lognormvariate(0, 1.2) * capacity / 4)))
                                    for _ in range(rnd.choice([1, 50, 5000])))
    plan = P.PackPlan(histogram, capacity)
    seen, used = collections.Counter(), collections.defaultdict(list)
    for length, rank, count, first, offset in plan.runs:
        assert rank == seen[length]
        seen[length] += count
        for k in range(count):
            used[first + k].append({"sequence_id": first + k, "offset": offset, "length": length})
    assert seen == histogram
    assert check_rows([r for rows in used.values() for r in rows], capacity) == plan.sequences
    least = -(-sum(k * v for k, v in histogram.items()) // capacity)
    assert plan.sequences <= 1.25 * least + 2


def test_nnls_is_a_least_squares_solution():
    rng = np.random.default_rng(1)
    for _ in range(10):
        a, b = rng.random((12, 20)), rng.random(12)
        x = P.nnls(a, b)
        grad = a.T @ (b - a @ x)
        assert (x >= 0).all() and (grad <= 1e-6).all() and np.abs(grad[x > 0]).max(initial=0) < 1e-6


def test_patterns_fill_exactly():
    for units in (1, 2, 7, 12):
        found = P.patterns(units)
        assert all(sum(p) == units and list(p) == sorted(p, reverse=True) for p in found)
        assert len(set(found)) == len(found)


def test_defined_cases(spark):
    voc = Vocabulary.load(spark, vocabulary_path(P.VOCABULARY))
    df = spark.createDataFrame([(1, None, 9), (1, None, 9), (2, "", 9), (3, "word " * 9000, 9)],
                               "doc_id long, text string, length int")
    pieces = materialize(P.token_pieces(df, voc).drop("ids"), "t")
    assert [r["length"] for r in pieces.orderBy("doc_id", "piece").collect()] == [1, 1, 1, 4096, 4096, 809]
    rows = P.pack(pieces, ["doc_id", "piece"]).collect()
    assert len(rows) == 6 and check_rows(rows, 4096) == 3
    assert P.pack(materialize(pieces.limit(0), "t0"), ["doc_id", "piece"]).count() == 0
    with pytest.raises(ValueError):
        P.pack(pieces.withColumn("length", F.lit(5000)), ["doc_id"]).count()


def test_one_very_common_length_is_dealt_over_salts(spark, monkeypatch):
    monkeypatch.setattr(P, "ROWS_PER_SALT", 50)
    rows = spark.range(2000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, 700)
                                    .otherwise(F.col("id") % 900 + 1).cast("long").alias("length"))
    out = P.pack(materialize(rows, "hot"), ["doc_id"]).collect()
    assert len(out) == 2000 and len({(r["sequence_id"], r["offset"]) for r in out}) == 2000
    check_rows(out, 4096)


def test_plain_words_take_the_short_way(monkeypatch):
    """Words of ASCII letters are not taken apart; the others, mixed with them, keep the library's ids."""
    with open(vocabulary_path(P.VOCABULARY), encoding="utf-8") as f:
        tok = P.WordTokenizer(f.read())
    library, seen, parts = Tokenizer.from_file(vocabulary_path(P.VOCABULARY)), [], P.WordTokenizer._parts
    monkeypatch.setattr(P.WordTokenizer, "_parts", staticmethod(lambda c: seen.append(c) or parts(c)))
    texts = ["The THE the. Été a1 <pad> <s", "", None, "Ünder (x) KK İ ipso\nFaCTO facto!"]
    got = [np.frombuffer(b, "<u4").tolist() for b in tok.encode_all(texts)]
    assert got == [library.encode(t or "", add_special_tokens=False).ids for t in texts]
    assert seen and not {"The", "THE", "ipso", "FaCTO"} & set(seen)
