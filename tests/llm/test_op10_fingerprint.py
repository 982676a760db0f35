"""Fingerprints: edited texts, neighbours, pruning."""

import hashlib
import random
import statistics

from pyspark.sql import functions as F

from conftest import SF_MID
from ragloom.llm import op10_fingerprint as S


def test_query_on_all_documents(spark):
    rows = {r["doc_id"]: r for r in S.op10_fingerprint(spark, SF_MID).collect()}
    docs = sorted((r["doc_id"], r["text"] or "") for r in spark.read.parquet(f"{SF_MID}/documents.parquet").collect())
    assert len(rows) == len(docs)
    prints = {}
    for i, (d, t) in enumerate(docs):
        following = docs[(i + 1) % len(docs)][1]
        m = len(t) // 4
        edited = t[:len(t) - m] + following[:m]
        r = rows[d]
        assert r["n_chars"] == len(t) and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert prints.setdefault(t, r["fingerprint"]) == r["fingerprint"]
        a, b, c = (set(x[j:j + 8] for j in range(0, len(x), 8)) for x in
                   (r["fingerprint"], r["edited_fingerprint"], rows[docs[(i + 1) % len(docs)][0]]["fingerprint"]))
        assert abs(r["near_edited"] - len(a & b) / len(a | b)) < 1e-12
        assert abs(r["near_next"] - len(a & c) / len(a | c)) < 1e-12
    longer = [rows[d] for d, t in docs if len(t) > 500]
    assert statistics.median(r["near_edited"] for r in longer) > 0.5
    assert sum(r["near_edited"] > 0.3 for r in longer) > 0.95 * len(longer)
    assert statistics.median(r["near_next"] for r in longer) < 0.05


def test_buckets_don_t_change_the_successors(spark):
    rnd = random.Random(3)
    ids = rnd.sample(range(-5000, 10**9), 300) + [None, 7, 7]
    df = spark.createDataFrame([(d, f"text of {d} {i}") for i, d in enumerate(ids)], "doc_id long, text string")
    order = sorted(((S.NO_ID if d is None else d, f"text of {d} {i}") for i, d in enumerate(ids)))
    want = {t: order[(i + 1) % len(order)][1] for i, (_, t) in enumerate(order)}
    for size in (7, 100, 10_000):
        got = {r["text"]: r["next_text"] for r in S.with_next(df, size).collect()}
        assert got == want


def test_defined_cases(spark):
    df = spark.createDataFrame([(1, None, "c"), (2, "", "c"), (3, "one", "c"), (4, "one", "c"), (5, "a b c", "c")],
                               "doc_id long, text string, spots string")
    got = {r["doc_id"]: r["spots"] for r in S.fingerprint(df).collect()}
    assert got[1] == got[2] and got[3] == got[4] and got[3] != got[5] != got[1]
    one = S.with_next(df.where("doc_id = 5").select("doc_id", "text")).collect()
    assert len(one) == 1 and one[0]["next_text"] == "a b c"
    assert S.with_next(df.limit(0).select("doc_id", "text")).count() == 0


def test_pruned_jaccard(spark):
    df = spark.createDataFrame([(["a", "b"], ["b", "a"]), (["a"], [str(i) for i in range(50)] + ["a"]), (["a"], ["b"])],
                               "a array<string>, b array<string>")
    full = [r[0] for r in df.select(S.pruned_jaccard(F.col("a"), F.col("b"))).collect()]
    assert full == [1.0, 1 / 51, 0.0]
    assert [r[0] for r in df.select(S.pruned_jaccard(F.col("a"), F.col("b"), 0.5)).collect()] == [1.0, 0.0, 0.0]


def test_length_partitions_bound_the_similarity(spark):
    df = spark.range(1, 400).select(F.transform(F.sequence(F.lit(1), F.col("id")), lambda x: x.cast("string")).alias("s"))
    got = [r[0] for r in df.select(S.length_partition(F.col("s"))).collect()]
    assert got == sorted(got)
    for n in range(1, 400):
        for m in (int(n * 0.8) + 1, n):
            if m >= 0.8 * n and m <= n:
                assert abs(got[n - 1] - got[m - 1]) <= 2
