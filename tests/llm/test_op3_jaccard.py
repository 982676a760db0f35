"""Jaccard join against brute force."""

import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from brute import jaccard_components, shingle_set
from conftest import SF_SMALL
from ragloom.llm import op3_jaccard as J


def run(spark, docs, parts=5):
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(parts)
    return {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in J.jaccard_components(df).collect()}


def near_copies(rnd, base, n, edits):
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(rnd.randint(0, edits)):
            w[rnd.randrange(len(w))] = f"e{rnd.randrange(10**6)}"
        out.append(" ".join(w))
    return out


def test_query_matches_brute_force(spark):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in J.op3_jaccard_join(spark, SF_SMALL).collect()}
    assert got == jaccard_components(docs)


def test_groups_larger_than_a_small_bucket(spark):
    """Chains and crowds of near copies at the edge of the threshold, shared passages, exact copies."""
    rnd = random.Random(4)
    words = [f"w{i}" for i in range(500)]
    passage = [rnd.choice(words) for _ in range(60)]
    texts = []
    for size, edits in ((60, 5), (40, 2), (25, 9)):
        texts += near_copies(rnd, [rnd.choice(words) for _ in range(120)], size, edits)
    texts += [" ".join([rnd.choice(words) for _ in range(rnd.randint(10, 200))] + passage) for _ in range(60)]
    texts += [" ".join(passage)] * 10 + ["Alone", "alone", "two words", "", None, "  \n ", "A b c D", "a B c d"]
    chain = [rnd.choice(words) for _ in range(100)]
    for i in range(20):
        chain = chain[4:] + [f"c{i}a", f"c{i}b", f"c{i}c", f"c{i}d"]
        texts.append(" ".join(chain))
    rnd.shuffle(texts)
    docs = [(i * 7 + 1, t) for i, t in enumerate(texts)]
    assert run(spark, docs) == jaccard_components(docs)


def test_frequent_passages_make_no_pairs(spark):
    """Sets that share a passage of frequent shingles don't meet, linked ones behind the passage are found."""
    rnd = random.Random(21)
    passage = [f"p{i}" for i in range(60)]
    texts = [" ".join(f"u{i}x{j}" for j in range(45)) + " " + " ".join(passage) for i in range(150)]
    texts += near_copies(rnd, texts[0].split(), 5, 2) + near_copies(rnd, texts[1].split(), 5, 2)
    texts += [" ".join(passage + [f"v{i}{j}" for j in range(i % 12)]) for i in range(40)]       # hot tokens alone link these
    docs = [(i, t) for i, t in enumerate(texts)]
    assert run(spark, docs) == jaccard_components(docs)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    levels = spark.sparkContext.broadcast(J._levels(J._scan(df)))
    bitmaps = J._scan(df).where("n > 0").select(F.col("doc_id").alias("node"), "bits")
    buckets = J._buckets(J._prefixes(df, levels), bitmaps)
    in_hot = {r["node"] for r in buckets.where("hot_bucket").select("node").distinct().collect()}
    assert in_hot and not in_hot & set(range(2, 150))
    pairs = J._second_order(J._all_pairs(buckets.withColumn("label", F.col("node"))), df, levels)
    assert pairs.count() < 5 * len(texts)


def test_defined_cases(spark):
    rows = [(None, "a b c d e f"), (5, "a b c d e f"), (5, "a b c d e f"), (9, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("component_id", F.lit("clash"))
    got = sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in J.jaccard_components(df).collect()), key=str)
    assert got == sorted([(None, 2, None), (5, 2, 5), (5, 2, 5), (9, 0, 9)], key=str)
    assert run(spark, []) == {}


def test_prefix_filters_lose_no_link():
    rnd = random.Random(8)
    levels = np.zeros(1 << 10, np.uint8)
    levels[::3] = 2
    checked = 0
    for _ in range(1500):
        base = [rnd.getrandbits(64) for _ in range(rnd.randint(1, 60))]
        other = [x for x in base if rnd.random() < 0.93] + [rnd.getrandbits(64) for _ in range(rnd.randint(0, 6))]
        if not other:
            continue
        a, b = (np.unique(np.array(x, np.uint64)) for x in (base, other))
        if J.linked(a, b):
            checked += 1
            assert J.may_link(a, b, levels, 1) and J.may_link(a, b, levels, 2)
    assert checked > 300


def test_linked_sets_share_more_than_they_leave_out():
    rnd = random.Random(12)
    levels = np.zeros(1 << 10, np.uint8)
    checked = 0
    for _ in range(2000):
        base = [rnd.getrandbits(64) for _ in range(rnd.randint(1, 150))]
        other = [x for x in base if rnd.random() < 0.95] + [rnd.getrandbits(64) for _ in range(rnd.randint(0, 8))]
        if not other:
            continue
        a, b = (np.unique(np.array(x, np.uint64)) for x in (base, other))
        if not J.linked(a, b):
            continue
        checked += 1
        pa_, pb = (J.in_order(x, levels, 1)[:J.probe_size(len(x))].tolist() for x in (a, b))
        assert len(set(pa_) & set(pb)) >= 1 + min(len(a), len(b)) // J.SPARE
        rarity = {t: rnd.random() for t in set(pa_) | set(pb)}
        ra, rb = ({t for t in sorted(p, key=rarity.get)[:len(p) - J.dropped(n)]} for p, n in ((pa_, len(a)), (pb, len(b))))
        need = -(-J.NUM * (len(a) + len(b)) // (J.NUM + J.DEN)) - max(
            len(a) - len(pa_), len(b) - len(pb)) - max(J.dropped(len(a)), J.dropped(len(b)))
        assert len(ra & rb) >= max(1, need)
    assert checked > 500


def test_batches_give_the_sets_of_single_texts():
    rnd = random.Random(2)
    texts = [None, "", " \t", "one", "a b c d", "A b  c D e", "x" * 3_000_000 + " y z w v u", "é漢 Ω ß É é"] * 3
    texts += ["".join(rnd.choice("aB \n\x0bé") for _ in range(rnd.randrange(60))) for _ in range(500)]
    rnd.shuffle(texts)
    for got, text in zip(J.shingle_sets(pa.array(texts)), texts, strict=True):
        assert got.tolist() == J.shingles(text).tolist() and len(got) == len(shingle_set(text))
    sliced = pa.array(["skip", *texts]).slice(1)
    assert [x.tolist() for x in J.shingle_sets(sliced)] == [x.tolist() for x in J.shingle_sets(pa.array(texts))]
    assert J.shingle_sets(pa.array([], pa.string())) == []


def test_bitmaps_never_differ_more_than_the_sets():
    rnd = random.Random(3)
    for _ in range(300):
        a = {rnd.getrandbits(64) for _ in range(rnd.randint(1, 400))}
        b = {x for x in a if rnd.random() < 0.9} | {rnd.getrandbits(64) for _ in range(rnd.randint(1, 30))}
        x, y = (J.bitmap(np.array(sorted(s), np.uint64)) for s in (a, b))
        assert int(np.bitwise_count((x ^ y).view(np.uint64)).sum()) <= len(a ^ b)


def test_shingles_are_the_brute_ones():
    for text in ("", None, "A b", "a b c d e", "a b c d e f a b c d e", "É x\x0by\x0cz\tw v u"):
        assert len(J.shingles(text)) == len(shingle_set(text))
    assert J.shingles("A B").tolist() == J.shingles("a  b\n").tolist()


def test_stage_keeps_one_of_each_group(spark):
    rows = [(3, "a b c d e f", "x"), (1, "A b c d e f", "y"), (1, "A b c d e f", "y"), (2, "other words here now too", "z"),
            (None, "a b c d e f", "n")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    out = J.jaccard_stage(spark, docs, "")
    assert out.columns == docs.columns
    assert sorted((r["doc_id"] or 0 for r in out.collect())) == [0, 1, 2]


def test_long_texts_in_blocks_have_the_same_shingles(monkeypatch):
    rnd = random.Random(11)
    texts = [" ".join("w" * rnd.randint(1, 9) + str(rnd.randint(0, 99)) for _ in range(rnd.choice([3, 40, 900])))
             for _ in range(30)] + ["x" * 9000, "x" * 9000 + " a b c d e " + "y" * 5000 + " ", " " * 3000 + "a b", "", None]
    want = [J.shingles(t).tolist() for t in texts]
    for size in (1, 64, 1000):
        monkeypatch.setattr(J, "GROUP_BYTES", size)
        assert [s.tolist() for s in J.shingle_sets(pa.array(texts, pa.large_string()))] == want
