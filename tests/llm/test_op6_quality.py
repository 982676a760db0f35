"""Quality rules against brute force."""

import collections
import math
import random
import re

import xxhash

from brute import SPACE_WORDS
from conftest import SF_SMALL
from ragloom.llm import op6_quality as Q


def h64(*words):
    seed = 42
    for w in words:
        seed = xxhash.xxh64_intdigest(w.encode(), seed=seed)
    return (seed - (1 << 64) if seed >> 63 else seed) % Q.BUCKETS


def grams(words):
    return [h64(w) for w in words] + [h64(a, b) for a, b in zip(words, words[1:], strict=False)]


def counts(text):
    t = text or ""
    w = SPACE_WORDS.findall(t)
    tri = [tuple(w[i:i + 3]) for i in range(len(w) - 2)]
    n = collections.Counter(tri)
    covered = {j for i, x in enumerate(tri) if n[x] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in t.split("\n") if SPACE_WORDS.search(x)]
    return (len(w), sum(map(len, w)), sum(c in Q.SYMBOLS for c in t), len(lines) - len(set(lines)), len(covered))


NAMES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def test_counts_of_odd_texts(spark):
    rnd = random.Random(2)
    texts = [None, "", " \n\t", "a", "a a a", "a a a a", "a b c a b c", "x\x0by\x0cz", "é # * $ % & | < > &&", "l\nl\nl\n \n",
             "w " * 3000, "\u00a0nbsp\u00a0 one", "a b c d " * 30]
    texts += [" ".join(rnd.choice("ab\ncd#") for _ in range(rnd.randint(0, 80))) for _ in range(150)]
    df = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts + texts)],
                               "doc_id int, text string, kept string")
    for r in Q.judge(df, [0.0] * Q.BUCKETS).collect():
        want = counts(texts[r["doc_id"] % len(texts)])
        assert tuple(r[n] for n in NAMES) == want
        assert r["base_failed"] == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert r["kept"] == (not r["base_failed"])
    assert Q.judge(df.limit(0), [0.0] * Q.BUCKETS).count() == 0


def test_query_matches_brute_force(spark):
    docs = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()}
    good = {r["doc_id"] for r in spark.read.parquet(f"{SF_SMALL}/labels.parquet").collect() if r["quality"] == 1}
    raw, target = collections.Counter(), collections.Counter()
    per = {d: grams(SPACE_WORDS.findall(t)) for d, t in docs.items()}
    for d, g in per.items():
        raw.update(g)
        if d in good:
            target.update(g)
    n_t, n_r = sum(target.values()) + Q.BUCKETS, sum(raw.values()) + Q.BUCKETS
    table = [round(math.log((target[b] + 1) / n_t) - math.log((raw[b] + 1) / n_r), 6) for b in range(Q.BUCKETS)]
    rows = Q.op6_quality(spark, SF_SMALL).collect()
    assert len(rows) == len(docs)
    for r in rows:
        want = counts(docs[r["doc_id"]])
        assert tuple(r[n] for n in NAMES) == want
        g = per[r["doc_id"]]
        score = sum(table[b] for b in g) / len(g) if g else None
        assert (score is None) == (r["llr"] is None) and (score is None or abs(score - r["llr"]) < 2e-6)
        if score is not None and abs(score - Q.THRESHOLD) > 1e-5:
            assert r["kept"] == (not r["base_failed"] and score >= Q.THRESHOLD)


def test_trusted_texts_stay_and_junk_goes(spark):
    rows = Q.op6_quality(spark, "/root/testdata/sf0.01").collect()
    quality = {r["doc_id"]: r["quality"] for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    kept = collections.defaultdict(list)
    for r in rows:
        if r["doc_id"] in quality and not r["base_failed"]:
            kept[quality[r["doc_id"]]].append(r["kept"])
    assert sum(kept[1]) >= 0.98 * len(kept[1]) and sum(kept[0]) <= 0.2 * len(kept[0])


def test_no_trusted_words():
    assert set(Q.ratios([0] * 4, [3, 0, 1, 2])) == {0.0}
    assert re.fullmatch(Q.SPACE_RUN, " \t\n\x0b\x0c\r")
