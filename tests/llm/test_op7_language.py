"""Language ID: held-out accuracy, exact forward-backward, code switching, defined cases."""

import itertools
import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import SF_MID
from ragloom.llm import op7_language as L


@pytest.fixture(scope="module")
def model(spark):
    docs = spark.read.parquet(f"{SF_MID}/documents.parquet")
    return L.fit(docs.select("doc_id", "text", "lang"))


def test_forward_backward_equals_enumeration():
    rng = np.random.default_rng(0)
    k, steps = 3, 4
    scores, trans, start = rng.normal(size=(2, steps, k)), rng.normal(size=(k, k)), rng.normal(size=k)
    mask = np.array([[1, 1, 1, 1], [1, 1, 1, 0]], bool)
    post, pairs, log_z = L.forward_backward(scores, mask, trans, start)
    want_pairs, want_z = np.zeros((k, k)), 0.0
    for c in range(2):
        n, weight = int(mask[c].sum()), {}
        for y in itertools.product(range(k), repeat=n):
            s = start[y[0]] + sum(scores[c, t, y[t]] for t in range(n)) + sum(trans[y[t], y[t + 1]] for t in range(n - 1))
            weight[y] = np.exp(s)
        z = sum(weight.values())
        want_z += np.log(z)
        for t in range(n):
            for lab in range(k):
                assert abs(post[c, t, lab] - sum(w for y, w in weight.items() if y[t] == lab) / z) < 1e-9
        for y, w in weight.items():
            for t in range(n - 1):
                want_pairs[y[t], y[t + 1]] += w / z
    assert np.allclose(pairs, want_pairs) and abs(log_z - want_z) < 1e-9


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF_MID}/documents.parquet").select("doc_id", "lang")
    out = L.op7_language(spark, SF_MID).join(docs, "doc_id").where("held_out")
    r = out.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")).alias("a"), F.min("score"), F.max("score")).first()
    assert r["a"] > 0.97 and 0 <= r[1] and r[2] <= 1


def test_prediction_reads_the_text_only(spark, model):
    df = spark.read.parquet(f"{SF_MID}/documents.parquet").limit(50).select("doc_id", "text", "lang", "source")
    a = [r["lang_pred"] for r in L.identify(df.orderBy("doc_id"), model).collect()]
    b = [r["lang_pred"] for r in L.identify(df.orderBy("doc_id").withColumns(
        {"lang": F.lit("xx"), "source": F.lit(None)}), model).collect()]
    assert a == b


def test_code_switching(spark, model):
    rows = spark.read.parquet(f"{SF_MID}/documents.parquet").where("n_chars > 600").select("lang", "text").collect()
    by = {lang: next(r["text"] for r in rows if r["lang"] == lang) for lang in ("en", "de")}
    en, de = L.words_of(by["en"])[:50], L.words_of(by["de"])[:50]
    post = L.Labeller(model).word_posteriors(en + de)
    i, j = model["langs"].index("en"), model["langs"].index("de")
    assert (post[:50].argmax(1) == i).mean() > 0.85 and (post[50:].argmax(1) == j).mean() > 0.85
    assert np.diag(model["trans"]).min() > (model["trans"] - np.diag(np.diag(model["trans"]))).max()


def test_defined_cases(spark, model):
    df = spark.createDataFrame([(None, 1), ("", 2), ("123 !?", 3), ("the and of that " * 5000, 4)], "text string, score int")
    got = [(r["lang_pred"], r["score"]) for r in L.identify(df, model).collect()]
    assert got[:3] == [("und", 0.0)] * 3 and got[3][0] == "en" and 0.5 < got[3][1] <= 1
    assert L.identify(df.limit(0), model).count() == 0
    assert {r["lang_pred"] for r in L.identify(df, L.train([])).collect()} == {"und"}
    none = spark.createDataFrame([(1, "x", None)], "doc_id long, text string, lang string")
    assert L.fit(none) is None
    out = L.language_stage(spark, spark.createDataFrame([(1, "a b", "en"), (2, None, "en")],
                                                        "doc_id long, text string, lang string"), "")
    assert out.columns == ["doc_id", "text", "lang"] and [r["doc_id"] for r in out.collect()] == [1]


def test_numbers_are_no_letters(spark, model):
    df = spark.createDataFrame([("½ ² Ⅷ ①",), ("x²y ½tsp",)], "text string")
    got = [(r["lang_pred"], r["score"]) for r in L.identify(df, model).collect()]
    assert got[0] == ("und", 0.0) and got[1][0] != "und"
    assert L.words_of("x²y ½tsp Ⅷ") == ["x", "y", "tsp"]


def test_every_letter_of_a_long_run_counts(spark, model):
    assert "".join(L.words_of("ab" * 2500)) == "ab" * 2500
    rows = spark.read.parquet(f"{SF_MID}/documents.parquet").where("n_chars > 600").select("lang", "text").collect()
    en, de = ("".join(next(L.words_of(r["text"]) for r in rows if r["lang"] == lang)) for lang in ("en", "de"))
    df = spark.createDataFrame([(en[:40] + (de * 10)[:2000],)], "text string")
    assert L.identify(df, model).first()["lang_pred"] == "de"


def test_features_of_many_words_are_those_of_each():
    """Hashed together, in the order that fixes the rounding of their sums."""
    words = ["a", "ab", "abc", "abcd", "abcde", "é", "été", "漢", "漢字漢字漢字", "𐐀b", "x" * 40, "the", "ﬁß"]
    feats = L.Features({"the": 1, "漢": 0})
    flat, sizes = feats.flat(words)
    want = [feats.of(w) for w in words]
    assert sizes.tolist() == [len(w) for w in want]
    assert flat.tolist() == [i for w in want for i in w]


def _peak(fn) -> int:
    tracemalloc.start()
    try:
        fn()
        return tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()


def test_forward_backward_holds_two_arrays():
    rng = np.random.default_rng(1)
    scores, mask = rng.normal(size=(600, 128, 4)), np.ones((600, 128), bool)
    assert _peak(lambda: L.forward_backward(scores, mask, np.zeros((4, 4)), np.zeros(4))) < 3.5 * scores.nbytes


def test_training_holds_little_beside_its_features(monkeypatch):
    """The driver learns: what it holds for a word type is a few numbers a feature, not lists of them."""
    monkeypatch.setattr(L, "EPOCHS", 1)
    rng = np.random.default_rng(2)
    words = ["".join(rng.choice(list("abcdefghij"), 12)) for _ in range(30_000)]
    rows = [("de" if i % 2 else "en", words[i * 100:i * 100 + 100]) for i in range(300)]
    n_features = sum(len(f) for f in map(L.Features({}).of, words[:1000])) * len(words) // 1000
    assert _peak(lambda: L.train(rows)) < 52 * n_features
