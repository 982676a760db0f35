"""Embedding stage: native hashing vs the Python form, batching, retry, distinct texts."""

import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from ragloom.operators import embed as E
from ragloom.sources import testdata as TD


def test_native_equals_python_embedder(spark):
    conv = TD.read_table(spark, SF_SMALL, "conversations").select("conv_id", "turn", "text")
    native = E.embed(conv, "text", "v", dim=64)
    py = E.embed(conv, "text", "v", embedder=E.HashEmbedder(64), batch_size=7)
    a = {(r.conv_id, r.turn): list(r.v) for r in native.collect()}
    b = {(r.conv_id, r.turn): list(r.v) for r in py.collect()}
    assert a == b and len(a) == conv.count()


def test_hashing_is_exact_counts(spark):
    df = spark.createDataFrame([("Hello, hello WORLD!",), ("",), (None,)], "t string")
    rows = E.embed(df, "t", "v", dim=16).collect()
    assert sum(rows[0].v) == 3.0 and max(rows[0].v) >= 2.0
    assert sum(rows[1].v) == 0.0
    assert rows[2].v is None


class Flaky:
    """Fails the first two calls of every task, then answers."""

    def __init__(self):
        self.n = 0

    def __call__(self, texts):
        self.n += 1
        if self.n <= 2:
            raise E.RateLimited("slow down")
        return [[float(len(t))] for t in texts]


def test_retry_with_backoff():
    waits = []
    flaky = Flaky()
    assert E.call_model(flaky, ["ab"], attempts=5, sleep=waits.append) == [[2.0]]
    assert [int(w) for w in waits] == [1, 2] and all(w <= 1.1 * int(w) for w in waits)
    always = Flaky()
    always.n = -100
    with pytest.raises(E.RateLimited):
        E.call_model(always, ["x"], attempts=3, sleep=lambda s: None)


def test_other_failures_and_short_replies_are_raised_at_once():
    calls = []

    def broken(batch):
        calls.append(batch)
        raise KeyError("bad input")

    with pytest.raises(KeyError):
        E.call_model(broken, ["x"], sleep=lambda s: pytest.fail("no waiting"))
    assert len(calls) == 1
    with pytest.raises(ValueError):
        E.call_model(lambda b: [[1.0]], ["x", "y"])


def test_batches_keep_order_and_nulls(spark):
    df = spark.createDataFrame([(i, None if i % 5 == 0 else "w" * i) for i in range(40)], "i int, t string")

    class Len:
        def __call__(self, texts):
            assert len(texts) <= 3
            return [[float(len(t))] for t in texts]

    out = E.embed(df, "t", "v", embedder=Len(), batch_size=3).collect()
    for r in out:
        assert (r.v is None) if r.i % 5 == 0 else (list(r.v) == [float(r.i)])


def test_embed_distinct_texts_once(spark):
    df = spark.createDataFrame([(1, "a b"), (2, "a b"), (3, "c"), (4, None), (5, None)], "k int, t string")
    out = E.embed_distinct(df, "t", "v", dim=8).orderBy("k").collect()
    assert out[0].v == out[1].v and out[0].v != out[2].v
    assert [r.v for r in out[3:]] == [None, None]
