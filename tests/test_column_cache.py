"""Memoised column builders: same expression object per context, Column arguments bypass."""

from pyspark.sql import functions as F

from ragloom.functions import text as TX
from ragloom.operators import metrics as M


def test_builders_are_memoised_per_context(spark):
    assert TX.hash_embedding("question", 64) is TX.hash_embedding("question", 64)
    assert TX.hash_embedding("question", 64) is not TX.hash_embedding("question", 32)
    assert TX.tokens(F.col("question")) is not TX.tokens(F.col("question"))
    a, b = M.answer_metric_columns(64), M.answer_metric_columns(64)
    assert a is not b and all(x is y for x, y in zip(a, b))    # a fresh list of the same columns


def test_cached_column_reused_across_frames(spark):
    one = spark.createDataFrame([("a b a",)], "question string")
    two = spark.createDataFrame([("b c",), (None,)], "question string")
    h = TX.hash_embedding("question", 4)
    r1 = one.select(F.aggregate(h, F.lit(0.0), lambda s, x: s + x).alias("n")).first().n
    r2 = [r.n for r in two.select(F.aggregate(h, F.lit(0.0), lambda s, x: s + x).alias("n")).collect()]
    assert r1 == 3.0 and r2 == [2.0, None]
