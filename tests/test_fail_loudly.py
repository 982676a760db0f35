"""Ingest and streams: only a missing corpus is an empty one; folders are read whatever their name."""

import os

import pytest

from ragloom.operators import corpus as C
from ragloom.streaming import stream as ST


def load(spark):
    return spark.createDataFrame([("a", 0, "x"), ("a", 1, "y"), ("b", 2, "z")], "id string, load_seq long, input string")


def test_missing_corpus_is_empty_and_first_row_wins(spark, tmp_dir):
    path = f"{tmp_dir}/corpus"
    C.insert_if_absent(load(spark), path)
    C.insert_if_absent(load(spark), path)
    assert sorted(map(tuple, spark.read.parquet(path).collect())) == [("a", "x"), ("b", "z")]


def test_unreadable_corpus_fails(spark, tmp_dir):
    path = f"{tmp_dir}/corpus"
    os.makedirs(path)
    with open(f"{path}/part-0.parquet", "wb") as fh:
        fh.write(b"this is not parquet")
    with pytest.raises(Exception):
        C.insert_if_absent(load(spark), path)
    assert os.listdir(path) == ["part-0.parquet"]


def test_report_counts_repeated_corpus_ids_once(spark):
    ids = spark.createDataFrame([("a",), ("a",), ("a",), ("q",)], "id string")
    r = C.load_report(load(spark), ids).first()
    assert (r.attempted, r.distinct_ids, r.already_present, r.inserted) == (3, 2, 1, 1)


@pytest.mark.parametrize("as_folder", [True, False])
def test_stream_source_named_parquet(spark, tmp_dir, as_folder):
    path = f"{tmp_dir}/x.parquet"
    df = spark.range(5).selectExpr("concat('d', id) as id", "id as load_seq", "'t' as input").coalesce(1)
    if as_folder:
        df.write.parquet(path)
    else:
        df.write.parquet(f"{tmp_dir}/folder")
        part = next(f for f in os.listdir(f"{tmp_dir}/folder") if f.startswith("part-"))
        os.rename(f"{tmp_dir}/folder/{part}", path)
    corpus = f"{tmp_dir}/corpus"
    q = ST.document_stream(spark, path, df.schema, corpus, lambda b: b)
    ST.run_to_end(q)
    assert spark.read.parquet(corpus).count() == 5


