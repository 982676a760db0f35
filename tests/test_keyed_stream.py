"""Document stream with keyed state: batches, restarts, replays, existing ids."""

import os

from pyspark.sql import functions as F

from conftest import SF_SMALL
from ragloom.operators import corpus as C
from ragloom.streaming import keyed as KS
from ragloom.streaming import stream as ST

SCHEMA = "doc_id long, text string, lang string"


def _prep(b):
    return b.select(C.content_id("text").alias("id"), F.col("doc_id").alias("load_seq"), "doc_id", "lang")


def _write(spark, folder, rows, mode="append"):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode(mode).parquet(folder)


def _run(spark, tmp, **kw):
    schema = spark.createDataFrame([], SCHEMA).schema
    ST.run_to_end(KS.keyed_document_stream(spark, f"{tmp}/in", schema, f"{tmp}/out", _prep, checkpoint=f"{tmp}/ck", **kw))
    return sorted(((r["doc_id"], r["lang"]) for r in spark.read.parquet(f"{tmp}/out").collect()), key=str)


def test_restart_goes_on_and_inserts_nothing_twice(spark, tmp_dir):
    _write(spark, f"{tmp_dir}/in", [(3, "a", "x"), (1, "a", "y"), (2, "b", "z")])
    assert _run(spark, tmp_dir) == [(1, "y"), (2, "z")]
    assert _run(spark, tmp_dir) == [(1, "y"), (2, "z")]                       # nothing new
    _write(spark, f"{tmp_dir}/in", [(0, "a", "later"), (9, "c", "new"), (8, "c", "new")])
    assert _run(spark, tmp_dir) == [(1, "y"), (2, "z"), (8, "new")]           # the state outlives the query


def test_ids_of_an_existing_corpus_and_bounded_batches(spark, tmp_dir):
    spark.createDataFrame([("b",)], "t string").select(C.content_id("t").alias("id"), F.lit(7).alias("x")) \
        .write.parquet(f"{tmp_dir}/corpus")
    for i in range(3):
        _write(spark, f"{tmp_dir}/in", [(10 + i, "a", "x"), (20 + i, "b", "y"), (30 + i, f"c{i}", "z"), (None, None, None)])
    got = _run(spark, tmp_dir, existing=f"{tmp_dir}/corpus", max_files_per_trigger=1)
    assert len([r for r in got if r[1] == "x"]) == 1 and not [r for r in got if r[1] == "y"]
    assert sorted(r[0] for r in got if r[1] == "z") == [30, 31, 32]


def test_failed_batch_is_replayed_once(spark, tmp_dir):
    """A batch whose commit is missing runs again: its state and its files are those of one run."""
    _write(spark, f"{tmp_dir}/in", [(1, "a", "x"), (2, "b", "x")])
    first = _run(spark, tmp_dir)
    for name in os.listdir(f"{tmp_dir}/ck/commits"):
        if name.strip(".crc").lstrip(".") == "0":
            os.remove(f"{tmp_dir}/ck/commits/{name}")
    assert _run(spark, tmp_dir) == first == [(1, "x"), (2, "x")]


def test_order_ties_and_nulls(spark, tmp_dir):
    rows = [(None, "a", "first"), (5, "a", "b"), (5, "a", "a"), (None, "n", "only")]
    _write(spark, f"{tmp_dir}/in", rows)
    assert sorted(_run(spark, tmp_dir), key=str) == sorted([(5, "a"), (None, "only")], key=str)


def test_given_documents(spark, tmp_dir):
    src = f"{SF_SMALL}/documents.parquet"
    docs = spark.read.parquet(src)
    ST.run_to_end(KS.keyed_document_stream(spark, src, docs.schema, f"{tmp_dir}/out", _prep, checkpoint=f"{tmp_dir}/ck"))
    got = spark.read.parquet(f"{tmp_dir}/out").select("id", "doc_id")
    want = docs.groupBy(C.content_id("text").alias("id")).agg(F.min("doc_id").alias("doc_id"))
    assert got.count() == want.count() and got.exceptAll(want).count() == 0
