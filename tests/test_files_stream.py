"""Sources and sinks (JSON, CSV with BOM) and the two streams."""

import csv
import glob
import json

import pandas as pd
import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from ragloom.operators import corpus as C
from ragloom.operators import topk as K
from ragloom.sources import files as FS
from ragloom.sources import testdata as TD
from ragloom.streaming import stream as ST


def test_raw_corpus_defaults_and_rejects(spark, tmp_dir):
    p = f"{tmp_dir}/raw.json"
    with open(p, "w", encoding="utf-8") as f:
        json.dump([{"input": "가", "casename": "c1"}, {"input": "다", "output": None},
                   {"input": "라", "output": "x"}], f, ensure_ascii=False)
    got = [tuple(r) for r in FS.read_raw_corpus(spark, p).collect()]
    assert got == [("가", ""), ("다", ""), ("라", "x")]
    bad = f"{tmp_dir}/bad.json"
    with open(bad, "w", encoding="utf-8") as f:
        json.dump([{"output": "x"}], f)
    with pytest.raises(ValueError):
        FS.read_raw_corpus(spark, bad)


def test_embedded_corpus_and_eval_set(spark, tmp_dir):
    p = f"{tmp_dir}/emb.json"
    with open(p, "w", encoding="utf-8") as f:
        json.dump([{"id": "q_0", "input": "a", "output": "b", "embedding": [0.5, 1.5]}], f)
    r = FS.read_embedded_corpus(spark, p).first()
    assert r.id == "q_0" and list(r.embedding) == [0.5, 1.5]
    e = f"{tmp_dir}/eval.json"
    with open(e, "w", encoding="utf-8") as f:
        json.dump([{"input": "질문", "output": "답"}], f, ensure_ascii=False)
    assert [tuple(x) for x in FS.read_eval_set(spark, e).collect()] == [("질문", "답")]


def test_answer_sheet_csv_with_bom(spark, tmp_dir):
    p = f"{tmp_dir}/answers.csv"
    with open(p, "w", encoding="utf-8-sig", newline="") as f:
        f.write('user_input,response,reference\n"a ""x"", b","l1\nl2",r\nq2,,ref2\n')
    got = [tuple(r) for r in FS.read_answer_sheet(spark, p).collect()]
    want = [tuple(None if pd.isna(v) else v for v in row)
            for row in pd.read_csv(p, encoding="utf-8-sig").itertuples(index=False)]
    assert got == want == [('a "x", b', "l1\nl2", "r"), ("q2", None, "ref2")]


def test_scores_csv_round_trip(spark, tmp_dir):
    df = spark.createDataFrame([(1, "질문, \"q\"", ["c1", "c2"], 0.5)],
                               "qid int, question string, contexts array<string>, faithfulness double")
    out = f"{tmp_dir}/scores"
    FS.write_scores_csv(df.coalesce(1), out)
    part = glob.glob(f"{out}/part-*.csv")[0]
    back = pd.read_csv(part, encoding="utf-8-sig")
    assert list(back.columns) == ["qid", "question", "contexts", "faithfulness"]
    assert back.iloc[0].question == '질문, "q"' and json.loads(back.iloc[0].contexts) == ["c1", "c2"]
    with open(part, "rb") as f:
        assert f.read(3) == b"\xef\xbb\xbf"


def test_json_sink_keeps_non_ascii(spark, tmp_dir):
    out = f"{tmp_dir}/j"
    FS.write_json(spark.createDataFrame([("해당 → ok",)], "t string").coalesce(1), out)
    text = open(glob.glob(f"{out}/part-*")[0], encoding="utf-8").read()
    assert "해당 → ok" in text


def test_file_order_key(spark, tmp_dir):
    p = f"{tmp_dir}/lines.json"
    with open(p, "w") as f:
        for i in range(50):
            f.write(json.dumps({"input": f"t{i}"}) + "\n")
    df = FS.with_file_order(spark.read.schema(FS.RAW_CORPUS).json(p))
    ids = C.positional_ids(df, ["file_order"]).select("id", "input").collect()
    assert sorted((int(r.id[2:]), r.input) for r in ids) == [(i, f"t{i}") for i in range(50)]


def test_question_stream_equals_batch(spark, tmp_dir):
    vc = TD.vector_corpus(spark, SF_SMALL)
    src = f"{SF_SMALL}/embeddings.parquet"
    q, sink = ST.question_stream(
        spark, src, spark.read.parquet(src).schema, vc, 3,
        prepare=lambda b: b.select(F.col("vec_id").alias("qid"), F.col("embedding").alias("qvec"),
                                   F.col("vec_id").alias("self_id")),
        exclude_col="self_id", sink=f"{tmp_dir}/sink", checkpoint=f"{tmp_dir}/ck")
    ST.run_to_end(q)
    streamed = sorted(tuple(r) for r in ST.read_sink(spark, sink).select("qid", "rk", "id").collect())
    batch = sorted(tuple(r) for r in K.top_k(vc, TD.vector_queries(vc), 3, exclude_col="self_id")
                   .select("qid", "rk", "id").collect())
    assert streamed == batch


def test_document_stream_replay_is_idempotent(spark, tmp_dir):
    corpus = f"{tmp_dir}/corpus"
    src = f"{SF_SMALL}/documents.parquet"
    schema = spark.read.parquet(src).schema

    def prep(b):
        return b.select(C.content_id("text").alias("id"), F.col("doc_id").alias("load_seq"), "doc_id")

    for ck in ("ck1", "ck2"):          # second run = full replay with a fresh checkpoint
        ST.run_to_end(ST.document_stream(spark, src, schema, corpus, prep, checkpoint=f"{tmp_dir}/{ck}"))
    got = spark.read.parquet(corpus)
    docs = spark.read.parquet(src)
    assert got.count() == docs.select(F.md5("text")).distinct().count()
    assert got.groupBy("id").count().where("count > 1").count() == 0
    first = docs.groupBy(C.content_id("text").alias("id")).agg(F.min("doc_id").alias("doc_id"))
    assert got.select("id", "doc_id").exceptAll(first).count() == 0


def test_question_stream_bounded_batches(spark, tmp_dir):
    """One file per micro-batch: the backlog drains in several epochs, same rows as batch."""
    vc = TD.vector_corpus(spark, SF_SMALL)
    src = f"{tmp_dir}/questions"
    spark.read.parquet(f"{SF_SMALL}/embeddings.parquet").repartition(3).write.parquet(src)
    q, sink = ST.question_stream(
        spark, src, spark.read.parquet(src).schema, vc, 2,
        prepare=lambda b: b.select(F.col("vec_id").alias("qid"), F.col("embedding").alias("qvec"),
                                   F.col("vec_id").alias("self_id")),
        exclude_col="self_id", sink=f"{tmp_dir}/sink", checkpoint=f"{tmp_dir}/ck",
        max_files_per_trigger=1)
    ST.run_to_end(q)
    assert spark.read.parquet(sink).select("epoch").distinct().count() == 3
    streamed = sorted(tuple(r) for r in ST.read_sink(spark, sink).select("qid", "rk", "id").collect())
    batch = sorted(tuple(r) for r in K.top_k(vc, TD.vector_queries(vc), 2, exclude_col="self_id")
                   .select("qid", "rk", "id").collect())
    assert streamed == batch
