"""The corpus pipeline: stage contracts and its result against brute force on the stages that have one."""

import collections

import corpus_pipeline as C
from brute import jaccard_components, without_repeats
from conftest import SF_SMALL
from ragloom.llm import op7_language as L
from ragloom.llm.common import materialize
from ragloom.llm.op9_packing import pack_documents


def test_stage_names_and_order():
    assert [n for n, _ in C.STAGES] == ["language", "near_duplicates", "repeated_passages", "secrets", "packing"]


def test_pipeline_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    d = docs
    kept = {}
    for name, stage in C.STAGES[:-1]:
        d = materialize(stage(spark, d, SF_SMALL), name)
        assert d.columns == docs.columns and d.dtypes == docs.dtypes
        kept[name] = {r["doc_id"]: r["text"] for r in d.collect()}
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    judged = {r["doc_id"]: r for r in L.op7_language(spark, SF_SMALL).collect()}
    assert kept["language"] == {k: t for k, t in texts.items()
                                if judged[k]["lang_pred"] != "und" and judged[k]["score"] >= L.MIN_SCORE}
    comps = jaccard_components(list(kept["language"].items()))
    assert kept["near_duplicates"] == {k: t for k, t in kept["language"].items() if comps[k][1] == k}
    cut = without_repeats(list(kept["near_duplicates"].items()))
    want = {k: v[0].decode("utf-8", "ignore") for k, v in cut.items()}
    assert kept["repeated_passages"] == {k: t for k, t in want.items() if t or not cut[k][1]}
    for k, t in kept["secrets"].items():
        assert t == kept["repeated_passages"][k] or "[SECRET]" in t
    rows = C.run(spark, SF_SMALL).collect()
    last = pack_documents(d, spark).collect()
    key = ("doc_id", "piece", "start", "length", "ids_crc32")
    assert sorted(tuple(r[k] for k in key) for r in rows) == sorted(tuple(r[k] for k in key) for r in last)
    used = collections.Counter()
    for r in rows:
        used[r["sequence_id"]] += r["length"]
    assert max(used.values()) <= 4096
