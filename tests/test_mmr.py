"""MMR: against a brute-force greedy selection and the lambda = 1 property."""

import numpy as np
import pytest

from conftest import SF_SMALL
from ragloom.operators import mmr as MMR
from ragloom.operators import topk as K
from ragloom.sources import testdata as TD


def _cos(a, b):
    return float(a @ b / np.sqrt((a @ a) * (b @ b)))


def _brute_mmr(vecs, qid, k, fetch_k, lam):
    q = vecs[qid]
    cand = sorted(((cid, _cos(v, q)) for cid, v in vecs.items() if cid != qid), key=lambda t: (-t[1], t[0]))
    cand = cand[:fetch_k]
    chosen = [0]
    while len(chosen) < min(k, len(cand)):
        best, best_s = None, None
        for i, (cid, rel) in enumerate(cand):
            if i in chosen:
                continue
            red = max(_cos(vecs[cid], vecs[cand[j][0]]) for j in chosen)
            s = round(lam * rel - (1 - lam) * red, 9)
            if best_s is None or s > best_s:
                best, best_s = i, s
        chosen.append(best)
    return [cand[i][0] for i in chosen]


def test_mmr_matches_brute_force(spark):
    vc = TD.vector_corpus(spark, SF_SMALL)
    vecs = {r.id: np.asarray(r.embedding, dtype=np.float64) for r in vc.collect()}
    got = {}
    for r in MMR.mmr(vc, TD.vector_queries(vc), exclude_col="self_id").collect():
        got.setdefault(r.qid, []).append((r.pos, r.id))
    assert len(got) == len(vecs)
    for qid in list(vecs)[:40]:
        picks = [i for _, i in sorted(got[qid])]
        assert picks == _brute_mmr(vecs, qid, 4, 20, 0.5)


def test_lambda_one_equals_top_k(spark):
    vc = TD.vector_corpus(spark, SF_SMALL)
    q = TD.vector_queries(vc)
    m = {(r.qid, r.pos): r.id for r in MMR.mmr(vc, q, k=4, fetch_k=20, lam=1.0, exclude_col="self_id").collect()}
    t = {(r.qid, r.rk): r.id for r in K.top_k(vc, q, 4, exclude_col="self_id").collect()}
    assert m == t


def test_mmr_differs_from_top_k(spark):
    vc = TD.vector_corpus(spark, SF_SMALL)
    q = TD.vector_queries(vc)
    m = {(r.qid, r.pos): r.id for r in MMR.mmr(vc, q, exclude_col="self_id").collect()}
    t = {(r.qid, r.rk): r.id for r in K.top_k(vc, q, 4, exclude_col="self_id").collect()}
    assert sum(m[x] != t[x] for x in t) > len(t) // 4


def test_bad_parameters(spark):
    vc = TD.vector_corpus(spark, SF_SMALL)
    with pytest.raises(ValueError):
        MMR.mmr(vc, TD.vector_queries(vc), k=5, fetch_k=4)


def test_greedy_handles_null_relevance():
    rel = np.array([0.9, np.nan, 0.5])
    gram = np.array([[1, np.nan, 0.2], [np.nan, np.nan, np.nan], [0.2, np.nan, 1]])
    assert MMR.greedy_mmr(rel, gram, 3, 0.5) == [0, 2, 1]


def test_mmr_late_payload_same_picks(spark):
    vc = TD.vector_corpus(spark, SF_SMALL)
    q = TD.vector_queries(vc)
    a = MMR.mmr(vc, q, exclude_col="self_id", late_payload=False).select("qid", "pos", "id").collect()
    b = MMR.mmr(vc, q, exclude_col="self_id", late_payload=True).select("qid", "pos", "id").collect()
    assert sorted(map(tuple, a)) == sorted(map(tuple, b))


def test_questions_share_calls_and_may_cross_batches(spark, capsys):
    vc = TD.vector_corpus(spark, SF_SMALL)
    m = MMR.mmr(vc, TD.vector_queries(vc), exclude_col="self_id")
    want = sorted(m.collect())
    m.explain()
    assert "FlatMapGroupsInArrow" not in capsys.readouterr().out       # a call per question
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    old = spark.conf.get(key)
    spark.conf.set(key, "7")
    try:
        assert sorted(MMR.mmr(vc, TD.vector_queries(vc), exclude_col="self_id").collect()) == want
    finally:
        spark.conf.set(key, old)
