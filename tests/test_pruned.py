"""Pruned search: the rows of the plain top-k, fewer pairs scored."""

import numpy as np
import pytest

from conftest import SF_SMALL
from ragloom.operators import pruned as PR
from ragloom.operators import topk as K
from ragloom.sources import testdata as TD


def _rows(df, extra=()):
    return sorted((r.qid, r.rk, r.id, None if r.score is None else round(r.score, 9), *(r[x] for x in extra))
                  for r in df.collect())


def _clustered(spark, n=3000, groups=40, dim=24, seed=1):
    rng = np.random.default_rng(seed)
    centre = rng.normal(size=(groups, dim))
    v = centre[rng.integers(0, groups, n)] + 0.15 * rng.normal(size=(n, dim))
    corpus = spark.createDataFrame([(i, x.tolist(), f"t{i}") for i, x in enumerate(v)], "id long, embedding array<double>, t string")
    q = [(i, (centre[i % groups] + 0.15 * rng.normal(size=dim)).tolist(), i) for i in range(60)]
    return corpus, spark.createDataFrame(q, "qid long, qvec array<double>, self_id long")


def test_same_rows_as_the_plain_search_and_most_pairs_skipped(spark):
    corpus, q = _clustered(spark)
    index = PR.build_index(corpus)
    want = _rows(K.top_k(corpus, q, 5, exclude_col="self_id", payload=["t"]), ["t"])
    assert _rows(PR.search(index, q, 5, exclude_col="self_id", payload=["t"]), ["t"]) == want
    report, = index.report
    print(report)
    assert report["share_skipped"] > 0.5 and report["folders_second"] < report["folders"]
    again = PR.load_index(spark, index.path)
    assert again.folders == index.folders
    assert _rows(PR.search(again, q, 5, exclude_col="self_id", payload=["t"], max_rows=25), ["t"]) == want
    assert len(again.report) > 1


def test_given_vectors(spark):
    vc = TD.vector_corpus(spark, SF_SMALL)
    q = TD.vector_queries(vc)
    index = PR.build_index(vc)
    assert _rows(PR.search(index, q, 5, exclude_col="self_id")) == _rows(K.top_k(vc, q, 5, exclude_col="self_id"))


def test_vectors_without_direction_ties_and_few_rows(spark):
    corpus = spark.createDataFrame(
        [(i, [1.0, 0.0]) for i in range(6)] + [(10, [0.0, 0.0]), (11, None), (12, [0.0, 1.0]), (13, [-1.0, 0.0]), (14, [0.0, 0.0])],
        "id long, embedding array<double>")
    q = spark.createDataFrame([(1, [1.0, 0.1]), (2, [0.0, 0.0]), (3, None), (4, [0.0, -1.0])], "qid long, qvec array<double>")
    for k in (1, 3, 9, 20):
        want = _rows(K.top_k(corpus, q, k))
        assert _rows(PR.search(PR.build_index(corpus, n_directions=3), q, k)) == want
    empty = PR.build_index(corpus.limit(0))
    assert PR.search(empty, q, 3).count() == 0
    assert PR.search(PR.build_index(corpus), q.limit(0), 3).count() == 0
    only_zero = corpus.where("id in (10, 14)")
    assert _rows(PR.search(PR.build_index(only_zero), q, 3)) == _rows(K.top_k(only_zero, q, 3))
    with pytest.raises(ValueError):
        PR.search(empty, q, 0)


def test_bound_holds():
    rng = np.random.default_rng(4)
    centre, _ = PR._units(rng.normal(size=(1, 8)))
    rows, _ = PR._units(centre + 0.5 * rng.normal(size=(400, 8)))
    qs, _ = PR._units(rng.normal(size=(50, 8)))
    angle = np.arccos(np.clip(rows @ centre[0], -1, 1))
    best = (qs @ rows.T).max(axis=1)
    assert (PR.highest_score(np.arccos(qs @ centre[0]), angle.min(), angle.max()) >= best - 1e-9).all()
