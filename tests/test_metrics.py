"""Verdict aggregation and metric edge cases (FIXTURES 3)."""

import pytest

from ragloom.functions import prompts as P
from ragloom.operators import judge as J
from ragloom.operators import metrics as M


def _verdicts(spark, rows):
    return spark.createDataFrame(rows, "qid int, kind string, pos int, verdict int")


@pytest.mark.parametrize("vs,expected", [([0, 0, 0], 0.0), ([1, 1, 1], 1.0), ([1, 0, 1], (1 + 2 / 3) / 2)])
def test_context_precision(spark, vs, expected):
    v = _verdicts(spark, [(1, J.KIND_PRECISION, i + 1, x) for i, x in enumerate(vs)])
    got = M.verdict_metrics(v).first().context_precision
    assert got == pytest.approx(expected)


def test_recall_and_faithfulness_are_means(spark):
    v = _verdicts(spark, [(1, J.KIND_RECALL, 1, 1), (1, J.KIND_RECALL, 2, 0),
                          (1, J.KIND_FAITHFULNESS, 1, 1), (1, J.KIND_FAITHFULNESS, 2, 1),
                          (1, J.KIND_FAITHFULNESS, 3, 0)])
    r = M.verdict_metrics(v).first()
    assert r.context_recall == 0.5 and r.faithfulness == pytest.approx(2 / 3)
    assert r.context_precision is None          # no context -> undefined


def _records(spark, rows):
    return spark.createDataFrame(rows, "qid int, question string, answer string, contexts array<string>, "
                                       "reference string")


def test_score_table_edge_cases(spark):
    rec = _records(spark, [
        (1, "what is alpha beta", "alpha beta gamma. delta", ["alpha beta gamma delta"], "alpha beta gamma"),
        (2, "anything", "...", ["unrelated words"], "alpha beta"),
        (3, "a question", P.REFUSAL, [], "alpha"),
    ])
    got = {r.qid: r for r in M.score_table(rec).collect()}
    assert got[1].faithfulness == 1.0 and got[1].context_recall == 1.0 and got[1].context_precision == 1.0
    assert got[1].answer_similarity > 0.5
    assert got[2].faithfulness is None                      # answer without any statement
    assert got[2].answer_relevancy is None
    assert got[2].context_precision == 0.0                  # no relevant context
    assert got[3].answer_relevancy == 0.0                   # non-committal answer
    assert got[3].context_precision is None and got[3].context_recall == 0.0


def test_failed_judge_rows_keep_null_metrics(spark):
    rec = _records(spark, [(1, "q", "alpha beta", ["alpha beta"], "alpha beta"),
                           (2, "q", "alpha beta", ["alpha beta"], "alpha beta")])
    errors = spark.createDataFrame([(2, "timeout")], "qid int, error string")
    got = {r.qid: r for r in M.score_table(rec, errors=errors).collect()}
    assert got[1].faithfulness == 1.0
    assert all(getattr(got[2], m) is None for m in M.METRICS)


def test_verdict_table_shape(spark):
    rec = _records(spark, [(1, "q", "a b. c d! e", ["a b c"], "a b. zz")])
    v = {(r.kind, r.pos): r.verdict for r in J.stand_in_verdicts(rec).collect()}
    assert v == {(J.KIND_FAITHFULNESS, 1): 1, (J.KIND_FAITHFULNESS, 2): 1, (J.KIND_FAITHFULNESS, 3): 0,
                 (J.KIND_RECALL, 1): 1, (J.KIND_RECALL, 2): 0, (J.KIND_PRECISION, 1): 1}


def test_fused_stand_in_equals_verdict_path(spark):
    import __spark_entry__ as SE
    from conftest import SF_MID
    rec = SE._records(spark, SF_MID)
    fused = {r.qid: r for r in M.stand_in_scores(rec).collect()}
    staged = {r.qid: r for r in M.score_table(rec, verdicts=J.stand_in_verdicts(rec)).collect()}
    assert fused.keys() == staged.keys() and len(fused) > 200
    for q in fused:
        for m in M.METRICS:
            a, b = getattr(fused[q], m), getattr(staged[q], m)
            assert (a is None and b is None) or abs(a - b) < 1e-9, (q, m, a, b)


def test_verdict_arrays_are_computed_once(spark):
    """an array that a mean or a precision reads several times is bound, not computed for every reading."""
    from pyspark.sql import functions as F
    for metric in (M._mean, M._precision):
        assert str(metric(F.transform("xs", lambda x: F.sqrt(x)))).lower().count("sqrt") == 1


def test_sweep_computes_its_records_once(spark):
    """the k-sweep groups its hits into contexts once, and its scores are those of each record alone."""
    from conftest import plan_text
    from ragloom.operators import runs as R
    q = spark.createDataFrame([("a", "One. Two?", "x y. z"), ("b", None, None), ("c", "x", "x")],
                              "qid string, question string, reference string")
    hits = spark.createDataFrame([("a", 1, "x y z. one"), ("a", 2, None), ("a", 3, "two. x"), ("b", 1, "...")],
                                 "qid string, rk int, output string")
    got = R.sweep_scores(q, hits, ks=(1, 3))
    assert plan_text(got).count("collect_list") == plan_text(R.sweep_records(q, hits, ks=(1, 3))).count("collect_list")
    cols = ["run_id", "qid", "answer", *M.METRICS]
    want = M.score_table(R.sweep_records(q, hits, ks=(1, 3)), keys=("run_id", "qid"), dedupe_answers=True)
    assert sorted(map(str, got.select(cols).collect())) == sorted(map(str, want.select(cols).collect()))
    assert got.count() == 6
