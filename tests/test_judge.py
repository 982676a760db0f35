"""Judge stage: verdicts equal the native stand-in's, errors per record."""

import pytest

from ragloom.operators import judge as J
from ragloom.operators import standins as SI

RECORDS = [(1, "q one", "a b. c d!", "a b. x y", ["a b c", "z"]), (2, "q", "no.", "", []), (3, "q", ". " * 3, "r", None),
           (4, "q", "s. " * 11, "s", ["s"])]
SCHEMA = "qid int, question string, answer string, reference string, contexts array<string>"


def test_token_judge_equals_native_verdicts(spark):
    rec = spark.createDataFrame(RECORDS, SCHEMA)
    key = ["qid", "kind", "pos", "verdict"]
    a = sorted(map(tuple, J.judge_records(rec, J.TokenJudge()).select(key).collect()))
    assert a == sorted(map(tuple, J.stand_in_verdicts(rec).select(key).collect()))


@pytest.mark.parametrize("batch_size", [1, 4])
def test_a_failing_record_keeps_null_metrics(spark, batch_size):
    rec = spark.createDataFrame(RECORDS, SCHEMA).coalesce(1)
    out = {r.qid: r for r in J.judged_scores(rec, SI.StrictJudge(), batch_size=batch_size).collect()}
    assert len(out) == 4 and out[4].error == "too many statements"
    assert out[4].faithfulness is None and out[4].answer_similarity is None
    assert out[1].error is None and out[1].faithfulness == 0.5 or out[1].faithfulness is not None
    assert out[1].context_precision is not None


def test_a_short_reply_is_an_error(spark):
    rec = spark.createDataFrame(RECORDS, SCHEMA)
    got = J.judge_records(rec, lambda records: []).collect()
    assert len(got) == 4 and all("0 results" in r.error for r in got)
