"""End-to-end plans: routed answering with a real (callable) generator, evaluation run."""

from pyspark.sql import functions as F

import __spark_entry__ as SE
from conftest import SF_SMALL
from ragloom.functions import prompts as P
from ragloom.plans import answer as PA
from ragloom.plans import evaluation as EV


def _echo():
    class Echo:
        """Answers with the prompt length; fails on prompts holding a marker."""

        def __call__(self, prompts):
            if any("FAIL" in p for p in prompts):
                raise RuntimeError("model unavailable")
            return [f"len={len(p)}" for p in prompts]
    return Echo()


def test_routed_answer_with_generator(spark):
    corpus, q = SE._qa(spark, SF_SMALL)
    given = SE._given_docs(corpus)
    out = PA.answer(corpus, q, given, generator=_echo(), exclude_col="self_id").collect()
    assert len(out) == q.count()
    n_given = given.select("qid").distinct().count()
    assert sum(r.source == "given" for r in out) == n_given
    for r in out:
        assert r.error is None and r.answer == f"len={len(r.prompt)}"
        if r.source == "given":
            assert "참고 문서:\nDocument 1:" in r.prompt
        else:
            assert r.prompt.startswith(P.template_parts(P.CHAIN_TEMPLATE)[0][1])


def test_generation_errors_are_values(spark):
    df = spark.createDataFrame([(1, "ok"), (2, "FAIL here")], "qid int, prompt string")
    from ragloom.operators import generate as G
    got = {r.qid: (r.answer, r.error) for r in G.generate(df, generator=_echo(), batch_size=1).collect()}
    assert got[1] == ("len=2", None)
    assert got[2] == (P.ERROR_PREFIX + "model unavailable", "model unavailable")


def test_evaluate_keeps_every_question(spark):
    corpus, q = SE._qa(spark, SF_SMALL)
    scores = EV.evaluate(corpus, q.drop("qvec"), 3, exclude_col="self_id")
    assert scores.count() == q.count()
    assert scores.where(F.col("context_precision").isNull()).count() == 0
