"""Answering many questions as one plan.

A question that comes with its own documents is answered from them (numbered
document blocks, system + user message). Every other question retrieves its
contexts by MMR (fetch 20, keep 4) and gets the lawyer prompt with those
contexts. Both branches end in one generation stage. All joins are on
``qid``; MMR groups hold at most ``fetch_k`` rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import prompts as P
from ..operators import context as CX
from ..operators import generate as G
from ..operators import mmr as MMR

CONTEXT_JOIN = "\n\n"


def routed_prompts(corpus: DataFrame, questions: DataFrame, given: DataFrame | None = None, *,
                   k: int = MMR.MMR_K, fetch_k: int = MMR.MMR_FETCH_K, exclude_col: str | None = None,
                   **topk_kw) -> DataFrame:
    """``(qid, source, first_context, prompt)``; ``source`` is ``given`` or ``retrieved``.

    ``given``: ``(qid, rk, input, output)`` documents handed in with a question.
    ``corpus`` needs ``id, embedding, input, output``; ``questions`` need
    ``qid, question, qvec``. Retrieved documents contribute their ``input``
    text (the stored page content); their ``output`` is the answer material.
    """
    # only questions without their own documents retrieve
    need = questions if given is None else questions.join(given.select("qid").distinct(), "qid", "left_anti")
    picks = MMR.mmr(corpus, need, k, fetch_k, exclude_col=exclude_col,
                    payload=["input", "output"], **topk_kw)
    retrieved = picks.groupBy("qid").agg(
        F.array_sort(F.collect_list(F.struct("pos", "input", "output"))).alias("_r"))
    q = questions.select("qid", "question").join(retrieved, "qid", "left")
    if given is not None:
        docs = CX.numbered_documents(given).withColumnRenamed("documents", "_g")
        first = given.groupBy("qid").agg(F.min_by("output", "rk").alias("_gfirst"))
        q = q.join(docs, "qid", "left").join(first, "qid", "left")
    else:
        q = q.withColumn("_g", F.lit(None).cast("string")).withColumn("_gfirst", F.lit(None).cast("string"))
    use_given = F.coalesce(F.length("_g") > 0, F.lit(False))
    ret_text = F.array_join(F.transform(F.coalesce("_r", F.array()), lambda x: x["input"]), CONTEXT_JOIN)
    messages = P.chat_messages(F.col("_g"), "question")
    return q.select(
        "qid",
        F.when(use_given, F.lit("given")).otherwise(F.lit("retrieved")).alias("source"),
        F.when(use_given, F.col("_gfirst")).otherwise(F.element_at("_r", 1)["output"]).alias("first_context"),
        F.when(use_given, messages[1]["content"])
         .otherwise(P.chain_prompt(ret_text, "question")).alias("prompt"))


def answer(corpus: DataFrame, questions: DataFrame, given: DataFrame | None = None, *,
           generator=None, **kw) -> DataFrame:
    """``(qid, source, prompt, answer, error)``: one answer per question.

    The stand-in generator (``generator=None``) answers with the first context
    of the chosen branch, or the refusal sentence when there is none.
    """
    p = routed_prompts(corpus, questions, given, **kw)
    if generator is None:
        return p.select("qid", "source", "prompt",
                        F.coalesce("first_context", F.lit(P.REFUSAL)).alias("answer"),
                        F.lit(None).cast("string").alias("error"))
    return G.generate(p.drop("first_context"), "prompt", generator=generator)
