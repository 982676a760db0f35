"""Evaluation run and answering many questions (3.2) as one plan.

questions -> embed -> top-k (leave-one-out optional) -> contexts -> prompt ->
answer -> records -> verdicts -> metrics. Every step is keyed by ``qid`` (and
``run_id`` for sweeps); the top-k merge hash-partitions by question once and
the later groupings and joins on the same key reuse it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import prompts as P
from ..operators import context as CX
from ..operators import embed as E
from ..operators import generate as G
from ..operators import metrics as M
from ..operators import topk as K
from ..session import cut_lineage

EVAL_K = 3


def retrieve(corpus: DataFrame, questions: DataFrame, k: int, *, exclude_col: str | None = None,
             embedder=None, dim: int = 64, **topk_kw) -> DataFrame:
    """Hits ``(qid, rk, id, score, input, output)``; questions are embedded unless they carry ``qvec``."""
    if "qvec" not in questions.columns:
        questions = E.embed(questions, "question", "qvec", embedder=embedder, dim=dim)
    return K.top_k(corpus, questions, k, exclude_col=exclude_col, payload=["input", "output"], **topk_kw)


def prompts(questions: DataFrame, hits: DataFrame, keys=("qid",)) -> DataFrame:
    """``(keys..., question, reference, contexts, prompt)``.

    Questions without any hit are kept with an empty context list (J03 left join).
    """
    keys = list(keys)
    ctx = hits.groupBy(*keys).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("rk", "output"))), lambda x: x["output"])
        .alias("contexts"))
    return (questions.select(*keys, "question", "reference").join(ctx, keys, "left")
            .withColumn("contexts", F.coalesce("contexts", F.array().cast("array<string>")))
            .withColumn("prompt", P.context_prompt(CX.join_contexts("contexts"), "question")))


def records(questions: DataFrame, hits: DataFrame, keys=("qid",), generator=None) -> DataFrame:
    """``(keys..., question, reference, contexts, prompt, answer)``."""
    rec = prompts(questions, hits, keys)
    if generator is None:
        return rec.withColumn("answer", G.stand_in_answer("contexts"))
    # several metrics read the answers: a model is asked once
    return cut_lineage(G.generate(rec, "prompt", generator=generator).drop("error"))


def evaluate(corpus: DataFrame, questions: DataFrame, k: int = EVAL_K, *,
             exclude_col: str | None = None, embedder=None, generator=None, dim: int = 64,
             **topk_kw) -> DataFrame:
    """The whole run: score table with the five metrics per question."""
    hits = retrieve(corpus, questions, k, exclude_col=exclude_col, embedder=embedder, dim=dim, **topk_kw)
    rec = records(questions, hits, generator=generator)
    return M.score_table(rec, embedder=embedder, dim=dim)
