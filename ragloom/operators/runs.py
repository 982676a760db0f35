"""Runs under different settings, compared.

The reference runs one script per setting (k = 1, 3, 4; three models; RAG
against no RAG) and writes one file each. Here a run is a ``run_id`` column:

* a k-sweep is one retrieval at the largest k, replicated once per run by
  exploding a literal list of ks and filtered by ``rk <= k`` - the corpus is
  scanned once for all runs;
* runs are summarised by one ``groupBy(run_id)``;
* two runs are compared question by question with an equi-join on the key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import prompts as P
from ..plans import evaluation as EV
from ..session import cut_lineage
from . import metrics as M

# The k of the reference's evaluation scripts, plus the numpy search default
SWEEP_KS = (1, 3, 4, 5)


def _sweep(questions: DataFrame, hits: DataFrame, ks) -> tuple[DataFrame, DataFrame]:
    """Questions and hits once per run of the sweep."""
    hits = cut_lineage(hits)              # read once per run's contexts and once per answer
    runs = F.explode(F.array(*[F.lit(int(k)) for k in ks]))
    h = hits.select("*", runs.alias("_k")).where(F.col("rk") <= F.col("_k"))
    h = h.withColumn("run_id", F.concat(F.lit("k="), F.col("_k").cast("string"))).drop("_k")
    q = questions.select("*", F.explode(F.array(*[F.lit(f"k={int(k)}") for k in ks])).alias("run_id"))
    return q, h


def sweep_records(questions: DataFrame, hits: DataFrame, ks=SWEEP_KS) -> DataFrame:
    """Records per ``(run_id, qid)`` for every k, from hits retrieved once at ``max(ks)``."""
    return EV.records(*_sweep(questions, hits, ks), keys=("run_id", "qid"))


def sweep_prompts(questions: DataFrame, hits: DataFrame, ks=SWEEP_KS) -> DataFrame:
    """Contexts and prompts per ``(run_id, qid)`` for every k, without answers."""
    return EV.prompts(*_sweep(questions, hits, ks), keys=("run_id", "qid"))


def sweep_scores(questions: DataFrame, hits: DataFrame, ks=SWEEP_KS, **kw) -> DataFrame:
    # every context adds its statement to the answer, so the runs of a question hardly share one: looking for
    # equal answers would compute and shuffle all records twice
    return M.score_table(sweep_records(questions, hits, ks), keys=("run_id", "qid"), **{"dedupe_answers": False, **kw})


def run_summary(scores: DataFrame, decimals: int = 6) -> DataFrame:
    """Per run, the mean of every metric (nulls skipped), the refusal rate and the count."""
    return scores.groupBy("run_id").agg(
        F.count(F.lit(1)).cast("long").alias("questions"),
        *[(F.round(F.avg(m), decimals) + F.lit(0.0)).alias(m) for m in M.METRICS],
        (F.round(F.avg(P.refusal_flag("answer").cast("double")), decimals) + F.lit(0.0))
        .alias("refusal_rate"))


def baseline_prompts(questions: DataFrame) -> DataFrame:
    """Prompts without any context."""
    return questions.select("qid", "question", "reference") \
        .withColumn("contexts", F.array().cast("array<string>")) \
        .withColumn("prompt", P.baseline_prompt("question"))


def baseline_records(questions: DataFrame, generator=None) -> DataFrame:
    """Answers without any context (the no-RAG run)."""
    rec = baseline_prompts(questions)
    if generator is None:
        # the stand-in has nothing to answer from without context: it refuses
        return rec.withColumn("answer", F.lit(P.REFUSAL))
    from . import generate as G
    return G.generate(rec, "prompt", generator=generator).drop("error")


def compare(scores_a: DataFrame, scores_b: DataFrame, metric: str = "answer_similarity",
            key: str = "qid", decimals: int = 6) -> DataFrame:
    """Two runs side by side per question with the difference of one metric.

    The key must be unique per run (``qid``); joining on question text would
    multiply rows for a repeated question.
    """
    a = scores_a.select(key, F.col(metric).alias("a"))
    b = scores_b.select(key, F.col(metric).alias("b"))

    def rd(c):
        return F.round(c, decimals) + F.lit(0.0)

    return a.join(b, key, "full").select(
        key, rd(F.col("a")).alias(f"{metric}_a"), rd(F.col("b")).alias(f"{metric}_b"),
        rd(F.col("a") - F.col("b")).alias("delta"))
