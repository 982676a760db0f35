"""Runs compared by model (E09): a grid of k x model, with and without retrieval.

One retrieval at the largest k serves the whole grid. A :class:`Model` answers
the prompts of a run, either as a native expression or as a generator object
through the batch stage; its answers are written once before the metrics read
them. Every run is a ``run_id`` such as ``brief/k=3`` or ``brief/baseline``.

Two runs are compared question by question, and the uncertainty of the mean
difference comes from a paired bootstrap that is itself one aggregation: in
replicate ``b`` a question counts ``w(question, b)`` times, with ``w`` drawn from
a Poisson distribution of mean 1 by a hash (the large-sample form of drawing
questions with replacement). All runs see the same weights, so the replicates
are paired. A question's weights are drawn once for all runs and metrics; a task
multiplies its questions' weights and differences as matrices and sends runs x
metrics x replicates sums. The interval is the percentile of at most
``replicates`` values per run and metric.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import prompts as P
from ..functions import text as TX
from ..functions import vectors as V
from ..session import cut_lineage
from . import generate as G
from . import metrics as M
from . import runs as R

REPLICATES = 200
INTERVAL = (0.025, 0.975)
#: floor(2**32 * P(X <= i)) of a Poisson variable with mean 1, for i = 0 to 10.
POISSON_STEPS = tuple(int(2**32 * p) for p in accumulate(math.exp(-1) / math.factorial(i) for i in range(11)))


@dataclass(frozen=True)
class Model:
    """A named model: ``answer(contexts, question)`` columns, or a ``generator`` for the batch stage."""
    name: str
    answer: Callable[[Column, Column], Column] | None = None
    generator: object = None
    batch_size: int = 16


def _cited(contexts: Column) -> Column:
    return F.filter(F.transform(contexts, TX.longest_statement), lambda s: s != "")


def _or_refusal(contexts: Column, statements: Column) -> Column:
    return F.when(F.size(contexts) > 0, F.array_join(statements, G.ANSWER_SEPARATOR)).otherwise(F.lit(P.REFUSAL))


def _said(question: Column) -> Column:
    return F.coalesce(TX.statements(question), F.array().cast("array<string>"))


#: Stand-ins that differ in what they say: question and citations, citations only, the best citation only.
STAND_INS = (
    Model("full", lambda c, q: _or_refusal(c, F.concat(_said(q), _cited(c)))),
    Model("cited", lambda c, q: _or_refusal(c, _cited(c))),
    Model("brief", lambda c, q: _or_refusal(c, F.slice(_cited(c), 1, 1))),
)


def grid_records(questions: DataFrame, hits: DataFrame, models=STAND_INS, ks=R.SWEEP_KS, baseline: bool = True) -> DataFrame:
    """``(run_id, model, k, qid, question, reference, contexts, prompt, answer, error)`` of every run.

    ``k`` is 0 for runs without retrieval. Prompts are built once per k and
    handed to every model.
    """
    asked = R.sweep_prompts(questions, hits, ks).withColumn("k", F.regexp_extract("run_id", r"\d+", 0).cast("int"))
    if baseline:
        asked = asked.unionByName(R.baseline_prompts(questions).withColumns(
            {"run_id": F.lit("baseline"), "k": F.lit(0)}))
    asked = cut_lineage(asked.select("run_id", "k", "qid", "question", "reference", "contexts", "prompt"))
    parts = []
    for model in models:
        runs = asked.withColumns({"model": F.lit(model.name), "run_id": F.concat_ws("/", F.lit(model.name), "run_id")})
        if model.generator is None:
            part = runs.withColumns({"answer": model.answer(F.col("contexts"), F.col("question")),
                                     "error": F.lit(None).cast("string")})
        else:
            part = cut_lineage(G.generate(runs, "prompt", generator=model.generator, batch_size=model.batch_size))
        parts.append(part)
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def grid_scores(records: DataFrame, **kw) -> DataFrame:
    """The five metrics per ``(run_id, qid)``; answers that a model failed on have none."""
    scores = M.score_table(records, keys=("run_id", "qid"), **kw)
    if "error" not in records.columns:
        return scores
    failed = records.select("run_id", "qid", F.col("error").isNotNull().alias("_failed"))
    return scores.join(failed, ["run_id", "qid"]).select(
        *[F.when(~F.col("_failed"), F.col(c)).alias(c) if c in M.METRICS else F.col(c) for c in scores.columns])


def weights(key: Column, replicates: int) -> Column:
    """``array<int>``: how often a question counts in each replicate."""
    def steps(u):
        out = F.when(u < POISSON_STEPS[0], 0)
        for i, step in enumerate(POISSON_STEPS[1:], 1):
            out = out.when(u < step, i)
        return out.otherwise(len(POISSON_STEPS))

    def weight(b):
        u = F.conv(F.substring(F.md5(F.concat_ws(":", key.cast("string"), b.cast("string"))), 1, 8), 16, 10).cast("long")
        return V.let(u, steps)           # one hash per weight

    return F.transform(F.sequence(F.lit(0), F.lit(replicates - 1)), weight)


def _weighted_sums(batches):
    """Per run and metric of a task's questions: ``sum(w * d)`` and ``sum(w * n)`` of every replicate."""
    cells: dict[tuple[str, str], list[np.ndarray]] = {}
    for batch in batches:
        if not batch.num_rows:
            continue
        drawn, found = batch.column(0), batch.column(1)
        w = drawn.flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1).astype(np.float64)
        of = found.value_parent_indices().to_numpy()
        runs, metrics, n, d = found.flatten().flatten()
        n, d = (x.to_numpy(zero_copy_only=False).astype(np.float64) for x in (n, d))
        names = pa.table([runs, metrics, pa.array(np.arange(len(of)))], names=["run", "metric", "at"])
        for r in names.group_by(["run", "metric"]).aggregate([("at", "list")]).to_pylist():
            at = np.array(r["at_list"], dtype=np.int64)
            rows = w[of[at]]
            sums = cells.setdefault((r["run"], r["metric"]), [np.zeros(w.shape[1]), np.zeros(w.shape[1])])
            sums[0] += d[at] @ rows
            sums[1] += n[at] @ rows
    for (run, metric), (wd, wn) in cells.items():
        yield pa.RecordBatch.from_pydict({
            "run_id": pa.array([run] * len(wd), pa.string()), "metric": pa.array([metric] * len(wd), pa.string()),
            "replicate": pa.array(np.arange(len(wd), dtype=np.int32)), "wd": pa.array(wd), "wn": pa.array(wn)})


def paired_bootstrap(scores: DataFrame, base_run: str, metrics=M.METRICS, replicates: int = REPLICATES, key: str = "qid",
                     interval: tuple[float, float] = INTERVAL, decimals: int = 6) -> DataFrame:
    """``(run_id, metric, questions, mean_run, mean_base, delta, low, high)`` of every run against ``base_run``.

    A question takes part in a metric where both runs have a value. ``low`` and
    ``high`` are null where no question does.
    """
    scores = cut_lineage(scores.select("run_id", key, *metrics))        # read for the runs and for the base run
    long = scores.select("run_id", key, F.explode(F.array(*[
        F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("v")) for m in metrics])).alias("s")) \
        .select("run_id", key, "s.metric", "s.v").where(F.col("v").isNotNull() & ~F.isnan("v"))
    base = long.where(F.col("run_id") == base_run).select(key, "metric", F.col("v").alias("b"))
    # rows of one key (once each where the key is unique per run) weigh alike: their sums are enough
    pairs = cut_lineage(long.where(F.col("run_id") != base_run).join(base, [key, "metric"])
                        .groupBy(key, "run_id", "metric").agg(
                            F.count("*").alias("n"), F.sum("v").alias("v"), F.sum("b").alias("b"),
                            F.sum(F.col("v") - F.col("b")).alias("d")))
    means = pairs.groupBy("run_id", "metric").agg(
        F.sum("n").alias("questions"), (F.sum("v") / F.sum("n")).alias("mean_run"), (F.sum("b") / F.sum("n")).alias("mean_base"))
    drawn = pairs.groupBy(key).agg(F.collect_list(F.struct("run_id", "metric", "n", "d")).alias("cells")) \
        .select(weights(F.col(key), replicates).cast("array<tinyint>").alias("w"), "cells")
    sums = drawn.mapInArrow(_weighted_sums, "run_id string, metric string, replicate int, wd double, wn double")
    deltas = sums.groupBy("run_id", "metric", "replicate").agg(F.sum("wd").alias("wd"), F.sum("wn").alias("wn")) \
        .where("wn > 0").select("run_id", "metric", (F.col("wd") / F.col("wn")).alias("delta"))
    ends = deltas.groupBy("run_id", "metric").agg(F.percentile("delta", list(interval)).alias("ends"))

    def rd(c):
        return F.round(c, decimals) + F.lit(0.0)

    return means.join(ends, ["run_id", "metric"], "left").select(
        "run_id", "metric", "questions", rd(F.col("mean_run")).alias("mean_run"), rd(F.col("mean_base")).alias("mean_base"),
        rd(F.col("mean_run") - F.col("mean_base")).alias("delta"), rd(F.col("ends")[0]).alias("low"),
        rd(F.col("ends")[1]).alias("high"))
