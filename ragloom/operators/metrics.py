"""Answer-quality metrics as DataFrame aggregations.

* ``context_precision`` = sum_k(precision@k * v_k) / sum_k(v_k) over ranked
  contexts, 0 when none is relevant, null when there is no context
* ``context_recall``    = supported reference statements / reference statements
* ``faithfulness``      = supported answer statements / answer statements;
  null when the answer has no statement
* ``answer_relevancy``  = mean cosine(question, generated question), 0 for a
  non-committal (refusal) answer
* ``answer_similarity`` = cosine(embedding(answer), embedding(reference))

The three verdict metrics come out of one ``groupBy`` over the verdict table.
A record whose judge call failed (``errors``) keeps null metrics; the rest of
the run is scored (E08).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import cached_column
from ..functions import prompts as P
from ..functions import text as TX
from ..functions import vectors as V
from . import embed as E
from . import judge as J


def verdict_metrics(verdicts: DataFrame, keys=("qid",)) -> DataFrame:
    """E03, E04, E05 from verdicts ``(keys..., kind, pos, verdict)`` in one aggregation."""
    keys = list(keys)
    is_p = F.col("kind") == J.KIND_PRECISION
    w = Window.partitionBy(*keys, "kind").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    prec_term = F.when(is_p, F.sum("verdict").over(w) / F.col("pos") * F.col("verdict"))
    v = verdicts.withColumn("_pk", prec_term)
    n_rel = F.sum(F.when(is_p, F.col("verdict")))
    return v.groupBy(*keys).agg(
        F.when(F.count(F.when(is_p, 1)) > 0,
               F.coalesce(F.try_divide(F.sum("_pk"), n_rel.cast("double")), F.lit(0.0)))
         .alias("context_precision"),
        F.avg(F.when(F.col("kind") == J.KIND_RECALL, F.col("verdict"))).alias("context_recall"),
        F.avg(F.when(F.col("kind") == J.KIND_FAITHFULNESS, F.col("verdict"))).alias("faithfulness"))


def answer_relevancy(records: DataFrame, keys=("qid",), question: str = "question",
                     answer: str = "answer", embedder=None, dim: int = 64) -> DataFrame:
    """``(keys..., answer_relevancy)``; null when the answer has no statement."""
    keys = list(keys)
    gen = J.generated_questions(records, keys, answer)
    gen = E.embed(gen, "gen", "_gv", embedder=embedder, dim=dim)
    q = E.embed(records.select(*keys, question, answer), question, "_qv", embedder=embedder, dim=dim)
    q = q.select(*keys, "_qv", P.refusal_flag(answer).alias("_refusal"))
    sims = gen.join(q, keys).select(*keys, "_refusal", V.cosine_similarity("_qv", "_gv").alias("_s"))
    return sims.groupBy(*keys).agg(
        F.when(F.bool_or("_refusal"), F.lit(0.0)).otherwise(F.avg("_s")).alias("answer_relevancy"))


def answer_similarity(records: DataFrame, keys=("qid",), answer: str = "answer",
                      reference: str = "reference", embedder=None, dim: int = 64) -> DataFrame:
    """``(keys..., answer_similarity)`` - a row-wise cosine, no shuffle."""
    keys = list(keys)
    df = E.embed(records.select(*keys, answer, reference), answer, "_av", embedder=embedder, dim=dim)
    df = E.embed(df, reference, "_rv", embedder=embedder, dim=dim)
    return df.select(*keys, V.cosine_similarity("_av", "_rv").alias("answer_similarity"))


METRICS = ("context_precision", "context_recall", "faithfulness", "answer_relevancy",
           "answer_similarity")


def _mean(xs: F.Column) -> F.Column:
    """Mean of a numeric array; null when empty. The array is read twice and so bound, as it may be costly."""
    return V.let(xs, lambda v: F.try_divide(F.aggregate(v, F.lit(0.0), lambda a, x: a + x), F.size(v).cast("double")))


def _coverage_verdicts(text, ct, tau):
    """Verdicts of a text's statements against the context tokens ``ct``.

    Each statement probes the text's own tokens that are among ``ct``, not all of ``ct``.
    """
    def verdicts(said, known):
        return F.transform(said, lambda p: F.when(F.try_divide(
            F.size(F.array_intersect(known, p)).cast("double"), F.size(p).cast("double")) >= F.lit(tau), 1.0)
            .otherwise(0.0))

    return V.let(F.transform(TX.statements(text), lambda s: TX.distinct_tokens(s)), lambda said: V.let(
        F.array_intersect(F.flatten(said), ct), lambda known: verdicts(said, known)))


def _precision(verdicts):
    def body(v):
        terms = F.zip_with(v, F.sequence(F.lit(1), F.greatest(F.size(v), F.lit(1))),
                           lambda x, i: x * F.aggregate(F.slice(v, 1, i), F.lit(0.0), lambda a, y: a + y) / i)
        n_rel = F.aggregate(v, F.lit(0.0), lambda a, y: a + y)
        return F.when(F.size(v) > 0, F.when(n_rel > 0, F.aggregate(terms, F.lit(0.0), lambda a, y: a + y)
                                            / n_rel).otherwise(F.lit(0.0)))

    return V.let(verdicts, body)          # the verdicts are read for every rank


@cached_column
def context_metric_struct(tau: float = J.TAU, answer: str = "answer", reference: str = "reference",
                          contexts: str = "contexts", relevance_tau: float = J.RELEVANCE_TAU) -> F.Column:
    """E03-E05 of the stand-in judge as one row-local struct (every text tokenised once).

    Select it as one column and extract the fields in a later projection: three
    field accesses on the expression itself would evaluate it three times.
    """
    let = V.let
    ctx = F.coalesce(F.col(contexts), F.array().cast("array<string>"))

    def body(ctoks, ct, rt):
        # relevance of each context: share of the reference's distinct tokens it holds
        v = F.transform(ctoks, lambda c: F.when(F.coalesce(
            TX.token_coverage(rt, c) >= F.lit(relevance_tau), F.lit(False)), 1.0).otherwise(0.0))
        return F.struct(_precision(v).alias("context_precision"),
                        _mean(_coverage_verdicts(reference, ct, tau)).alias("context_recall"),
                        _mean(_coverage_verdicts(answer, ct, tau)).alias("faithfulness"))

    return let(F.transform(ctx, lambda c: TX.distinct_tokens(c)), lambda ctoks: let(
        F.array_distinct(F.flatten(ctoks)), lambda ct: let(
            TX.distinct_tokens(reference), lambda rt: body(ctoks, ct, rt))))


@cached_column
def answer_metric_columns(dim: int = 64, answer: str = "answer", reference: str = "reference",
                          question: str = "question") -> list[F.Column]:
    """E06 and E02 with the stand-in embedder as row-local columns."""
    let = V.let

    def to_question(qv, qn):
        # as V.cosine_similarity, with the question's squared norm taken once and not per statement
        return lambda g: let(V.as_double(TX.hash_embedding(g, dim)), lambda gv: V.clamp_unit(
            F.try_divide(V.dot(qv, gv), F.sqrt(qn * V.sq_norm(gv)))))

    def body(gen):
        rel = let(V.as_double(TX.hash_embedding(question, dim)), lambda qv: let(V.sq_norm(qv), lambda qn: _mean(
            F.transform(gen, to_question(qv, qn)))))
        return F.when(F.size(gen) == 0, F.lit(None).cast("double")) \
            .when(P.refusal_flag(answer), F.lit(0.0)).otherwise(rel)

    sim = V.cosine_similarity(TX.hash_embedding(answer, dim), TX.hash_embedding(reference, dim))
    return [let(TX.statements(answer), body).alias("answer_relevancy"), sim.alias("answer_similarity")]


def stand_in_scores(records: DataFrame, dim: int = 64, keys=("qid",),
                    dedupe_answers: bool = False) -> DataFrame:
    """The five metrics of the stand-in judge and embedder, row-local.

    Same definitions as ``stand_in_verdicts`` + ``verdict_metrics`` +
    ``answer_relevancy`` + ``answer_similarity`` (a test keeps them equal), but
    every judgement stays inside its record: no explode, no shuffle. The
    verdict-table path is the one to use with a real judge model.

    ``dedupe_answers``: the answer metrics depend only on (question, answer,
    reference); when many records share them (a k-sweep), compute them once
    per distinct ``(qid, answer)`` and join back.
    """
    names = ["context_precision", "context_recall", "faithfulness"]
    base = records.select("*", context_metric_struct().alias("_cm")) \
        .select(*records.columns, *[F.col(f"_cm.{n}").alias(n) for n in names])
    if not dedupe_answers:
        return base.select("*", *answer_metric_columns(dim))
    per_answer = (records.select("qid", "question", "answer", "reference")
                  .dropDuplicates(["qid", "answer"])
                  .select("qid", "answer", *answer_metric_columns(dim)))
    return base.join(per_answer, ["qid", "answer"], "left")


def score_table(records: DataFrame, keys=("qid",), verdicts: DataFrame | None = None,
                errors: DataFrame | None = None, embedder=None, dim: int = 64,
                dedupe_answers: bool | None = None) -> DataFrame:
    """Records plus one column per metric (left joins: nothing is dropped).

    Without given verdicts or embedder, the stand-in judge runs row-locally
    (``stand_in_scores``); otherwise the verdict table is aggregated and the
    embedder applied as separate stages joined back on the keys.
    ``dedupe_answers`` (see ``stand_in_scores``) is by default on for records of several runs.
    """
    keys = list(keys)
    if verdicts is None and embedder is None:
        dedupe = len(keys) > 1 if dedupe_answers is None else dedupe_answers
        out = stand_in_scores(records, dim, keys, dedupe_answers=dedupe)
    else:
        verdicts = verdicts if verdicts is not None else J.stand_in_verdicts(records, keys)
        out = (records.join(verdict_metrics(verdicts, keys), keys, "left")
               .join(answer_relevancy(records, keys, embedder=embedder, dim=dim), keys, "left")
               .join(answer_similarity(records, keys, embedder=embedder, dim=dim), keys, "left"))
    if errors is not None:
        failed = errors.select(*keys, F.lit(True).alias("_failed")).distinct()
        out = out.join(failed, keys, "left")
        out = out.select(*[c for c in out.columns if c not in METRICS and c != "_failed"],
                         *[F.when(F.col("_failed").isNull(), F.col(m)).alias(m) for m in METRICS])
    return out


def rounded(df: DataFrame, decimals: int = 3, metrics=METRICS) -> DataFrame:
    """Metric columns rounded for display (``display.precision = 3``)."""
    return df.select(*[F.round(c, decimals).alias(c) if c in metrics else F.col(c) for c in df.columns])
