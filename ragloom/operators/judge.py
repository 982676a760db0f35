"""Judge stage: evaluation records -> verdict table ``(keys..., kind, pos, verdict)``.

The reference hands every record to an LLM judge inside its metric library.
Here the judge is a table-in / table-out stage and the metrics are plain
aggregations over its verdicts (``metrics.py``), so a real judge model can be
plugged in without touching the metric code.

Stand-in judge (deterministic, the same rules are written in the DuckDB oracle):

* statements of a text: ``functions.text.statements``
* an answer / reference statement is *supported* when at least ``tau`` of its
  distinct tokens occur among the distinct tokens of all contexts
* a context is *relevant* when it holds at least ``relevance_tau`` of the distinct
  tokens of the reference
* the questions an answer implies are its statements, all of them
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as TX

# Fixed values of the stand-in judge
TAU = 0.5
#: Share of the reference's distinct tokens that a relevant context holds.
RELEVANCE_TAU = 0.2

KIND_FAITHFULNESS = "faithfulness"
KIND_RECALL = "context_recall"
KIND_PRECISION = "context_precision"


def _context_tokens(contexts: str) -> F.Column:
    ctx = F.coalesce(F.col(contexts), F.array().cast("array<string>"))
    return F.array_distinct(F.flatten(F.transform(ctx, lambda c: TX.tokens(c))))


def stand_in_verdicts(records: DataFrame, keys=("qid",), tau: float = TAU,
                      answer: str = "answer", reference: str = "reference",
                      contexts: str = "contexts", relevance_tau: float = RELEVANCE_TAU) -> DataFrame:
    """Verdicts of the stand-in judge; every row of the output is one judgement."""
    keys = list(keys)
    base = records.select(*keys, answer, reference, contexts,
                          _context_tokens(contexts).alias("_ctx"),
                          TX.distinct_tokens(reference).alias("_ref"))

    def supported(text_col: str, kind: str) -> DataFrame:
        ex = base.select(*keys, "_ctx", F.posexplode(TX.statements(text_col)).alias("_p", "_s"))
        return ex.select(*keys, F.lit(kind).alias("kind"), (F.col("_p") + 1).cast("int").alias("pos"),
                         (TX.token_coverage(TX.tokens("_s"), F.col("_ctx")) >= F.lit(tau))
                         .cast("int").alias("verdict"))

    ctx = F.coalesce(F.col(contexts), F.array().cast("array<string>"))
    prec = base.select(*keys, "_ref", F.posexplode(ctx).alias("_p", "_c")).select(
        *keys, F.lit(KIND_PRECISION).alias("kind"), (F.col("_p") + 1).cast("int").alias("pos"),
        F.coalesce(TX.token_coverage(F.col("_ref"), TX.tokens("_c")) >= F.lit(relevance_tau), F.lit(False))
        .cast("int").alias("verdict"))
    return (supported(answer, KIND_FAITHFULNESS)
            .unionByName(supported(reference, KIND_RECALL))
            .unionByName(prec))


def generated_questions(records: DataFrame, keys=("qid",), answer: str = "answer",
                        n: int | None = None) -> DataFrame:
    """Stand-in for the questions a judge derives from an answer: its statements.

    ``n`` bounds them where a real judge is asked for a fixed number; default: all.
    """
    keys = list(keys)
    found = TX.statements(answer) if n is None else F.slice(TX.statements(answer), 1, n)
    return records.select(*keys, F.posexplode(found).alias("_p", "gen")) \
        .select(*keys, (F.col("_p") + 1).cast("int").alias("pos"), "gen")


class Judge(Protocol):
    """Judges records: ``{question, answer, reference, contexts}`` -> verdicts (0/1) by kind, in order."""

    def __call__(self, records: list[dict]) -> list[dict[str, list[int]]]: ...


class TokenJudge:
    """Python form of the stand-in judge, for the batch stage."""

    def __init__(self, tau: float = TAU, relevance_tau: float = RELEVANCE_TAU):
        import regex
        self.tau, self.relevance_tau = tau, relevance_tau
        self._other, self._break = regex.compile(TX.NON_WORD), regex.compile(TX.STATEMENT_BREAK)

    def _tokens(self, text: str | None) -> set[str]:
        return {t for t in self._other.sub(" ", (text or "").lower()).split(" ") if t}

    def _supported(self, text: str | None, known: set[str]) -> list[int]:
        said = [s for s in map(self._tokens, self._break.split(text or "")) if s]
        return [int(len(s & known) / len(s) >= self.tau) for s in said]

    def __call__(self, records: list[dict]) -> list[dict[str, list[int]]]:
        out = []
        for r in records:
            contexts = [self._tokens(c) for c in r["contexts"]]
            known, wanted = set().union(*contexts), self._tokens(r["reference"])
            out.append({
                KIND_FAITHFULNESS: self._supported(r["answer"], known),
                KIND_RECALL: self._supported(r["reference"], known),
                KIND_PRECISION: [int(bool(wanted) and len(wanted & c) / len(wanted) >= self.relevance_tau)
                                 for c in contexts]})
        return out


def judge_records(records: DataFrame, judge: Judge | Callable, keys=("qid",), batch_size: int = 16,
                  factory: bool = False) -> DataFrame:
    """Judge stage: ``(keys..., kind, pos, verdict, error)``, one row per verdict.

    Records go to the judge in batches. If a batch fails, its records are
    judged one by one; a record that fails alone gives one row with its error
    and no verdict, and the others keep theirs.
    """
    keys = list(keys)
    fields = ["question", "answer", "reference", "contexts"]
    schema = T.StructType([records.schema[k] for k in keys] + [
        T.StructField("kind", T.StringType()), T.StructField("pos", T.IntegerType()),
        T.StructField("verdict", T.IntegerType()), T.StructField("error", T.StringType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = judge() if factory else judge

        def ask(batch: list[dict]) -> list:
            got = list(model([{**{f: r[f] for f in fields}, "contexts": list(r["contexts"] if r["contexts"] is not None
                                                                             else [])} for r in batch]))
            if len(got) != len(batch):
                raise ValueError(f"judge returned {len(got)} results for {len(batch)} records")
            return got

        def alone(record: dict):
            try:
                return ask([record])[0]
            except Exception as exc:  # noqa: BLE001 - the error is the record's result
                return str(exc)

        for pdf in batches:
            rows, out = pdf.to_dict("records"), []
            for at in range(0, len(rows), batch_size):
                batch = rows[at:at + batch_size]
                try:
                    got = ask(batch)
                except Exception:  # noqa: BLE001 - found per record below
                    got = [alone(r) for r in batch]
                for r, verdicts in zip(batch, got, strict=True):
                    key = [r[k] for k in keys]
                    if isinstance(verdicts, str):
                        out.append([*key, None, None, None, verdicts])
                    else:
                        out += [[*key, kind, i, v, None] for kind, vs in verdicts.items() for i, v in enumerate(vs, 1)]
            yield pd.DataFrame(out, columns=schema.names).astype({"pos": "Int32", "verdict": "Int32"})

    return records.select(*keys, *fields).mapInPandas(run, schema)


def judged_scores(records: DataFrame, judge: Judge | Callable, keys=("qid",), **kw) -> DataFrame:
    """Score table of a judge: metrics of failed records are null, with the judge's ``error`` beside them."""
    from ..session import cut_lineage
    from . import metrics as M
    records = cut_lineage(records)                      # the model's answers are read by several branches
    judged = cut_lineage(judge_records(records, judge, keys, **kw))
    failed = judged.where(F.col("error").isNotNull()).select(*keys, "error")
    out = M.score_table(records, keys, verdicts=judged.where(F.col("error").isNull()).drop("error"), errors=failed)
    return out.join(failed, list(keys), "left")
