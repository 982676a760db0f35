"""Batch generation.

``Generator`` is a picklable callable ``list[str] -> list[str]`` (prompts in,
answers out), built once per task and applied with ``mapInPandas``. A failing
call does not fail the job: the answer becomes
``Error processing your query: ...`` and the ``error`` column holds the
message (error as value, as the reference returns it).

The offline stand-in is native: the answer restates the question and cites the
longest statement of every (whole) context, so that its statements are partly
supported.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import prompts as P
from ..functions import text as TX
from .embed import in_parallel, within_budget

#: Between the statements of a stand-in answer.
ANSWER_SEPARATOR = ". "


class Generator(Protocol):
    def __call__(self, prompts: list[str]) -> list[str]: ...


def stand_in_answer(contexts_col: str = "contexts", question_col: str = "question") -> F.Column:
    """G01 stand-in: every statement of the question, then the longest statement of every context.

    Without a context it is the refusal sentence.
    """
    c = F.coalesce(F.col(contexts_col), F.array().cast("array<string>"))
    cited = F.filter(F.transform(c, TX.longest_statement), lambda x: x != "")
    said = F.coalesce(TX.statements(question_col), F.array().cast("array<string>"))
    return F.when(F.size(c) > 0, F.array_join(F.concat(said, cited), ANSWER_SEPARATOR)).otherwise(F.lit(P.REFUSAL))


def generate(df: DataFrame, prompt_col: str = "prompt", *, generator: Generator | Callable,
             answer_col: str = "answer", error_col: str = "error", batch_size: int = 16,
             factory: bool = False, max_concurrency: int | None = None, calls_per_task: int = 1) -> DataFrame:
    """Answer every prompt; keeps all input columns.

    ``max_concurrency`` bounds the calls at once of the whole job (see :mod:`.embed`).
    """
    schema = T.StructType(df.schema.fields + [T.StructField(answer_col, T.StringType(), True),
                                              T.StructField(error_col, T.StringType(), True)])
    src = within_budget(df, max_concurrency, calls_per_task)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = generator() if factory else generator

        def call(chunk: list[str]) -> list[tuple[str, str | None]]:
            try:
                got = list(model(chunk))
                if len(got) != len(chunk):
                    raise ValueError(f"generator returned {len(got)} answers for {len(chunk)} prompts")
                return [(a, None) for a in got]
            except Exception as e:  # noqa: BLE001 - error as value, per batch
                return [(P.ERROR_PREFIX + str(e), str(e))] * len(chunk)

        for pdf in batches:
            prompts = pdf[prompt_col].tolist()
            chunks = [prompts[s:s + batch_size] for s in range(0, len(prompts), batch_size)]
            replies = [r for chunk in in_parallel(call, chunks, calls_per_task) for r in chunk]
            answers, errors = [a for a, _ in replies], [e for _, e in replies]
            yield pdf.assign(**{answer_col: answers, error_col: errors})

    return src.mapInPandas(run, schema)
