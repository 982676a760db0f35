"""Batch embedding of text columns.

Two ways to embed a column:

* the offline stand-in (``embedder=None``): the hashing embedder as one native
  expression, so it runs in the JVM inside whole-stage pipelines;
* any :class:`Embedder` (``texts -> vectors``, picklable, built once per task):
  applied with ``mapInPandas`` in sub-batches of ``batch_size`` texts, with a
  retry of ``retries`` attempts and exponential waits. ``max_concurrency`` is a
  budget of calls at once for the whole job: tasks are merged in place
  (``coalesce``, no row moves) until tasks x ``calls_per_task`` stay within it.

A real model stage is billed and not deterministic: materialise its output
(``session.cut_lineage`` or a written table) before any second use.
"""

from __future__ import annotations

import hashlib
import random
import time
from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as TX

# Fixed values (batching and retry policy of the reference embedder client)
BATCH_SIZE = 256
MAX_CONCURRENCY = 20
RETRY_LIMIT = 5          # waits 1, 2, 4, 8 s between the five attempts


class Embedder(Protocol):
    def __call__(self, texts: list[str]) -> list[list[float]]: ...


class HashEmbedder:
    """Python form of the hashing embedder (same tokens and buckets as the native one).

    Used to check the ``mapInPandas`` path against the native expression and as
    the default model object of the batch stage.
    """

    def __init__(self, dim: int = 64):
        self.dim = dim
        import regex
        self._nonword = regex.compile(r"[^\p{L}\p{N}]+")

    def _vector(self, text: str | None) -> list[float] | None:
        if text is None:
            return None
        v = np.zeros(self.dim, dtype=np.float32)
        for tok in self._nonword.sub(" ", text.lower()).strip(" ").split(" "):
            if tok:
                v[int(hashlib.md5(tok.encode("utf-8")).hexdigest()[:4], 16) % self.dim] += 1
        return v.tolist()

    def __call__(self, texts: list[str]) -> list[list[float]]:
        return [self._vector(t) for t in texts]


class RateLimited(RuntimeError):
    """Raised by a model client when the service asks to slow down."""


#: Failures that another attempt can mend; bad input and bugs are raised at once.
RETRYABLE = (RateLimited, ConnectionError, TimeoutError)


def pauses(attempts: int = RETRY_LIMIT, first: float = 1.0, jitter: Callable[[], float] = random.random) -> Iterator[float]:
    """Waiting times between attempts: doubling, each stretched by up to a tenth, so that tasks spread out."""
    return (first * 2 ** i * (1 + jitter() / 10) for i in range(attempts - 1))


def call_model(call: Callable[[list[str]], list], batch: list[str], *, attempts: int = RETRY_LIMIT,
               retry_on: tuple[type[BaseException], ...] = RETRYABLE, sleep: Callable[[float], None] = time.sleep) -> list:
    """One reply per input of ``batch``; repeats after failures of the kinds in ``retry_on``."""
    waiting = pauses(attempts)
    while True:
        try:
            reply = list(call(batch))
        except retry_on:
            pause = next(waiting, None)
            if pause is None:
                raise
            sleep(pause)
            continue
        if len(reply) != len(batch):
            raise ValueError(f"model returned {len(reply)} replies for {len(batch)} inputs")
        return reply


def hash_embed(df: DataFrame, text_col: str, out_col: str = "embedding", dim: int = 64) -> DataFrame:
    """Native hashing embedder."""
    return df.withColumn(out_col, TX.hash_embedding(text_col, dim))


def within_budget(df: DataFrame, max_concurrency: int | None, calls_per_task: int = 1) -> DataFrame:
    """``df`` in so few tasks that ``calls_per_task`` calls of each stay within the job's budget; rows stay in place."""
    if calls_per_task < 1 or (max_concurrency is not None and max_concurrency < calls_per_task):
        raise ValueError("need 1 <= calls_per_task <= max_concurrency")
    return df.coalesce(max_concurrency // calls_per_task) if max_concurrency else df


def in_parallel(call: Callable[[list], list], chunks: list[list], calls_per_task: int) -> list[list]:
    """``call`` of every chunk, in order, at most ``calls_per_task`` at once."""
    if calls_per_task == 1 or len(chunks) < 2:
        return [call(c) for c in chunks]
    from concurrent.futures import ThreadPoolExecutor
    with ThreadPoolExecutor(calls_per_task) as pool:
        return list(pool.map(call, chunks))


def embed(df: DataFrame, text_col: str, out_col: str = "embedding", *,
          embedder: Embedder | Callable[[], Embedder] | None = None, dim: int = 64,
          batch_size: int = BATCH_SIZE, retries: int = RETRY_LIMIT,
          max_concurrency: int | None = None, factory: bool = False,
          retry_on: tuple[type[BaseException], ...] = RETRYABLE, calls_per_task: int = 1) -> DataFrame:
    """Embed ``text_col`` into ``out_col`` (``array<float>``), keeping every row.

    ``embedder=None`` uses the native hashing expression. Otherwise the embedder
    is applied per Arrow batch in order-preserving sub-batches of ``batch_size``;
    with ``factory=True`` it is a zero-argument callable building the model once
    per task (clients that cannot be pickled).
    """
    if embedder is None:
        return hash_embed(df, text_col, out_col, dim)
    out_schema = T.StructType(df.schema.fields + [
        T.StructField(out_col, T.ArrayType(T.FloatType()), True)])
    src = within_budget(df, max_concurrency, calls_per_task)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = embedder() if factory else embedder

        def call(at: list[int]) -> list:
            return call_model(model, [texts[i] for i in at], attempts=retries, retry_on=retry_on) if at else []

        for pdf in batches:
            texts = pdf[text_col].tolist()
            vecs: list = [None] * len(texts)
            live = [[i for i in range(start, min(start + batch_size, len(texts))) if texts[i] is not None]
                    for start in range(0, len(texts), batch_size)]
            for at, got in zip(live, in_parallel(call, live, calls_per_task), strict=True):
                for i, v in zip(at, got, strict=True):
                    vecs[i] = None if v is None else np.asarray(v, dtype=np.float32)
            yield pdf.assign(**{out_col: vecs})

    return src.mapInPandas(run, out_schema)


def embed_distinct(df: DataFrame, text_col: str, out_col: str = "embedding", **kw) -> DataFrame:
    """Embed each distinct text once and join the vectors back by text.

    Rows without a text don't take part in the join. A text that fills a large
    share of the rows is on the probing side of an inner equi-join, which
    adaptive execution splits.
    """
    with_text = df.where(F.col(text_col).isNotNull())
    vecs = embed(with_text.select(text_col).distinct(), text_col, out_col, **kw)
    without = df.where(F.col(text_col).isNull()).withColumn(out_col, F.lit(None).cast(vecs.schema[out_col].dataType))
    return with_text.join(vecs, text_col).select(*df.columns, out_col).unionByName(without)
