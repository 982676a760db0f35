"""Model results that outlive a run (V03, G01, G03, U-Judge).

A model stage is slow and billed. :func:`answered_once` keeps its results in a
table under ``path``, keyed by a SHA-256 of the stage's name and of what it
reads. A run asks the model only for keys that the table lacks and appends their
results; a later run, or another one that shares the table, finds them there.

Keys are asked for in slices of about ``slice_rows``, each one job with its own
commit. When a run ends early (a lost driver, a failing model), everything up
to the last finished slice stays; within a slice Spark repeats lost tasks only.
Rows that the stage marks as failed (``error`` not null) are stored too, and
asked again by the next run if ``retry_errors``.

Only keys and results are stored, and equal inputs are asked for once. Two
writers at a time may both ask for a key; readers take one of the results.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut_lineage
from . import embed as E
from . import generate as G
from . import judge as J

SLICE_ROWS = 100_000
KEY = "_key"


def _stored(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Stored results; empty only if there is no such path."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as exc:
        if exc.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def answered_once(df: DataFrame, reads: list[str], stage: Callable[[DataFrame], DataFrame], adds: T.StructType, path: str,
                  name: str, *, slice_rows: int = SLICE_ROWS, retry_errors: bool = True) -> DataFrame:
    """``df`` with the columns ``adds`` that ``stage`` computes from the columns ``reads``.

    ``stage`` gets ``(_key, *reads)`` and returns at least ``(_key, *adds)``. Rows
    in which every column of ``reads`` is null are not asked for.
    """
    spark = df.sparkSession
    schema = T.StructType([T.StructField(KEY, T.StringType()), *adds.fields])
    has_error = "error" in adds.names
    # a null and its text are told apart by the JSON form
    key = F.sha2(F.concat_ws("\x1f", F.lit(name), F.to_json(F.struct(*reads), {"ignoreNullFields": "false"})), 256)
    keyed = df.withColumn(KEY, F.when(F.coalesce(*[F.col(c).cast("string") for c in reads]).isNotNull(), key))
    done = _stored(spark, path, schema)
    if has_error and retry_errors:
        done = done.where(F.col("error").isNull())
    asked = keyed.where(F.col(KEY).isNotNull()).select(KEY, *reads).dropDuplicates([KEY]) \
        .join(done.select(KEY).distinct(), KEY, "left_anti")
    asked = cut_lineage(asked)
    slices = math.ceil(asked.count() / slice_rows)
    for i in range(slices):
        part = asked.where(F.pmod(F.xxhash64(KEY), F.lit(slices)) == i) if slices > 1 else asked
        stage(part).select(KEY, *adds.names).write.mode("append").parquet(path)
    best = F.min_by(F.struct(*adds.names), F.col("error").isNotNull() if has_error else F.lit(False))
    results = _stored(spark, path, schema).groupBy(KEY).agg(best.alias("_r")).select(KEY, "_r.*")
    plain = keyed.drop(*adds.names)
    return plain.where(F.col(KEY).isNotNull()).join(results, KEY, "left").select(*plain.drop(KEY).columns, *adds.names) \
        .unionByName(plain.where(F.col(KEY).isNull()).drop(KEY), allowMissingColumns=True)


def embed_cached(df: DataFrame, text_col: str, out_col: str, path: str, *, embedder, name: str,
                 slice_rows: int = SLICE_ROWS, **kw) -> DataFrame:
    """Vectors from a table that runs share; only texts that it lacks are embedded."""
    adds = T.StructType([T.StructField(out_col, T.ArrayType(T.FloatType()))])
    return answered_once(df, [text_col], lambda p: E.embed(p, text_col, out_col, embedder=embedder, **kw), adds, path, name,
                         slice_rows=slice_rows)


def generate_resumable(df: DataFrame, path: str, *, generator, name: str, prompt_col: str = "prompt",
                       slice_rows: int = SLICE_ROWS, retry_errors: bool = True, **kw) -> DataFrame:
    """Answers from a table keyed by the prompt; a run that ended early goes on with the unanswered ones."""
    adds = T.StructType([T.StructField("answer", T.StringType()), T.StructField("error", T.StringType())])
    return answered_once(df, [prompt_col], lambda p: G.generate(p, prompt_col, generator=generator, **kw), adds, path, name,
                         slice_rows=slice_rows, retry_errors=retry_errors)


def judge_resumable(records: DataFrame, path: str, *, judge, name: str, keys=("qid",), slice_rows: int = SLICE_ROWS,
                    retry_errors: bool = True, **kw) -> DataFrame:
    """U-Judge: ``(keys..., kind, pos, verdict, error)`` of :func:`.judge.judge_records`, from a table keyed by the record."""
    reads = ["question", "answer", "reference", "contexts"]
    verdict = T.StructType([T.StructField("kind", T.StringType()), T.StructField("pos", T.IntegerType()),
                            T.StructField("verdict", T.IntegerType())])
    adds = T.StructType([T.StructField("verdicts", T.ArrayType(verdict)), T.StructField("error", T.StringType())])

    def stage(part: DataFrame) -> DataFrame:
        part = cut_lineage(part)
        rows = J.judge_records(part, judge, keys=(KEY,), **kw)
        found = rows.groupBy(KEY).agg(
            F.collect_list(F.when(F.col("kind").isNotNull(), F.struct("kind", "pos", "verdict"))).alias("verdicts"),
            F.max("error").alias("error"))
        # a record without anything to judge is answered too
        return part.select(KEY).join(found, KEY, "left")

    out = answered_once(records.select(*keys, *reads), reads, stage, adds, path, name, slice_rows=slice_rows,
                        retry_errors=retry_errors)
    failed = out.where(F.col("error").isNotNull()).select(
        *keys, *[F.lit(None).cast(f.dataType).alias(f.name) for f in verdict.fields], "error")
    return out.where(F.col("error").isNull()).select(*keys, F.explode("verdicts").alias("v")) \
        .select(*keys, "v.*", F.lit(None).cast("string").alias("error")).unionByName(failed)
