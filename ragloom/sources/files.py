"""JSON and CSV readers and writers.

Schemas are always explicit (never inferred). JSON Lines are split over tasks by
Spark's reader. One JSON array per file, and CSV with quoted newlines, are one
task per file with Spark's ``multiLine``; with ``split=True`` they are read by
byte ranges (see :mod:`.splitting`), for files larger than a task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import splitting as SP

RAW_CORPUS = T.StructType([T.StructField("input", T.StringType()),
                           T.StructField("output", T.StringType()),
                           T.StructField("casename", T.StringType())])

EMBEDDED_CORPUS = T.StructType([T.StructField("id", T.StringType()),
                                T.StructField("input", T.StringType()),
                                T.StructField("output", T.StringType()),
                                T.StructField("embedding", T.ArrayType(T.FloatType()))])

EVAL_SET = T.StructType([T.StructField("input", T.StringType()),
                         T.StructField("output", T.StringType())])

ANSWER_SHEET = T.StructType([T.StructField("user_input", T.StringType()),
                             T.StructField("response", T.StringType()),
                             T.StructField("reference", T.StringType())])

BOM = "\ufeff"


def _json(spark: SparkSession, path: str, schema: T.StructType, json_array: bool, split: bool = False) -> DataFrame:
    if json_array and split:
        return SP.read_json_array(spark, path, schema)
    return (spark.read.schema(schema).option("multiLine", json_array).option("mode", "FAILFAST")
            .option("encoding", "UTF-8").json(path))


def read_raw_corpus(spark: SparkSession, path: str, json_array: bool = True, split: bool = False) -> DataFrame:
    """S01 (+P02, M1, M2): ``(input, output)``; missing output -> '', missing input -> error.

    ``casename`` is read and dropped; a row without ``input`` raises ``ValueError``
    (checked with one aggregate, nothing is collected).
    """
    df = _json(spark, path, RAW_CORPUS, json_array, split)
    missing = df.where(F.col("input").isNull()).limit(1).count()
    if missing:
        raise ValueError("raw corpus row without 'input'")
    return df.select("input", F.coalesce(F.col("output"), F.lit("")).alias("output"))


def read_embedded_corpus(spark: SparkSession, path: str, json_array: bool = True, split: bool = False) -> DataFrame:
    """``(id, input, output, embedding array<float>)``."""
    return _json(spark, path, EMBEDDED_CORPUS, json_array, split)


def read_eval_set(spark: SparkSession, path: str, json_array: bool = True, split: bool = False) -> DataFrame:
    """``(question, reference)`` from ``{input, output}`` items."""
    return _json(spark, path, EVAL_SET, json_array, split).select(
        F.col("input").alias("question"), F.col("output").alias("reference"))


def read_answer_sheet(spark: SparkSession, path: str, split: bool = False) -> DataFrame:
    """S04 + P05: UTF-8 CSV (BOM allowed) ``user_input, response, reference`` ->
    ``(question, answer, reference)``. Quoted newlines and doubled quotes survive;
    an empty field is null, as pandas reads it."""
    if split:
        df = SP.read_csv(spark, path, ANSWER_SHEET)
    else:
        df = (spark.read.schema(ANSWER_SHEET).option("header", True).option("multiLine", True)
              .option("escape", '"').option("encoding", "UTF-8").option("mode", "FAILFAST").csv(path))
    return df.withColumnsRenamed({"user_input": "question", "response": "answer"}) \
        .select("question", "answer", "reference")


def with_file_order(df: DataFrame, col: str = "file_order") -> DataFrame:
    """Add a unique order key that follows file order (P03 needs one for ``q_i``).

    ``(file path, block start, row id)``: the row id grows within one split,
    and splits of one file are ordered by their byte offset.
    """
    return df.select("*", F.struct(F.col("_metadata.file_path").alias("f"),
                                   F.col("_metadata.file_block_start").alias("b"),
                                   F.monotonically_increasing_id().alias("r")).alias(col))


def write_json(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """JSON Lines, UTF-8, non-ASCII text written as is."""
    df.write.mode(mode).option("encoding", "UTF-8").json(path)


def write_scores_csv(df: DataFrame, path: str, mode: str = "overwrite", bom: bool = True) -> None:
    """CSV with header, no index; array columns as JSON text; UTF-8 BOM.

    The BOM is the first character of the first header name, so every reader
    that strips a BOM (pandas ``utf-8-sig``, Spark) reads the plain name back.
    """
    cols = []
    for f in df.schema.fields:
        c = F.to_json(F.col(f.name)) if isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType)) \
            else F.col(f.name)
        cols.append(c.alias(f.name))
    out = df.select(*cols)
    if bom and out.columns:
        out = out.withColumnRenamed(out.columns[0], BOM + out.columns[0])
    out.write.mode(mode).option("header", True).option("escape", '"').option("encoding", "UTF-8").csv(path)


def show_scores(df: DataFrame, metrics, n: int = 20) -> None:
    """Print with metrics rounded to 3 decimals."""
    df.select(*[F.round(c, 3).alias(c) if c in metrics else F.col(c) for c in df.columns]) \
        .show(n, truncate=40)
