"""The reference's inputs, derived from the driver's test tables.

* Q/A pairs: a ``user`` turn whose next turn is an ``assistant`` turn. Turns
  are positions 0..n-1, so "next" is the equi-join ``(conv_id, turn + 1)``:
  a join on a unique composite key, balanced even when one conversation is
  huge (a ``lead`` window would put a whole conversation in one task).
* Q/A corpus: the pairs with positional ids ``q_i`` in ``(conv_id, turn)``
  order and the hashed embedding of the question.
* Evaluation set: every pair, scored leave-one-out (its own row is excluded
  from its retrieval), so the whole table is both corpus and question set.
* Vector corpus: ``embeddings`` as is (``id = vec_id``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import corpus as C
from ..operators import embed as E

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations")
DIM = 64


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def qa_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(conv_id, turn, input, output)`` for every user turn answered by the assistant."""
    conv = read_table(spark, sf_dir, "conversations")
    users = conv.where(F.col("role") == "user").select("conv_id", "turn", F.col("text").alias("input"))
    answers = conv.where(F.col("role") == "assistant").select(
        "conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("output"))
    return users.join(answers, ["conv_id", "turn"])


def qa_corpus(spark: SparkSession, sf_dir: str, dim: int = DIM) -> DataFrame:
    """A3 corpus ``(id, conv_id, turn, input, output, embedding)`` from the Q/A pairs."""
    pairs = C.positional_ids(qa_pairs(spark, sf_dir), ["conv_id", "turn"])
    return E.hash_embed(pairs, "input", "embedding", dim)


def eval_questions(corpus: DataFrame, dim: int = DIM) -> DataFrame:
    """A9 evaluation set ``(qid, question, reference, qvec)``; ``qid`` is the pair's own id."""
    q = corpus.select(F.col("id").alias("qid"), F.col("input").alias("question"),
                      F.col("output").alias("reference"))
    return E.hash_embed(q, "question", "qvec", dim)


def vector_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(id, embedding, label)`` from ``embeddings``."""
    return read_table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("id"), "embedding", "label")


def vector_queries(corpus: DataFrame) -> DataFrame:
    """Every vector as a question; its own row is excluded from its answers."""
    return corpus.select(F.col("id").alias("qid"), F.col("embedding").alias("qvec"),
                         F.col("id").alias("self_id"))
