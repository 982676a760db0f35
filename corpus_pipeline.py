"""Corpus pipeline: five stages over ``documents``, each written and read again.

1. ``language``: documents without letters, or without a main language, go.
2. ``near_duplicates``: of each group of documents that share 80 % of their
   5-word shingles (directly or through others) one stays.
3. ``repeated_passages``: strings of 100 bytes or more that also occur earlier
   in the corpus are cut out.
4. ``secrets``: passwords, keys and tokens are replaced by a mark.
5. ``packing``: what is left is packed into sequences of at most 4096 tokens.

Each stage works on all that its predecessor kept and takes its statistics
from its own input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ragloom.llm.common import materialize, prepare
from ragloom.llm.op3_jaccard import jaccard_stage
from ragloom.llm.op4_suffix_dedup import suffix_stage
from ragloom.llm.op5_secrets import secret_stage
from ragloom.llm.op7_language import language_stage
from ragloom.llm.op9_packing import packing_stage


def _stage(fn):
    def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        prepare(spark)
        return fn(spark, docs, sf_dir)
    stage.__name__, stage.__doc__ = fn.__name__, fn.__doc__
    return stage


STAGES = [("language", _stage(language_stage)), ("near_duplicates", _stage(jaccard_stage)),
          ("repeated_passages", _stage(suffix_stage)), ("secrets", _stage(secret_stage)),
          ("packing", _stage(packing_stage))]

#: SQL can't express language ID, components and byte removal; tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply ``STAGES`` to ``documents``."""
    prepare(spark)
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = materialize(docs, name)
    return docs
