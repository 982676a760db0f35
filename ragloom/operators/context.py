"""Contexts of a question as ordered columns.

All of these group search hits by question. A question has at most k hits
(k is small and fixed), so every group is bounded; the hits come out of the
top-k merge already hash-partitioned by ``qid``, so grouping by ``qid`` adds
no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import prompts as P


def _ordered(items: Column, field: str) -> Column:
    """Order ``collect_list(struct(rk, field))`` by rank and keep the field."""
    return F.transform(F.array_sort(items), lambda x: x[field])


def contexts(hits: DataFrame, text_col: str = "output", qid_col: str = "qid",
             rk_col: str = "rk", out_col: str = "contexts") -> DataFrame:
    """``(qid, contexts array<string>)`` in rank order (never a bare collect_list)."""
    return hits.groupBy(qid_col).agg(
        _ordered(F.collect_list(F.struct(F.col(rk_col).alias("rk"), F.col(text_col).alias("t"))),
                 "t").alias(out_col))


def join_contexts(ctx: Column | str, sep: str = P.CONTEXT_SEPARATOR) -> Column:
    """Contexts joined by ``\\n\\n---\\n\\n``."""
    c = F.col(ctx) if isinstance(ctx, str) else ctx
    return F.array_join(c, sep)


def scored_reference(hits: DataFrame, qid_col: str = "qid") -> DataFrame:
    """``[0.1234] input → output`` lines in rank order, joined by a blank line."""
    line = F.format_string(P.SCORED_LINE, F.col("score"), F.col("input"), F.col("output"))
    return hits.groupBy(qid_col).agg(
        F.array_join(_ordered(F.collect_list(F.struct(F.col("rk").alias("rk"), line.alias("t"))), "t"),
                     P.REFERENCE_SEPARATOR).alias("reference_block"))


def numbered_documents(docs: DataFrame, qid_col: str = "qid", pos_col: str = "rk") -> DataFrame:
    """``Document i:\\nInput: ..\\nOutput: ..`` blocks in order, joined by a blank line.

    Missing ``input``/``output`` values print as empty text (P02).
    """
    block = F.format_string(P.DOCUMENT_BLOCK, F.col(pos_col),
                            F.coalesce(F.col("input"), F.lit("")),
                            F.coalesce(F.col("output"), F.lit("")))
    return docs.groupBy(qid_col).agg(
        F.array_join(_ordered(F.collect_list(F.struct(F.col(pos_col).alias("rk"), block.alias("t"))),
                              "t"), P.REFERENCE_SEPARATOR).alias("documents"))


def has_documents(docs: Column | str) -> Column:
    """``similar_docs and len(similar_docs) > 0``."""
    d = F.col(docs) if isinstance(docs, str) else docs
    return F.size(F.coalesce(d, F.array())) > 0


def route(questions: DataFrame, given: DataFrame, retrieved: DataFrame,
          qid_col: str = "qid") -> DataFrame:
    """Given documents when a question has any, else its own retrieval.

    ``given``: ``(qid, documents string)``; ``retrieved``: ``(qid, contexts string)``.
    Output ``(qid, source, context)`` with ``source`` in {given, retrieved, none}.
    """
    g = given.select(qid_col, F.col("documents").alias("_given"))
    r = retrieved.select(qid_col, F.col("contexts").alias("_ret"))
    j = questions.select(qid_col).join(g, qid_col, "left").join(r, qid_col, "left")
    use_given = F.coalesce(F.length("_given") > 0, F.lit(False))
    return j.select(
        qid_col,
        F.when(use_given, F.lit("given"))
         .when(F.col("_ret").isNotNull(), F.lit("retrieved")).otherwise(F.lit("none")).alias("source"),
        F.when(use_given, F.col("_given")).otherwise(F.col("_ret")).alias("context"))
