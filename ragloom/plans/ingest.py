"""Offline ingest as one lazy plan with a single append.

raw JSON corpus -> ``output`` default -> positional ids ``q_i`` -> anti join
with the corpus (only new rows are embedded) -> embed -> contract check ->
append. The only shuffles: range partitioning for the ids, and the anti join
on narrow id columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import corpus as C
from ..operators import embed as E
from ..session import cut_lineage


def prepare(raw: DataFrame, order_cols: list[str], id_prefix: str = "q_") -> DataFrame:
    """``(id, input, output, load_seq)`` in file order; ``order_cols`` must be a unique order key."""
    df = C.fill_output(raw)
    df = C.positional_index(df, order_cols, "load_seq")
    return df.select(F.concat(F.lit(id_prefix), F.col("load_seq").cast("string")).alias("id"),
                     "input", "output", "load_seq")


def ingest(prepared: DataFrame, corpus_path: str, dim: int, embedder=None) -> DataFrame:
    """Embed only the rows whose id is new, check the contract, append; returns the load report."""
    spark = prepared.sparkSession
    existing = C.read_ids(spark, corpus_path, prepared.select("id").schema)
    report = cut_lineage(C.load_report(prepared, existing))
    new = C.rows_to_insert(prepared, existing)
    embedded = E.embed(new, "input", "embedding", embedder=embedder, dim=dim)
    # a model stage is billed and not deterministic: write its output once, then check and append
    embedded = cut_lineage(embedded.select("id", "input", "output", "embedding"))
    C.assert_contract(embedded, dim)
    embedded.write.mode("append").parquet(corpus_path)
    return report
