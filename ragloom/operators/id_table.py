"""Bucketed id table: insert-if-absent without a corpus shuffle.

Beyond the broadcast bound of :func:`.corpus.rows_to_insert`, an anti join has
to bring equal ids together. Here the corpus keeps its ids in a table that is
bucketed and sorted by id (:func:`create`). A load is bucketed the same way
once, so the join needs no exchange on the corpus side: every task reads one
bucket of the table and one of the load. New ids are appended as further files
of the same buckets (:func:`insert`), so the table is never rewritten.

The number of buckets is fixed when the table is created; choose it for the ids
that it will hold (a few million per bucket). One writer at a time.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import work_path
from . import corpus as C

BUCKETS = 64


def create(spark: SparkSession, name: str, ids: DataFrame, id_col: str = "id", buckets: int = BUCKETS) -> None:
    """A table ``name`` of the distinct ids, bucketed and sorted by id, in the shared folder."""
    ids.select(id_col).distinct().repartition(buckets, id_col).write.bucketBy(buckets, id_col).sortBy(id_col) \
        .format("parquet").option("path", work_path(spark, f"ids-{name}")).saveAsTable(name)


def drop(spark: SparkSession, name: str) -> None:
    spark.sql(f"DROP TABLE IF EXISTS {name}")


def absent(load: DataFrame, table: str, id_col: str = "id") -> DataFrame:
    """Rows of ``load`` whose id is not in the table; only the load is exchanged."""
    spark = load.sparkSession
    ids = spark.table(table).select(F.col(id_col).alias("_known")).hint("merge")
    return load.join(ids, load[id_col] == ids["_known"], "left_anti")


def buckets_of(spark: SparkSession, table: str) -> int:
    rows = spark.sql(f"DESCRIBE FORMATTED {table}").where("col_name = 'Num Buckets'").collect()
    return int(rows[0]["data_type"])


def insert(load: DataFrame, corpus_path: str, table: str, id_col: str = "id", order_col: str = "load_seq",
           columns: list[str] | None = None) -> int:
    """Append the load's new rows to the Parquet corpus and their ids to the table; returns their number.

    The new rows are written to the shared folder first. If the job ends
    between the two appends, the next :func:`insert` of the same load finds the
    ids of what it appended in the corpus only; run :func:`repair` then.
    """
    spark = load.sparkSession
    winners = C._winners(load, id_col, order_col)
    new = C.cut_lineage(absent(winners.withColumnRenamed("_id", id_col), table, id_col).withColumnRenamed(id_col, "_id"))
    n = new.count()
    if n:
        rows = C._rows_of(load, new, id_col, order_col)
        rows.select(*(columns or [c for c in load.columns if c != order_col])).write.mode("append").parquet(corpus_path)
        _append(new.select(F.col("_id").alias(id_col)), table, id_col)
    return n


def _append(ids: DataFrame, table: str, id_col: str) -> None:
    n = buckets_of(ids.sparkSession, table)
    ids.repartition(n, id_col).write.mode("append").bucketBy(n, id_col).sortBy(id_col).format("parquet").saveAsTable(table)


def repair(spark: SparkSession, corpus_path: str, table: str, id_col: str = "id") -> int:
    """Add ids of the corpus that the table lacks (after a job that ended between the two appends)."""
    ids = spark.read.parquet(corpus_path).select(id_col).distinct()
    missing = C.cut_lineage(absent(ids, table, id_col))
    n = missing.count()
    if n:
        _append(missing, table, id_col)
    return n


def fresh_name(prefix: str = "ids") -> str:
    return f"{prefix}_{uuid.uuid4().hex[:12]}"
