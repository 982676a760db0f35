"""Helpers shared by the training-data operators.

* :func:`prepare` makes the package importable in Python workers and bounds
  Arrow batches by rows, so that very long texts don't meet in one batch.
* :func:`materialize` writes a table to the shared folder and reads it back:
  it cuts the lineage and survives lost executors.
* :func:`connected_components` labels the components of a link table with
  joins only (links never reach the driver).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir, ship_code, work_path

#: Rows of one Arrow batch sent to a Python worker.
ARROW_ROWS = 256


def prepare(spark: SparkSession) -> None:
    """Shared folder, code archive and Arrow batch size for the operators of this package."""
    ensure_checkpoint_dir(spark)
    ship_code(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))


def read_documents(spark: SparkSession, sf_dir: str, table: str = "documents") -> DataFrame:
    prepare(spark)
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{table}.parquet")


#: Spark's setting that removes a query's shuffle files when the query is done.
DROP_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet under the shared folder and return the table that is read back.

    Nothing reads the shuffles of the write again, so their files go with it
    (else they stay until the driver happens to collect garbage).
    """
    spark = df.sparkSession
    path = work_path(spark, name)
    before = spark.conf.get(DROP_SHUFFLES, "false")
    spark.conf.set(DROP_SHUFFLES, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(DROP_SHUFFLES, before)
    return spark.read.schema(df.schema).parquet(path)


#: Ids that may be broadcast (8 bytes each); more are joined by a shuffle.
MAX_BROADCAST_IDS = 1_000_000


def semi_join(df: DataFrame, ids: DataFrame, col: str, max_ids: int = MAX_BROADCAST_IDS) -> DataFrame:
    """Rows of ``df`` whose ``col`` is in ``ids(col)``; wide rows stay in place while the ids are counted to fit."""
    ids = ids.select(col).distinct()
    return df.join(F.broadcast(ids) if ids.count() <= max_ids else ids, col, "left_semi")


def text_or_empty(col: str | Column) -> Column:
    """A null text counts as empty."""
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))


def connected_components(links: DataFrame, src: str = "a", dst: str = "b",
                         node: str = "node", comp: str = "comp", max_rounds: int = 60) -> DataFrame:
    """``(node, comp)``: every node of an undirected link table with the smallest node it reaches.

    Alternating large-star and small-star (Kiveris et al. 2014): every round
    rewires links towards smaller ids until a forest of stars is left. A hot
    node only ever appears as a grouping key of ``min`` (map-side combined)
    and of an equi-join that adaptive execution can split. Nulls and
    self-links are ignored; an empty table gives an empty result.
    """
    e = links.select(F.col(src).alias("u"), F.col(dst).alias("v")) \
        .where(F.col("u").isNotNull() & F.col("v").isNotNull() & (F.col("u") != F.col("v")))
    e = e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    e = materialize(e, "links")
    before = None
    for _ in range(max_rounds):
        # large star: neighbours larger than the node move to the node's minimum
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where(F.col("v") > F.col("u")).join(low, "u") \
            .select(F.col("v").alias("u"), F.col("m").alias("v")).where(F.col("u") != F.col("v")).distinct()
        large = materialize(large, "large-star")
        # small star: smaller neighbours and the node itself move to their minimum
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        moved = small.where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = materialize(moved.unionByName(low.select("u", F.col("m").alias("v"))).distinct(), "small-star")
        state = e.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if (state["n"], state["h"]) == before:
            break
        before = (state["n"], state["h"])
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = e.select(F.col("v").alias(node), F.col("v").alias(comp)).distinct()
    return e.select(F.col("u").alias(node), F.col("v").alias(comp)).unionByName(roots)
