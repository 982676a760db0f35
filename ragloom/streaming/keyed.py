"""Document stream with keyed state (ST2).

:func:`keyed_document_stream` remembers the ids it has seen in the state store
(RocksDB) instead of scanning the corpus' id column in every micro-batch: the
work of a batch grows with the batch, not with the corpus. The first row of an
id in load order within its first batch goes out, every later one is dropped.

The rows are written by the streaming file sink, whose log makes each batch
appear once: a batch that is run again after a failure replaces its own files,
and its state starts from the version before it. A stream that is started anew
on the same checkpoint goes on where it stopped.

A corpus that exists before the stream is read as a second source of ids in the
first batch, so that it is never scanned again; a known id of the same batch
wins over new rows.

State per id: one boolean. Rows are grouped by id, in Arrow batches of many
groups; only ``id``, the order and the row's columns cross to Python.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..session import work_path
from .stream import _source

#: Class of the state store that keeps state on disk with incremental checkpoints.
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def first_of_new_ids(rows: DataFrame, id_col: str = "id", order_col: str = "load_seq") -> DataFrame:
    """Of a streaming ``rows(id, order, ..., known boolean)`` the first row of every id that was not seen before.

    Rows with ``known`` only mark their id. A null id is an id like any other; a
    null order comes last, and rows of equal order are taken by the text of all
    their columns.
    """
    out = T.StructType([f for f in rows.schema.fields if f.name != "known"])
    names = out.names

    def winner(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        best, known = None, state.exists
        for frame in frames:
            known = known or bool(frame["known"].any())
            if not known:
                frame = frame[names] if best is None else pd.concat([best, frame[names]])
                ties = frame.astype(str).agg("\x1f".join, axis=1)
                best = frame.assign(_null=frame[order_col].isna(), _ties=ties).sort_values(
                    ["_null", order_col, "_ties"]).head(1)[names]
        state.update((True,))
        if not known and best is not None:
            yield best

    return rows.groupBy(id_col).applyInPandasWithState(
        winner, out, T.StructType([T.StructField("seen", T.BooleanType())]), "append", GroupStateTimeout.NoTimeout)


def keyed_document_stream(spark: SparkSession, source: str, schema: T.StructType, sink: str,
                          prepare: Callable[[DataFrame], DataFrame], *, existing: str | None = None,
                          checkpoint: str | None = None, id_col: str = "id", order_col: str = "load_seq",
                          available_now: bool = True, max_files_per_trigger: int | None = None) -> StreamingQuery:
    """ST2: new documents of ``source`` into the folder ``sink``, once per id.

    ``prepare`` turns raw rows into ``(id, order, ...)``; ``existing`` is a Parquet
    corpus whose ids count as seen. Read the result with ``spark.read.parquet(sink)``.
    """
    if spark.conf.get("spark.sql.streaming.stateStore.providerClass", "") != ROCKSDB:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    checkpoint = checkpoint or work_path(spark, "keyed-ingest-ckpt")
    rows = prepare(_source(spark, source, schema, max_files_per_trigger)).withColumn("known", F.lit(False))
    if existing is not None:
        have = spark.read.parquet(existing).select(id_col).schema
        seen = spark.readStream.schema(have).parquet(existing)
        rows = rows.unionByName(seen.select(id_col, *[F.lit(None).cast(f.dataType).alias(f.name) for f in rows.schema.fields
                                                      if f.name not in (id_col, "known")], F.lit(True).alias("known")))
    w = first_of_new_ids(rows, id_col, order_col).writeStream.format("parquet").outputMode("append") \
        .option("checkpointLocation", checkpoint).option("path", sink)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="10 seconds")
    return w.start()
