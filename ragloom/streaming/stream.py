"""Structured Streaming forms of the per-request functions (ST1, ST2).

* question stream: each micro-batch of questions is answered against the
  static corpus with the batched top-k and written to ``sink/epoch=<id>``
  with overwrite, so a replayed epoch replaces its own output (idempotent).
* document stream: each micro-batch is inserted into the corpus with
  insert-if-absent; a replay inserts nothing twice because of the anti join.

Checkpoints and sinks live under the shared checkpoint folder.
"""

from __future__ import annotations

from collections.abc import Callable
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..operators import corpus as C
from ..operators import topk as K
from ..session import work_path


def _source(spark: SparkSession, source: str, schema, max_files: int | None = None) -> DataFrame:
    """File stream over ``source``: a folder, or one file (read as its folder + a name filter).

    ``max_files`` bounds the files per micro-batch; ``availableNow`` still
    drains the whole backlog, in several bounded batches.
    """
    import os
    reader = spark.readStream.schema(schema)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", int(max_files))
    # one file or a folder of that name: the path of a row's file tells
    first = spark.read.schema(schema).parquet(source).select("_metadata.file_path").first()
    folder, name = os.path.split(source.rstrip("/"))
    if first is not None and os.path.basename(unquote(first[0])) == name:
        return reader.option("pathGlobFilter", name).parquet(folder)
    return reader.parquet(source)


def question_stream(spark: SparkSession, source: str, schema, corpus: DataFrame, k: int,
                    prepare: Callable[[DataFrame], DataFrame], sink: str | None = None,
                    checkpoint: str | None = None, exclude_col: str | None = None,
                    payload=(), available_now: bool = True,
                    max_files_per_trigger: int | None = None) -> tuple[StreamingQuery, str]:
    """ST1: start the stream; ``prepare`` turns a raw batch into ``(qid, qvec[, exclude])``."""
    sink = sink or work_path(spark, "stream-topk")
    checkpoint = checkpoint or work_path(spark, "stream-topk-ckpt")
    src = _source(spark, source, schema, max_files_per_trigger)

    def each(batch: DataFrame, epoch_id: int) -> None:
        hits = K.top_k(corpus, prepare(batch), k, exclude_col=exclude_col, payload=list(payload))
        hits.write.mode("overwrite").parquet(f"{sink}/epoch={epoch_id}")

    w = src.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="10 seconds")
    return w.start(), sink


def document_stream(spark: SparkSession, source: str, schema, corpus_path: str,
                    prepare: Callable[[DataFrame], DataFrame], checkpoint: str | None = None,
                    id_col: str = "id", order_col: str = "load_seq",
                    available_now: bool = True,
                    max_files_per_trigger: int | None = None) -> StreamingQuery:
    """ST2: insert-if-absent of every micro-batch into the parquet corpus at ``corpus_path``."""
    checkpoint = checkpoint or work_path(spark, "stream-ingest-ckpt")
    src = _source(spark, source, schema, max_files_per_trigger)

    def each(batch: DataFrame, epoch_id: int) -> None:
        C.insert_if_absent(prepare(batch), corpus_path, id_col=id_col, order_col=order_col)

    w = src.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="10 seconds")
    return w.start()


def run_to_end(q: StreamingQuery) -> None:
    """Block until an ``availableNow`` stream has drained its source; re-raise its failure."""
    q.awaitTermination()
    if q.exception() is not None:
        raise RuntimeError(str(q.exception()))


def read_sink(spark: SparkSession, sink: str) -> DataFrame:
    """All epochs written by :func:`question_stream` (the partition column is dropped)."""
    return spark.read.parquet(sink).drop("epoch")
