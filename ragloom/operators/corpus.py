"""Corpus ingest: defaults, positional ids, contract, insert-if-absent, report
(P02, P03, K02-K06).

Scale notes
-----------
* Positional ids never use an unpartitioned window over the data: rows are
  range-partitioned on the (unique) order key, numbered inside each partition,
  and shifted by per-partition offsets. The offsets come from one eager count
  per partition (one row per partition, bounded by the partition count, so
  they may be broadcast), so later executions never re-count the rows.
* "First row per id wins" is a hash aggregate of narrow keys with a map-side
  partial step, so an id that holds a third of the load collapses to few rows
  per task before the shuffle instead of landing in one task; whole rows are
  fetched once the winners that are not in the corpus yet are known.
* The anti join never shuffles the corpus when the load's ids fit a checked
  broadcast (semi-join reduction); beyond that bound it shuffles only narrow
  id columns.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..session import cut_lineage
from ..sources.sizing import scan_tasks

_LOCAL_BITS = 33  # monotonically_increasing_id = partition index << 33 | row in partition


def fill_output(df: DataFrame, col: str = "output") -> DataFrame:
    """A missing answer becomes the empty string."""
    return df.withColumn(col, F.coalesce(F.col(col), F.lit("")))


def positional_index(df: DataFrame, order_cols: list[str], index_col: str = "pos",
                     num_partitions: int | None = None) -> DataFrame:
    """Contiguous 0-based index in ``order_cols`` order (the key must be unique).

    The range partitions number at least ``spark.sql.shuffle.partitions`` and
    about one per ``spark.sql.files.maxPartitionBytes`` of input, so each
    sorted range stays the size of a scan task however large the input is.
    """
    spark = df.sparkSession
    n = num_partitions or max(int(spark.conf.get("spark.sql.shuffle.partitions")), scan_tasks(df) or 0)
    ranged = (df.repartitionByRange(n, *order_cols)
              .sortWithinPartitions(*order_cols)
              .withColumn("_mid", F.monotonically_increasing_id()))
    # fix the partition assignment once: the offsets below must describe these exact rows
    ranged = cut_lineage(ranged)
    ranged = (ranged.withColumn("_p", F.shiftright("_mid", _LOCAL_BITS))
              .withColumn("_l", F.col("_mid").bitwiseAND(F.lit((1 << _LOCAL_BITS) - 1))))
    # rows per partition, counted once now (as RDD.zipWithIndex does): one row per
    # partition reaches the driver, a bound set by the partition count, not the data
    counts = dict(ranged.groupBy("_p").agg(F.count(F.lit(1)).alias("_n")).collect())
    offsets, acc = [], 0
    for p in sorted(counts):
        offsets.append((p, acc))
        acc += counts[p]
    offsets = spark.createDataFrame(offsets, "_p long, _off long")
    return (ranged.join(F.broadcast(offsets), "_p")
            .withColumn(index_col, F.col("_off") + F.col("_l"))
            .drop("_mid", "_p", "_l", "_off"))


def positional_ids(df: DataFrame, order_cols: list[str], id_col: str = "id",
                   prefix: str = "q_") -> DataFrame:
    """Ids ``q_0 .. q_{n-1}`` in order."""
    out = positional_index(df, order_cols, "_pos")
    return out.withColumn(id_col, F.concat(F.lit(prefix), F.col("_pos").cast("string"))).drop("_pos")


def contract_report(corpus: DataFrame, dim: int, id_col: str = "id",
                    vec_col: str = "embedding") -> DataFrame:
    """One row of violation counts for the corpus contract.

    ``id`` not null and unique, vector not null, ``size = dim``, no null / NaN /
    infinite element. One pass: per-id partial aggregation, then a global sum.
    """
    v = F.col(vec_col)
    per_id = corpus.groupBy(id_col).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.when(v.isNull(), 1).otherwise(0)).alias("null_vec"),
        F.sum(F.when(v.isNotNull() & ~V.dimension_ok(v, dim), 1).otherwise(0)).alias("wrong_dim"),
        F.sum(F.when(v.isNotNull() & V.has_bad_element(v), 1).otherwise(0)).alias("bad_elem"))
    idn = F.col(id_col).isNull()
    return per_id.agg(
        F.sum("n").cast("long").alias("rows"),
        F.coalesce(F.sum(F.when(idn, F.col("n"))), F.lit(0)).cast("long").alias("null_id"),
        F.coalesce(F.sum(F.when(~idn & (F.col("n") > 1), F.col("n") - 1)), F.lit(0))
         .cast("long").alias("duplicate_id"),
        F.coalesce(F.sum("wrong_dim"), F.lit(0)).cast("long").alias("wrong_dim"),
        F.coalesce(F.sum("null_vec"), F.lit(0)).cast("long").alias("null_vector"),
        F.coalesce(F.sum("bad_elem"), F.lit(0)).cast("long").alias("bad_element"))


def assert_contract(corpus: DataFrame, dim: int, **kw) -> dict:
    """Raise ``ValueError`` when the corpus breaks its contract; returns the counts."""
    row = contract_report(corpus, dim, **kw).first().asDict()
    bad = {k: v for k, v in row.items() if k != "rows" and v}
    if bad:
        raise ValueError(f"corpus contract violated: {bad}")
    return row


def _winner_keys(load: DataFrame, id_col: str, order_col: str) -> DataFrame:
    """``(_id, _null, _order, _row, _times)``: of each id the key of its first row, and how often that row occurs.

    The order is total: the order column (nulls last), then a hash of the whole
    row. Only these narrow keys are aggregated: first equal rows, which spreads a
    hot id, then ids, which collapses it to one row per task.
    """
    row = F.xxhash64(*[F.col(f"`{c}`") for c in sorted(load.columns)])
    keys = load.select(F.col(id_col).alias("_id"), F.col(order_col).isNull().alias("_null"), F.col(order_col).alias("_order"),
                       row.alias("_row"))
    times = keys.groupBy("_id", "_null", "_order", "_row").agg(F.count(F.lit(1)).alias("_times"))
    first = times.groupBy("_id").agg(F.min(F.struct("_null", "_order", "_row", "_times")).alias("k"))
    return first.select("_id", "k._null", "k._order", "k._row", "k._times")


def _winners(load: DataFrame, id_col: str, order_col: str) -> DataFrame:
    """:func:`_winner_keys`, computed once."""
    return cut_lineage(_winner_keys(load, id_col, order_col))


def _rows_of(load: DataFrame, winners: DataFrame, id_col: str, order_col: str) -> DataFrame:
    """The rows of ``load`` that ``winners`` names, each once."""
    row = F.xxhash64(*[F.col(f"`{c}`") for c in sorted(load.columns)])
    n, size, times = winners.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length(F.col("_id").cast("string"))), F.lit(0)),
                                 F.max("_times")).first()
    names = F.broadcast(winners) if n <= MAX_BROADCAST_IDS and size + 40 * n <= MAX_BROADCAST_ID_BYTES else winners
    here = load.withColumn("_here", row)
    found = here.join(names, here[id_col].eqNullSafe(names["_id"]) & here[order_col].eqNullSafe(names["_order"])
                      & (here["_here"] == names["_row"]))
    once = found.where(F.col("_times") == 1).select(*load.columns)
    if (times or 1) == 1:
        return once
    # rows that are equal in every column: one of them
    return once.unionByName(found.where(F.col("_times") > 1).dropDuplicates(["_id"]).select(*load.columns))


def first_per_id(load: DataFrame, id_col: str = "id", order_col: str = "load_seq") -> DataFrame:
    """K03 (M4): one row per id, the first in load order, also inside one load.

    Null orders come last, equal orders are decided by a hash of the row, equal
    rows count once; a null id is an id like any other.
    """
    return _rows_of(load, _winners(load, id_col, order_col), id_col, order_col)


MAX_BROADCAST_IDS = 2_000_000
MAX_BROADCAST_ID_BYTES = 128 << 20


def rows_to_insert(load: DataFrame, corpus_ids: DataFrame, id_col: str = "id",
                   order_col: str = "load_seq", max_broadcast_ids: int = MAX_BROADCAST_IDS,
                   max_broadcast_bytes: int = MAX_BROADCAST_ID_BYTES) -> DataFrame:
    """``INSERT ... ON CONFLICT (id) DO NOTHING`` as first-per-id + left anti join.

    Everything is decided on narrow keys: the winners of the load are found and
    anti-joined with the corpus before any other column is read; the rows that
    remain are fetched last. When the load's distinct ids are checked to fit a
    broadcast, the corpus is never shuffled: its id column is scanned against
    the broadcast load ids (semi join), and the winners are anti-joined with
    that small present set. Otherwise both id columns are shuffled.
    """
    winners = _winners(load, id_col, order_col)
    ids = winners.select(F.col("_id").alias(id_col))
    present = present_ids(ids, corpus_ids, id_col, max_broadcast_ids, max_broadcast_bytes)
    known = F.broadcast(present) if present is not None else corpus_ids.select(id_col)
    new = cut_lineage(winners.join(known, F.col("_id") == known[id_col], "left_anti"))
    return _rows_of(load, new, id_col, order_col)


def present_ids(load_ids: DataFrame, corpus_ids: DataFrame, id_col: str = "id",
                max_broadcast_ids: int = MAX_BROADCAST_IDS,
                max_broadcast_bytes: int = MAX_BROADCAST_ID_BYTES) -> DataFrame | None:
    """Ids of ``load_ids`` (distinct) already in the corpus, found without shuffling the corpus.

    Returns None when the load's ids exceed the checked broadcast bound (count
    and bytes, measured with one aggregate); the caller then joins by shuffle.
    The result is a subset of the load ids, so it fits a broadcast too.
    """
    size = load_ids.agg(F.count(F.lit(1)).alias("n"),
                        F.coalesce(F.sum(F.octet_length(F.col(id_col).cast("string"))), F.lit(0))
                        .alias("b")).first()
    if size.n > max_broadcast_ids or size.b + 16 * size.n > max_broadcast_bytes:
        return None
    # partial aggregation: repeated corpus ids don't grow the result
    return corpus_ids.select(id_col).join(F.broadcast(load_ids), id_col, "left_semi").distinct()


def read_ids(spark, corpus_path: str, schema) -> DataFrame:
    """The id column of the corpus; empty only if there is no such path, any other error is raised."""
    try:
        return spark.read.parquet(corpus_path).select(schema.names[0])
    except AnalysisException as exc:
        if exc.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def insert_if_absent(load: DataFrame, corpus_path: str, id_col: str = "id",
                     order_col: str = "load_seq", columns: list[str] | None = None) -> None:
    """Append the new rows to the parquet corpus at ``corpus_path`` (single writer)."""
    spark = load.sparkSession
    existing = read_ids(spark, corpus_path, load.select(id_col).schema)
    new = rows_to_insert(load, existing, id_col, order_col)
    cols = columns or [c for c in load.columns if c != order_col]
    # materialise before the write: the corpus being read is also the target
    new = cut_lineage(new.select(*cols))
    new.write.mode("append").parquet(corpus_path)


def load_report(load: DataFrame, corpus_ids: DataFrame, id_col: str = "id") -> DataFrame:
    """``attempted, distinct_ids, already_present, inserted`` in one row."""
    per_id = load.groupBy(id_col).agg(F.count(F.lit(1)).alias("n"))
    present = present_ids(per_id.select(id_col), corpus_ids, id_col)
    hits = (F.broadcast(present) if present is not None else corpus_ids.select(id_col).distinct())
    marked = per_id.join(hits.withColumn("_hit", F.lit(1)), id_col, "left")
    return marked.agg(
        F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("attempted"),
        F.count(F.lit(1)).cast("long").alias("distinct_ids"),
        F.count("_hit").cast("long").alias("already_present"),
        (F.count(F.lit(1)) - F.count("_hit")).cast("long").alias("inserted"))


def content_id(text: Column | str, prefix: str = "d_") -> Column:
    """Content-hash id used by ``add_documents`` so that re-adding is idempotent."""
    t = F.col(text) if isinstance(text, str) else text
    return F.concat(F.lit(prefix), F.md5(t))
