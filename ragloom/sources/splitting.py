"""Large JSON arrays and quoted CSV files read by byte ranges.

Spark's ``multiLine`` readers take a file in one task, because a byte in the
middle of a file may lie inside a string. Here a file is cut at every ``}``
(JSON) or newline (CSV) by Spark's text reader, which deals byte ranges of one
file over tasks and works on any file system that Spark reads. Two passes:

1. every range is summarised in one row: how many quotes it has, and what it
   does to the nesting depth if it starts outside or inside a string. A running
   sum over the ranges of a file gives the state at the start of each;
2. knowing its state, a range puts its pieces together to records. What lies
   before its first record's end and behind its last one is a fragment; the
   fragments of a file, at most two per range, are joined in order.

Records are then parsed by ``from_json`` / ``from_csv`` with explicit schemas;
malformed records, truncated arrays and text that isn't an array raise.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Ranges whose states are broadcast (about 100 bytes each); more are joined by a shuffle.
MAX_BROADCAST_RANGES = 500_000
BOM = "﻿"


def _pieces(spark: SparkSession, path: str, separator: str) -> DataFrame:
    """``(file, start, value)``: the pieces of every byte range, in order within a range."""
    return spark.read.option("lineSep", separator).text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), "value")


def _ranges(batches) -> Iterator[tuple[str, int, list[str], bool]]:
    """``(file, start, pieces, first)`` of consecutive pieces of one range; ``first`` at the start of a range."""
    last = None
    for batch in batches:
        files, starts, values = (batch.column(i).to_pylist() for i in range(3))
        at = 0
        while at < len(values):
            to = at
            while to < len(values) and files[to] == files[at] and starts[to] == starts[at]:
                to += 1
            key = (files[at], starts[at])
            yield *key, [v or "" for v in values[at:to]], key != last
            last, at = key, to


# ---------------------------------------------------------------------------
# what a piece does to the state
# ---------------------------------------------------------------------------

def json_effect(piece: str) -> tuple[int, int, int]:
    """Quotes of a piece, and its change of depth if it starts outside or inside a string (without the ``}`` behind it)."""
    if "\\" in piece:
        piece = piece.replace("\\\\", "").replace('\\"', "")
    parts = piece.split('"')
    outside, inside = "".join(parts[::2]), "".join(parts[1::2])
    return len(parts) - 1, *(x.count("{") + x.count("[") - x.count("]") for x in (outside, inside))


def _json_summary(batches) -> Iterator[pa.RecordBatch]:
    rows: dict[tuple[str, int], list[int]] = {}
    for file, start, pieces, _ in _ranges(batches):
        state = rows.setdefault((file, start), [0, 0, 0])
        for piece in pieces:
            quotes, *deltas = json_effect(piece)
            for s in (0, 1):
                # which of the two cases applies depends on the quotes before the piece in the range
                state[1 + s] += deltas[(s + state[0]) % 2] - ((s + state[0] + quotes) % 2 == 0)
            state[0] += quotes
    yield pa.RecordBatch.from_pydict({
        "file": pa.array([k[0] for k in rows], pa.string()), "start": pa.array([k[1] for k in rows], pa.int64()),
        **{c: pa.array([v[i] for v in rows.values()], pa.int64()) for i, c in enumerate(("quotes", "depth_out", "depth_in"))}})


def _csv_summary(batches) -> Iterator[pa.RecordBatch]:
    rows: dict[tuple[str, int], int] = {}
    for file, start, pieces, _ in _ranges(batches):
        rows[file, start] = rows.get((file, start), 0) + sum(p.count('"') for p in pieces)
    yield pa.RecordBatch.from_pydict({
        "file": pa.array([k[0] for k in rows], pa.string()), "start": pa.array([k[1] for k in rows], pa.int64()),
        "quotes": pa.array(list(rows.values()), pa.int64())})


# ---------------------------------------------------------------------------
# records
# ---------------------------------------------------------------------------

class _JsonRecords:
    """Puts the pieces of one range together; ``open`` tells whether a record is unfinished."""

    separator = "}"

    def __init__(self, in_string: int, depth: int):
        self.in_string, self.depth = in_string, depth
        self.open = depth > 1 or bool(in_string)

    def ends(self, piece: str) -> bool:
        """Take a piece; whether a record ends with the ``}`` behind it."""
        quotes, *deltas = json_effect(piece)
        self.depth += deltas[self.in_string]
        self.in_string = (self.in_string + quotes) % 2
        if self.in_string:
            self.open = True
            return False
        self.depth -= 1
        self.open = self.depth > 1
        return self.depth == 1


class _CsvRecords:
    separator = "\n"

    def __init__(self, in_string: int, depth: int):
        self.in_string = in_string
        self.open = bool(in_string)

    def ends(self, piece: str) -> bool:
        self.in_string = (self.in_string + piece.count('"')) % 2
        self.open = bool(self.in_string)
        return not self.open


#: A whole record, one that goes on in the next range, one that began before, and a range without an end.
WHOLE, HEAD, TAIL, MIDDLE = range(4)
_RECORDS = "file string, start long, kind int, record string"


def _assemble(kind):
    def run(batches):
        key, reader, held, began = None, None, [], False
        out: list[tuple] = []

        def close():
            # what is left of a range: the head of a record, or the middle of one that began before it
            if reader is not None and held:
                text = reader.separator.join(held) + reader.separator
                if began:
                    out.append((*key, MIDDLE, text))
                elif reader.open:
                    out.append((*key, HEAD, text))

        def flush():
            cols = list(zip(*out, strict=True)) or [[]] * 4
            out.clear()
            return pa.RecordBatch.from_arrays(
                [pa.array(cols[0], pa.string()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int32()),
                 pa.array(cols[3], pa.string())], names=["file", "start", "kind", "record"])

        for batch in batches:
            states = batch.column(3).to_pylist(), batch.column(4).to_pylist()
            at = 0
            for file, start, pieces, _ in _ranges([batch]):
                if (file, start) != key:
                    close()
                    key, held = (file, start), []
                    reader = kind(states[0][at], states[1][at])
                    began = reader.open
                for piece in pieces:
                    held.append(piece)
                    if reader.ends(piece):
                        out.append((*key, TAIL if began else WHOLE, reader.separator.join(held) + reader.separator))
                        held, began = [], False
                at += len(pieces)
            yield flush()
        close()
        yield flush()

    return run


def _records(pieces: DataFrame, states: DataFrame, kind) -> DataFrame:
    """``(record)`` of all files; fragments of ranges are joined in file order."""
    states = F.broadcast(states) if states.count() <= MAX_BROADCAST_RANGES else states
    found = pieces.join(states, ["file", "start"]).select("file", "start", "value", "in_string", "depth") \
        .mapInArrow(_assemble(kind), _RECORDS)
    whole = found.where(F.col("kind") == WHOLE).select("file", "record")
    parts = found.where(F.col("kind") != WHOLE)
    # a range sends at most a tail (or middle) and a head; a head begins a record
    order = Window.partitionBy("file").orderBy("start", F.when(F.col("kind") == HEAD, 1).otherwise(0))
    joined = parts.withColumn("nth", F.sum(F.when(F.col("kind") == HEAD, 1).otherwise(0)).over(order)).groupBy("file", "nth").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(
            "start", F.when(F.col("kind") == HEAD, 1).otherwise(0).alias("head"), "record"))), lambda x: x["record"]), "").alias("record"))
    return whole.unionByName(joined.select("file", "record"))


def _start_states(summary: DataFrame) -> DataFrame:
    """``(file, start, in_string)`` of every range with the columns of the summary."""
    before = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    return summary.withColumn("in_string", (F.coalesce(F.sum("quotes").over(before), F.lit(0)) % 2).cast("long"))


def read_json_array(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The objects of one JSON array per file, with ``schema``."""
    from ..session import cut_lineage
    pieces = _pieces(spark, path, "}")
    own = Window.partitionBy("file").orderBy("start")
    summary = _start_states(pieces.mapInArrow(
        _json_summary, "file string, start long, quotes long, depth_out long, depth_in long"))
    change = F.when(F.col("in_string") == 1, F.col("depth_in")).otherwise(F.col("depth_out"))
    states = cut_lineage(summary.withColumn("change", change).withColumn(
        "depth", F.coalesce(F.sum("change").over(own.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))))
    # a whole array ends at depth 0, and the last piece has no "}" behind it
    bad = states.groupBy("file").agg((F.sum("quotes") % 2).alias("open"), F.sum("change").alias("depth")) \
        .where("open <> 0 or depth <> -1").select("file").first()
    if bad is not None:
        raise ValueError(f"not a whole JSON array: {bad['file']}")
    records = _records(pieces, states.select("file", "start", "in_string", "depth"), _JsonRecords)
    text = F.regexp_replace("record", r"^[\s,\[﻿]+", "")
    return records.select(F.from_json(text, schema, {"mode": "FAILFAST"}).alias("r")).select("r.*")


def read_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Rows of CSV files with a header, quoted newlines and doubled quotes; an empty field is null."""
    from ..session import cut_lineage
    pieces = _pieces(spark, path, "\n")
    states = cut_lineage(_start_states(pieces.mapInArrow(_csv_summary, "file string, start long, quotes long"))
                         .select("file", "start", "in_string", F.lit(0).cast("long").alias("depth"), "quotes"))
    bad = states.groupBy("file").agg((F.sum("quotes") % 2).alias("open")).where("open <> 0").select("file").first()
    if bad is not None:
        raise ValueError(f"a quoted field doesn't end: {bad['file']}")
    records = _records(pieces, states.drop("quotes"), _CsvRecords)
    # the header is one record per file: it names the columns
    names = ",".join(schema.names)
    text = F.regexp_replace(F.regexp_replace("record", "\r?\n$", ""), f"^{BOM}", "")
    quoted = ",".join(f'"{n}"' for n in schema.names)
    rows = records.select(text.alias("record")).where(~F.col("record").isin(names, quoted, ""))
    options = {"mode": "FAILFAST", "escape": '"', "quote": '"', "multiLine": "true"}
    return rows.select(F.from_csv("record", schema.simpleString()[7:-1].replace(":", " "), options).alias("r")).select("r.*")


def write_json_array(df: DataFrame, path: str) -> None:
    """One JSON array in one file (written by one task, as a file of this form has to be).

    The rows are computed by many tasks and checkpointed; the writing task only copies them, batch by batch.
    """
    from ..session import cut_lineage

    def lines(batches):
        first = True
        for batch in batches:
            rows = batch.column(0).to_pylist()
            if rows:
                yield pa.RecordBatch.from_pydict({"value": [("[" if first and not i else ",") + r for i, r in enumerate(rows)]})
                first = False
        yield pa.RecordBatch.from_pydict({"value": ["[]" if first else "]"]})

    rows = cut_lineage(df.select(F.to_json(F.struct(*df.columns)).alias("value")))
    rows.coalesce(1).mapInArrow(lines, "value string").write.option("lineSep", " ").text(path)
