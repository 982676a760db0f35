"""Fill-in-middle transformation with a piece table.

A document is never edited: it is a list of descriptors ``(buffer, start,
length)`` over two immutable buffers, the text and the sentinels ``<P><S><M>``.

* cutting splits the descriptor that covers an offset;
* an arrangement permutes the three descriptors of the text and puts a
  sentinel's descriptor before each: psm is ``<P>`` prefix ``<S>`` suffix
  ``<M>`` middle, spm is ``<S>`` suffix ``<P>`` prefix ``<M>`` middle;
* the inverse permutation restores the text. It starts from the output and
  the form alone: the output becomes the text buffer of a new table, is cut at
  its sentinels, loses them and is permuted back;
* hashes run over the descriptors, piece by piece.

The cuts and the form come from four numbers, the 8-digit groups of the hex
SHA-256 of ``1:`` and the decimal doc_id. A text that is empty or holds a
sentinel stays plain, so the sentinels of an output are its own.

Every document is handled by itself in one Arrow batch of a scan: no shuffle,
no state, and a lost task is run again with the same result.

Defined cases: a null text is an empty one; a null doc_id counts as an empty
decimal; repeated rows give equal rows; an empty table gives an empty result;
other columns of the input are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read_documents

#: Fixed values of the contract: sentinels, and the shares (of 100) of documents
#: that are transformed and of transformed ones whose suffix comes first.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
MARKS = PREFIX + SUFFIX + MIDDLE
FIM_SHARE, SPM_SHARE = 90, 20

TEXT_BUFFER, MARK_BUFFER = 0, 1
#: Parts of the text in the order of the output, with the sentinel before each.
ARRANGEMENTS = {"psm": ((PREFIX, 0), (SUFFIX, 2), (MIDDLE, 1)),
                "spm": ((SUFFIX, 2), (PREFIX, 0), (MIDDLE, 1))}


class Piece(NamedTuple):
    buffer: int
    start: int
    length: int


class PieceTable:
    """Descriptors over a text and the sentinels; the buffers are shared and never change."""

    def __init__(self, text: str, pieces: Sequence[Piece] | None = None):
        self.buffers = (text, MARKS)
        self.pieces = list(pieces) if pieces is not None else [Piece(TEXT_BUFFER, 0, len(text))]

    def cut(self, offset: int) -> None:
        """Split the descriptor that covers ``offset``; a cut at an end leaves an empty one."""
        at = 0
        for i, p in enumerate(self.pieces):
            if at <= offset <= at + p.length:
                left = offset - at
                self.pieces[i:i + 1] = [p._replace(length=left),
                                        p._replace(start=p.start + left, length=p.length - left)]
                return
            at += p.length
        raise ValueError(f"offset {offset} is outside of the table")

    def arranged(self, form: str) -> PieceTable:
        """The three pieces of a text, permuted behind their sentinels."""
        out = []
        for mark, part in ARRANGEMENTS[form]:
            out += [Piece(MARK_BUFFER, MARKS.index(mark), len(mark)), self.pieces[part]]
        return PieceTable(self.buffers[TEXT_BUFFER], out)

    def stream(self) -> Iterator[str]:
        for buffer, start, length in self.pieces:
            yield self.buffers[buffer][start:start + length]

    def text(self) -> str:
        return "".join(self.stream())

    def sha256(self) -> str:
        digest = hashlib.sha256()
        for part in self.stream():
            digest.update(part.encode())
        return digest.hexdigest()


def draws(doc_id: int | None) -> tuple[int, ...]:
    """The four numbers that decide the cuts and the form."""
    digits = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return tuple(int(digits[8 * i:8 * i + 8], 16) for i in range(4))


def transform(doc_id: int | None, text: str) -> tuple[PieceTable, str, int | None, int | None]:
    """``(table of the output, form, prefix length, middle length)``."""
    table, (h1, h2, h3, h4) = PieceTable(text), draws(doc_id)
    if not text or h3 % 100 >= FIM_SHARE or any(mark in text for mark in (PREFIX, SUFFIX, MIDDLE)):
        return table, "plain", None, None
    first, second = sorted((h1 % (len(text) + 1), h2 % (len(text) + 1)))
    table.cut(second)
    table.cut(first)
    form = "spm" if h4 % 100 < SPM_SHARE else "psm"
    return table.arranged(form), form, first, second - first


def restore(output: str, form: str) -> PieceTable:
    """The table of the original text, over the output's own characters."""
    if form == "plain":
        return PieceTable(output)
    parts: list[Piece | None] = [None] * len(ARRANGEMENTS[form])
    starts = [output.index(mark) for mark, _ in ARRANGEMENTS[form]] + [len(output)]
    for (mark, part), start, end in zip(ARRANGEMENTS[form], starts, starts[1:], strict=False):
        parts[part] = Piece(TEXT_BUFFER, start + len(mark), end - start - len(mark))
    return PieceTable(output, parts)


def fill_in_middle(docs: DataFrame) -> DataFrame:
    """``(doc_id, n, form, prefix_chars, middle_chars, output, output_sha256)`` of every row of ``docs(doc_id, text)``."""
    def run(batches):
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                table, *how = transform(doc_id, text or "")
                rows.append((len(text or ""), *how, table.text(), table.sha256()))
            n, form, prefix, middle, output, digest = zip(*rows, strict=True) if rows else [[]] * 6
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(form, pa.string()), pa.array(prefix, pa.int64()),
                 pa.array(middle, pa.int64()), pa.array(output, pa.string()), pa.array(digest, pa.string())],
                names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output", "output_sha256"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        run, "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string, "
             "output_sha256 string")


def restored(outputs: DataFrame, keep: Sequence[str], with_text: bool = True) -> DataFrame:
    """``keep`` columns, ``restored_sha256`` and, if asked for, the ``restored`` text of ``outputs(output, form)``."""
    kept = outputs.select(*keep)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields)

    def run(batches):
        for batch in batches:
            tables = [restore(o, f) for o, f in
                      zip(batch.column("__output").to_pylist(), batch.column("__form").to_pylist(), strict=True)]
            cols = [batch.column(i) for i in range(len(keep))]
            cols.append(pa.array([t.sha256() for t in tables], pa.string()))
            if with_text:
                cols.append(pa.array([t.text() for t in tables], pa.string()))
            yield pa.RecordBatch.from_arrays(cols, names=[*keep, "restored_sha256", *["restored"] * with_text])

    return outputs.select(*keep, F.col("output").alias("__output"), F.col("form").alias("__form")) \
        .mapInArrow(run, f"{schema}, restored_sha256 string" + ", restored string" * with_text)


def op11_fim(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Output and restored text of every document, as digests."""
    made = fill_in_middle(read_documents(spark, sf_dir))
    return restored(made, ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256"], with_text=False)


SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS s
           FROM documents),
h AS (SELECT doc_id, t, length(t) AS n, CAST('0x' || s[1:8] AS BIGINT) AS h1, CAST('0x' || s[9:16] AS BIGINT) AS h2,
             CAST('0x' || s[17:24] AS BIGINT) AS h3, CAST('0x' || s[25:32] AS BIGINT) AS h4 FROM d),
c AS (SELECT doc_id, t, n, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
             CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90
                  THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM h),
p AS (SELECT *, substring(t, 1, a) AS x, substring(t, a + 1, b - a) AS m, substring(t, b + 1) AS y FROM c)
SELECT doc_id, CAST(n AS BIGINT) AS n, form,
       CASE WHEN form <> 'plain' THEN CAST(a AS BIGINT) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN CAST(b - a AS BIGINT) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || x || '<S>' || y || '<M>' || m
              ELSE '<S>' || y || '<P>' || x || '<M>' || m END) AS output_sha256,
       sha256(t) AS restored_sha256 FROM p
"""
