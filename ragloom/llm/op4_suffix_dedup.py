"""Suffix-array removal of repeated byte strings, built block by block with a difference cover.

A byte goes if a 100-byte string that covers it also starts earlier (smaller
doc_id, or the same document and an earlier start). Sorting every suffix of a
corpus is not needed for that: only strings that occur twice matter.

1. Anchors. Of the ``GRAM``-byte strings inside a 100-byte window the one with
   the smallest hash is the window's anchor. Equal windows have equal anchors
   at equal offsets, and neighbouring windows mostly share one, so a text has
   few anchors (about one per 37 bytes). Each stands for a run of windows and
   the bytes that they span, its context.
2. Anchors are dealt by hash; those that occur once go. Occurrences with equal
   contexts match window by window: the first one stays for all of them, so a
   passage copied a million times is judged once.
3. Where the contexts of an anchor differ, the suffixes of its distinct
   contexts are sorted. Buckets (anchors) are sorted one block at a time: by
   the first ``COVER`` bytes, ties by the ranks of difference-cover samples.
   For any two suffixes some offset below ``COVER`` puts both on sample
   positions, so a tie of any length takes one rank comparison. The sample
   ranks of a block are made beforehand by doubling. Equal windows are
   neighbours in that order; the first in document order stays.
4. The runs of repeated windows of each document are merged and cut out.

Texts meet the runs by one join on the document; contexts by another. Blocks
bound the memory of a task. An anchor with more than ``BUCKET`` distinct
contexts is not sorted by suffixes: its windows are dealt one by one by a
128-bit hash of their bytes, without the bytes, and equal hashes are read in
document order, of which only the first is held.

Defined cases: null and empty texts have no bytes and lose none; texts under
100 bytes stay whole; identical rows (same doc_id and text) are one document
twice and don't repeat each other; rows with one doc_id and different texts
are compared by start; a null doc_id comes before all others; empty tables
give empty results; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, read_documents

LENGTH = 100
GRAM = 28
COVER = 16
#: Bytes hashed at a time, and bytes of contexts sorted at a time.
CHUNK = 1 << 18
BLOCK = 1 << 20
BUCKET = 20_000
NO_ID = -(1 << 63)

_MASK = (1 << 64) - 1
_BASE = 0x9E3779B97F4A7C15 | 1
_BYTE_VALUES = np.array([pow(0xD6E8FEB86659FD93, i + 1, 1 << 64) ^ (i * 0x632BE59BD9B4E019 & _MASK)
                         for i in range(256)], np.uint64)
#: Values of a second hash.
_OTHER_VALUES = np.array([pow(0xBF58476D1CE4E5B9, i + 1, 1 << 64) ^ (i * 0x94D049BB133111EB & _MASK)
                          for i in range(256)], np.uint64)


def _powers(base: int, n: int) -> np.ndarray:
    return np.multiply.accumulate(np.r_[np.uint64(1), np.full(n, base, np.uint64)])


_TABLES: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, for at least n bytes."""
    size = 1 << max(18, n.bit_length())
    if size not in _TABLES:
        _TABLES.clear()
        _TABLES[size] = (_powers(_BASE, size), _powers(pow(_BASE, -1, 1 << 64), size))
    return _TABLES[size]


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def anchors(text: np.ndarray, ends: np.ndarray, length: int = LENGTH, gram: int = GRAM):
    """Anchors of all windows of a concatenation of documents.

    ``ends`` is, per byte, the end of its document. Returns arrays ``lo, hi``
    (first and last window start), ``at`` (anchor position), the anchor's hash
    and the context's.
    """
    n = len(text)
    none = np.zeros(0, np.int64)
    if n < length:
        return none, none, none, none.astype(np.uint64), none.astype(np.uint64)
    power, inverse = _tables(n)
    sums = np.r_[np.uint64(0), np.cumsum(_BYTE_VALUES[text] * power[:n], dtype=np.uint64)]

    def content(lo, hi):
        return _mix((sums[hi] - sums[lo]) * inverse[lo])

    grams = np.arange(n - gram + 1)
    small = (_mix((sums[gram:] - sums[:n - gram + 1]) * inverse[:n - gram + 1]) >> np.uint64(24) << np.uint64(24)) \
        | (grams.astype(np.uint64) & np.uint64(0xFFFFFF))
    width, reach = length - gram + 1, 1
    while 2 * reach <= width:
        small = np.minimum(small[:-reach], small[reach:])
        reach *= 2
    if reach < width:
        small = np.minimum(small[:len(small) - (width - reach)], small[width - reach:])
    starts = np.arange(n - length + 1)
    offset = ((small & np.uint64(0xFFFFFF)).astype(np.int64) - starts) & 0xFFFFFF
    where = starts + offset
    valid = starts + length <= ends[:len(starts)]
    new = np.r_[True, (where[1:] != where[:-1]) | (valid[1:] != valid[:-1])]
    lo = np.flatnonzero(new)
    hi = np.r_[lo[1:], len(starts)] - 1
    keep = valid[lo]
    lo, hi = lo[keep], hi[keep]
    at = where[lo]
    shape = ((at - lo) * length + (hi - lo)).astype(np.uint64)
    return lo, hi, at, content(at, at + gram), _mix(content(lo, hi + length) + shape)


def window_keys(text: np.ndarray, starts: np.ndarray, length: int = LENGTH) -> list[np.ndarray]:
    """Two independent hashes of the windows at ``starts``."""
    n = len(text)
    power, inverse = _tables(n)
    keys = []
    for values in (_BYTE_VALUES, _OTHER_VALUES):
        sums = np.r_[np.uint64(0), np.cumsum(values[text] * power[:n], dtype=np.uint64)]
        keys.append(_mix((sums[starts + length] - sums[starts]) * inverse[starts]).view(np.int64))
    return keys


def cover(size: int) -> np.ndarray:
    """A difference cover: the first root(size) residues and the multiples of that root."""
    root = next(r for r in range(1, size + 1) if r * r >= size)
    return np.array(sorted({*range(min(root, size)), *range(0, size, root)}))


def shift_table(size: int, samples: np.ndarray) -> np.ndarray:
    """For residues a, b the smallest shift that puts both into the cover."""
    inside = np.isin(np.arange(size), samples)
    table = np.zeros((size, size), np.int64)
    for a in range(size):
        for b in range(size):
            table[a, b] = next(d for d in range(size) if inside[(a + d) % size] and inside[(b + d) % size])
    return table


_SAMPLES = cover(COVER)
_SHIFT = shift_table(COVER, _SAMPLES)


def _words(text: np.ndarray) -> np.ndarray:
    """Big-endian number of the 8 bytes at every position (zeros behind the end)."""
    padded = np.r_[text, np.zeros(8, np.uint8)].astype(np.uint64)
    out = np.zeros(len(text), np.uint64)
    for i in range(8):
        out = (out << np.uint64(8)) | padded[i:len(text) + i]
    return out


def _dense(*keys: np.ndarray) -> np.ndarray:
    """Rank (from 0, ties equal) of rows by the keys, first key first."""
    order = np.lexsort(keys[::-1])
    new = np.zeros(len(order), bool)
    for k in keys:
        s = k[order]
        new[1:] |= s[1:] != s[:-1]
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(new)
    return out


def sort_suffixes(text: np.ndarray, starts: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """Order of the suffixes at ``starts`` by at least ``length`` bytes, and which equal their predecessor to that depth.

    Difference-cover samples get ranks by doubling; suffixes are sorted by
    their first ``COVER`` bytes; ties are split around pivots, all tie groups
    at a time, each comparison by the ranks at a shift that puts both suffixes
    on samples.
    """
    n = len(text)
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(0, bool)
    word = np.r_[_words(text), np.zeros(COVER, np.uint64)]
    sample = np.flatnonzero(np.isin(np.arange(n) % COVER, _SAMPLES))
    rank = np.full(n + COVER + length, -1, np.int64)
    rank[sample] = _dense(word[sample], word[sample + 8])
    depth = COVER
    while depth < length:
        rank[sample] = _dense(rank[sample], rank[np.minimum(sample + depth, n + COVER)])
        depth *= 2
    order = np.lexsort((word[starts + 8], word[starts]))
    own = starts[order]
    a, b = word[own], word[own + 8]
    group = np.cumsum(np.r_[False, (a[1:] != a[:-1]) | (b[1:] != b[:-1])])
    settled_groups = group[-1] + 1
    # positions of the sorted array that are still tied with a neighbour
    active = np.flatnonzero(np.r_[False, group[1:] == group[:-1]] | np.r_[group[:-1] == group[1:], False])
    while len(active):
        seg = group[active]
        first = np.r_[True, seg[1:] != seg[:-1]]
        begin = np.flatnonzero(first)
        size = np.diff(np.r_[begin, len(active)])
        pivot = np.repeat(own[active[begin + size // 2]], size)
        mine = own[active]
        shift = _SHIFT[mine % COVER, pivot % COVER]
        cmp = np.sign(rank[mine + shift] - rank[pivot + shift])
        idx = np.arange(len(active))
        inner = np.lexsort((idx, cmp, np.cumsum(first)))
        order[active], own[active] = order[active][inner], mine[inner]
        seg_id, cmp = np.cumsum(first)[inner], cmp[inner]
        new = np.r_[True, (seg_id[1:] != seg_id[:-1]) | (cmp[1:] != cmp[:-1])]
        group[active] = settled_groups + np.cumsum(new)
        settled_groups += len(active) + 1
        sizes = np.diff(np.r_[np.flatnonzero(new), len(active)])
        active = active[(cmp != 0) & (np.repeat(sizes, sizes) > 1)]
    view = np.lib.stride_tricks.sliding_window_view(np.r_[text, np.zeros(length, np.uint8)], length)
    same = np.zeros(len(own), bool)
    near = np.flatnonzero((a[1:] == a[:-1]) & (b[1:] == b[:-1])) + 1
    for lo in range(0, len(near), 100_000):
        part = near[lo:lo + 100_000]
        same[part] = (view[own[part]] == view[own[part - 1]]).all(axis=1)
    return order, same


# ---------------------------------------------------------------------------
# Spark
# ---------------------------------------------------------------------------

def _keyed(docs: DataFrame) -> DataFrame:
    """``(doc, tk, text)``: document key, hash of the text, text as bytes."""
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc"),
                       F.xxhash64(text).alias("tk"), text.alias("text"))


ANCHORS = "doc long, tk long, gram long, context long, lo int, hi int"


def _anchor_rows(keyed: DataFrame) -> DataFrame:
    def flush(docs, tks, texts):
        sizes = np.array([len(t) for t in texts])
        last = np.cumsum(sizes)
        begin = last - sizes
        lo, hi, _, gram, context = anchors(np.frombuffer(b"".join(texts), np.uint8), np.repeat(last, sizes))
        row = np.searchsorted(last, lo, side="right")
        base = begin[row]
        return pa.RecordBatch.from_pydict({
            "doc": pa.array(np.array(docs, np.int64)[row]), "tk": pa.array(np.array(tks, np.int64)[row]),
            "gram": pa.array(gram.view(np.int64)), "context": pa.array(context.view(np.int64)),
            "lo": pa.array((lo - base).astype(np.int32)), "hi": pa.array((hi - base).astype(np.int32))})

    def run(batches):
        docs, tks, texts, held = [], [], [], 0
        for batch in batches:
            for doc, tk, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if len(text) >= LENGTH:
                    docs.append(doc)
                    tks.append(tk)
                    texts.append(text)
                    held += len(text)
                if held >= CHUNK:
                    yield flush(docs, tks, texts)
                    docs, tks, texts, held = [], [], [], 0
        if texts:
            yield flush(docs, tks, texts)

    return keyed.mapInArrow(run, ANCHORS)


CONTEXTS = "doc long, tk long, gram long, key long, second long, lo int, bytes binary"


def _window_rows(held: list[tuple]) -> pa.RecordBatch:
    """The windows of contexts ``(doc, tk, gram, lo, bytes)`` by hash, without their bytes."""
    docs, tks, grams, los, blobs = zip(*held, strict=True)
    sizes = np.array([len(b) for b in blobs])
    count = sizes - LENGTH + 1
    row = np.repeat(np.arange(len(sizes)), count)
    inside = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
    keys = window_keys(np.frombuffer(b"".join(blobs), np.uint8), (np.cumsum(sizes) - sizes)[row] + inside)
    return pa.RecordBatch.from_pydict({
        **{k: pa.array(np.array(v, np.int64)[row]) for k, v in (("doc", docs), ("tk", tks), ("gram", grams))},
        "key": pa.array(keys[0]), "second": pa.array(keys[1]),
        "lo": pa.array((np.array(los, np.int64)[row] + inside).astype(np.int32)),
        "bytes": pa.nulls(len(row), pa.binary())})


def _contexts(keyed: DataFrame, mixed: DataFrame) -> DataFrame:
    """What has to be compared: ``mixed`` rows by document, joined with the texts.

    A row is a context with its bytes or, for ``large`` anchors, one window by hash.
    """
    wanted = mixed.groupBy("doc", "tk").agg(F.collect_list(F.struct("gram", "lo", "hi", "large")).alias("rows"))
    both = keyed.join(wanted, ["doc", "tk"]).select("doc", "tk", "text", "rows").dropDuplicates(["doc", "tk"])

    def run(batches):
        for batch in batches:
            out = {k: [] for k in ("doc", "tk", "gram", "lo", "bytes")}
            windows, held = [], 0
            for doc, tk, text, rows in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for r in rows:
                    context = text[r["lo"]:r["hi"] + LENGTH]
                    if r["large"]:
                        windows.append((doc, tk, r["gram"], r["lo"], context))
                        held += len(context)
                        if held >= CHUNK // 2:
                            yield _window_rows(windows)
                            windows, held = [], 0
                        continue
                    for k, v in zip(out, (doc, tk, r["gram"], r["lo"], context), strict=True):
                        out[k].append(v)
            if windows:
                yield _window_rows(windows)
            zero = pa.array(np.zeros(len(out["doc"]), np.int64))
            yield pa.RecordBatch.from_pydict({
                **{k: pa.array(out[k], pa.int64()) for k in ("doc", "tk", "gram")}, "key": zero, "second": zero,
                "lo": pa.array(out["lo"], pa.int32()), "bytes": pa.array(out["bytes"], pa.binary())})

    return both.mapInArrow(run, CONTEXTS)


def _repeated_windows(block: list[tuple]) -> pa.RecordBatch:
    """Runs ``(doc, tk, lo, hi)`` of windows of a block of contexts that also start earlier."""
    docs, tks, los, blobs = zip(*block, strict=True)
    sizes = np.array([len(b) for b in blobs])
    begin = np.cumsum(sizes) - sizes
    text = np.frombuffer(b"".join(blobs), np.uint8)
    count = sizes - LENGTH + 1
    row = np.repeat(np.arange(len(sizes)), count)
    inside = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
    order, same = sort_suffixes(text, begin[row] + inside)
    row, inside = row[order], inside[order]
    doc, start = np.array(docs, np.int64)[row], np.array(los, np.int64)[row] + inside
    kind = np.cumsum(~same)
    by = np.lexsort((start, doc, kind))
    head = np.r_[True, kind[by][1:] != kind[by][:-1]]
    lead = by[np.flatnonzero(head)[np.cumsum(head) - 1]]
    later = (doc[by] != doc[lead]) | (start[by] != start[lead])
    hit = by[later]
    row, start = row[hit], start[hit]
    by = np.lexsort((start, row))
    row, start = row[by], start[by]
    new = np.r_[True, (row[1:] != row[:-1]) | (start[1:] != start[:-1] + 1)] if len(row) else np.zeros(0, bool)
    first = np.flatnonzero(new)
    end = np.r_[first[1:], len(row)][:len(first)] - 1
    return pa.RecordBatch.from_pydict({
        "doc": pa.array(np.array(docs, np.int64)[row[first]], pa.int64()),
        "tk": pa.array(np.array(tks, np.int64)[row[first]], pa.int64()),
        "lo": pa.array(start[first], pa.int32()), "hi": pa.array(start[end], pa.int32())})


def _sorted_buckets(contexts: DataFrame) -> DataFrame:
    """Repeated windows bucket by bucket.

    Suffixes of contexts are sorted whole buckets together in blocks of
    ``BLOCK`` bytes; windows that were dealt by hash come in document order.
    """
    dealt = contexts.repartition("gram", "key").sortWithinPartitions("gram", "key", "second", "doc", "lo") \
        .select("gram", "key", "second", "doc", "tk", "lo", "bytes")

    def run(batches):
        block, held, last, lead = [], 0, None, None
        for batch in batches:
            later = []
            for gram, key, second, doc, tk, lo, blob in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if blob is None:
                    if lead is None or lead[0] != (gram, key, second):
                        lead = (gram, key, second), (doc, lo)
                    elif lead[1] != (doc, lo):
                        later.append((doc, tk, lo))
                    continue
                if held >= BLOCK and gram != last:
                    yield _repeated_windows(block)
                    block, held = [], 0
                block.append((doc, tk, lo, blob))
                held += len(blob)
                last = gram
            if later:
                docs, tks, los = zip(*later, strict=True)
                yield pa.RecordBatch.from_pydict({
                    "doc": pa.array(docs, pa.int64()), "tk": pa.array(tks, pa.int64()),
                    "lo": pa.array(los, pa.int32()), "hi": pa.array(los, pa.int32())})
        if block:
            yield _repeated_windows(block)

    return dealt.mapInArrow(run, "doc long, tk long, lo int, hi int")


def repeated_runs(docs: DataFrame) -> DataFrame:
    """``(doc, tk, runs)``: per document with repeats the runs of repeated windows (first and last start)."""
    keyed = _keyed(docs)
    own = Window.partitionBy("gram")
    rows = _anchor_rows(keyed).withColumns({
        "n": F.count("*").over(own), "low": F.min("context").over(own), "high": F.max("context").over(own)}) \
        .where(F.col("n") > 1)
    rows = rows.withColumn("nth", F.rank().over(Window.partitionBy("gram", "context").orderBy("doc", "lo"))) \
        .select("doc", "tk", "gram", "lo", "hi", "nth", (F.col("low") != F.col("high")).alias("mixed")) \
        .where(F.col("mixed") | (F.col("nth") > 1))
    rows = materialize(rows, "repeated-anchors")
    mixed = rows.where(F.col("mixed") & (F.col("nth") == 1)).select("doc", "tk", "gram", "lo", "hi")
    # at most one anchor in BUCKET rows
    large = mixed.groupBy("gram").count().where(F.col("count") > BUCKET).select("gram", F.lit(True).alias("large"))
    mixed = mixed.join(F.broadcast(large), "gram", "left").withColumn("large", F.coalesce("large", F.lit(False)))
    found = rows.where(F.col("nth") > 1).select("doc", "tk", "lo", "hi") \
        .unionByName(_sorted_buckets(_contexts(keyed, mixed)))
    return found.groupBy("doc", "tk").agg(F.sort_array(F.collect_set(F.struct("lo", "hi"))).alias("runs"))


def _cut(text: bytes, runs: list[dict] | None) -> tuple[bytes, int, int]:
    """What is left of a text, removed bytes, maximal removed runs."""
    kept, removed, spans, at = [], 0, 0, -1
    for r in runs or ():
        lo, hi = r["lo"], r["hi"] + LENGTH
        if lo > at:
            kept.append(text[max(at, 0):lo])
            spans += 1
            removed += hi - lo
            at = hi
        elif hi > at:
            removed += hi - at
            at = hi
    kept.append(text[max(at, 0):])
    return b"".join(kept), removed, spans


def remove_repeats(docs: DataFrame, as_text: bool = False) -> DataFrame:
    """Every row of ``docs`` with ``n_bytes, n_removed, n_spans, kept`` (bytes, or text without the
    characters that were cut apart); other columns pass through."""
    outputs = ["n_bytes", "n_removed", "n_spans", "kept"]
    rest = [f for f in docs.schema.fields if f.name.lower() not in outputs]
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    runs = repeated_runs(docs).withColumnsRenamed({"doc": "__doc", "tk": "__tk", "runs": "__runs"})
    keyed = docs.select(*[F.col(f"`{f.name}`") for f in rest],
                        F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("__doc"),
                        F.xxhash64(text).alias("__tk"), text.alias("__bytes"))
    both = keyed.join(runs, ["__doc", "__tk"], "left").select(*[F.col(f"`{f.name}`") for f in rest],
                                                              "__bytes", "__runs")
    schema = both.select(*[F.col(f"`{f.name}`") for f in rest], F.lit(0).cast("long").alias("n_bytes"),
                         F.lit(0).cast("long").alias("n_removed"), F.lit(0).cast("long").alias("n_spans"),
                         F.lit("" if as_text else b"").alias("kept")).schema

    def run(batches):
        for batch in batches:
            texts, cuts = batch.column(batch.num_columns - 2).to_pylist(), batch.column(batch.num_columns - 1)
            done = [_cut(t, r) for t, r in zip(texts, cuts.to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-2], pa.array([len(t) for t in texts], pa.int64()),
                 pa.array([d[1] for d in done], pa.int64()), pa.array([d[2] for d in done], pa.int64()),
                 pa.array([d[0].decode("utf-8", "ignore") for d in done], pa.string()) if as_text
                 else pa.array([d[0] for d in done], pa.binary())], names=schema.names)

    return both.mapInArrow(run, schema)


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without its repeated bytes."""
    docs = read_documents(spark, sf_dir).select("doc_id", "text")
    return remove_repeats(docs).select("doc_id", "n_bytes", "n_removed", "n_spans",
                                       F.sha2(F.col("kept"), 256).alias("kept_sha256"))



def suffix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: repeated passages are cut out; a document of which nothing is left goes.

    A character of which only some bytes are left goes as a whole. A null or
    empty text stays as it is.
    """
    names = docs.columns
    out = remove_repeats(docs, as_text=True).where((F.col("n_removed") == 0) | (F.length("kept") > 0))
    cut = F.col("n_removed") > 0
    return out.withColumn("text", F.when(cut, F.col("kept")).otherwise(F.col("text"))) \
        .withColumn("n_chars", F.when(cut, F.length("kept").cast(docs.schema["n_chars"].dataType))
                    .otherwise(F.col("n_chars"))).select(*names)
