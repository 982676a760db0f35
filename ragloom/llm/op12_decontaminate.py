"""Benchmark decontamination with an FM-index per shard of the training documents.

Index (:func:`build_index`): the documents of a task are cut into shards of
bounded size. The words of a shard, with a separator behind each piece of
a document, are numbered and sorted by suffix; the shard keeps

* its vocabulary,
* the Burrows-Wheeler transform as a wavelet matrix (one bit vector per bit of
  the word numbers, bits of one level reordered stably by the level before),
* the suffix positions that are multiples of ``SAMPLE``, and which rows hold them,
* where each piece starts, in the shard and in its document.

A document of more than ``PIECE`` words is cut into pieces that overlap by one
word less than a window, so that no window is lost and no document is too long
for a shard. The index is a table: it is built once and serves any benchmark.

Search (:func:`search`): the distinct windows of the benchmark are matched in
every shard, all at once, by backward search: each word narrows the row
interval by two ranks in the wavelet matrix. Rows of the final intervals are
located by stepping back to a sampled position. Hits become word spans of the
document that are merged per piece, and then per document.

The windows are a stated query set. They are dealt into blocks of at most
about ``BLOCK_WINDOWS`` windows and ``BLOCK_BYTES`` bytes, each broadcast by
itself; the index is read once per block. Nothing is grouped by a word or a
window of the documents, so that frequent passages make no hot key; items that
share a window are added by a join on the windows that occur.

Defined cases: null text and text without words have no word and no hit; rows
with a null doc_id and repeated rows are rows of their own; benchmark items
without words have no window and never occur; a null item_id counts as the
empty string; an empty benchmark leaves all documents without hits; an empty
document table gives an empty result; other columns of the inputs are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, read_documents

#: Words of a window.
WINDOW = 10
#: Words of a shard, and of the largest piece of a document.
SHARD, PIECE = 1 << 20, 1 << 19
#: Every so many words the suffix position is kept.
SAMPLE = 8
#: Windows and bytes of a broadcast block.
BLOCK_WINDOWS, BLOCK_BYTES = 200_000, 32 << 20
#: (window, item) rows that are broadcast to the hits; more are joined by a shuffle.
MAX_BROADCAST_ITEMS = 500_000

#: Bytes of words stay (A-Z in lower case), all others become blanks.
_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if b >= 0x80 or chr(b).isdigit() or 97 <= b <= 122 else 32
               for b in range(256))
#: The same words for SQL functions.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Symbols of a shard that are no words.
END, SEPARATOR, FIRST_WORD = 0, 1, 2


def words_of(text: str | None) -> list[bytes]:
    return text.encode().translate(_TABLE).split() if text else []


# ---------------------------------------------------------------------------
# index of a shard
# ---------------------------------------------------------------------------

def suffix_order(s: np.ndarray) -> np.ndarray:
    """Positions of the suffixes of ``s`` in order; the last symbol is unique and smallest.

    Suffixes are sorted by their first three symbols (as many as fit in 64
    bits); those that tie are sorted again by the ranks of what follows, twice
    as far each time.
    """
    n, bits = len(s), max(1, int(s.max()).bit_length())
    reach = max(1, 63 // bits)
    padded = np.concatenate([s, np.zeros(reach, np.int64)])
    key = padded[:n].copy()
    for i in range(1, reach):
        key = (key << bits) | padded[i:n + i]
    order = np.argsort(key, kind="stable")
    first = np.concatenate([[True], key[order][1:] != key[order][:-1]])
    start = np.maximum.accumulate(np.where(first, np.arange(n), 0))
    rank = np.empty(n, np.int64)
    rank[order] = start
    tied = np.flatnonzero(~(first & np.concatenate([first[1:], [True]])))
    while len(tied):
        at = order[tied]
        follow = np.where(at + reach < n, rank[np.minimum(at + reach, n - 1)] + 1, 0)
        by = np.lexsort((follow, rank[at]))
        at, follow, group = at[by], follow[by], rank[at[by]]
        order[tied] = at
        first = np.concatenate([[True], (group[1:] != group[:-1]) | (follow[1:] != follow[:-1])])
        rank[at] = tied[np.maximum.accumulate(np.where(first, np.arange(len(tied)), 0))]
        tied = tied[~(first & np.concatenate([first[1:], [True]]))]
        reach *= 2
    return order


def _ones_before(words: np.ndarray) -> np.ndarray:
    """Set bits before each 64-bit word of a bit vector, and behind the last."""
    return np.concatenate([[0], np.cumsum(np.bitwise_count(words), dtype=np.int64)])


def _packed(bits: np.ndarray) -> np.ndarray:
    return np.packbits(np.concatenate([bits, np.zeros(-len(bits) % 64, bool)]), bitorder="little").view(np.uint64)


class BitVector:
    """Bits with constant-time ranks."""

    def __init__(self, words: np.ndarray):
        self.words = np.concatenate([words, np.zeros(1, np.uint64)])
        self.before = _ones_before(words)

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Set bits before each position."""
        w = at >> 6
        low = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[w] + np.bitwise_count(self.words[w] & low)

    def get(self, at: np.ndarray) -> np.ndarray:
        return (self.words[at >> 6] >> (at & 63).astype(np.uint64) & np.uint64(1)).astype(bool)


def wavelet(symbols: np.ndarray) -> tuple[list[np.ndarray], list[int]]:
    """Bit vectors of the levels, most significant bit first, and the zeros of each."""
    levels, zeros = [], []
    for level in reversed(range(max(1, int(symbols.max()).bit_length()))):
        bits = (symbols >> level & 1).astype(bool)
        levels.append(_packed(bits))
        zeros.append(int(len(bits) - bits.sum()))
        symbols = np.concatenate([symbols[~bits], symbols[bits]])
    return levels, zeros


class FMIndex:
    """Backward search and location in one shard."""

    def __init__(self, levels: list[np.ndarray], zeros: list[int], n: int, marked: np.ndarray, samples: np.ndarray,
                 counts: np.ndarray):
        self.levels, self.zeros, self.n = [BitVector(w) for w in levels], zeros, n
        self.marked, self.samples, self.counts = BitVector(marked), samples, counts

    def rank(self, symbol: np.ndarray, *at: np.ndarray) -> list[np.ndarray]:
        """Occurrences of each symbol before the given rows of the transform."""
        k = len(symbol)
        pos = np.concatenate([np.zeros(k, np.int64), *at])
        top = len(self.levels) - 1
        for i, (bits, zeros) in enumerate(zip(self.levels, self.zeros, strict=True)):
            ones = bits.rank(pos)
            one = np.tile((symbol >> (top - i) & 1).astype(bool), len(at) + 1)
            pos = np.where(one, zeros + ones, pos - ones)
        return [pos[(j + 1) * k:(j + 2) * k] - pos[:k] for j in range(len(at))]

    def search(self, patterns: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row interval of the suffixes that start with each pattern (rows of symbols, filled up at the end)."""
        low, high = np.zeros(len(patterns), np.int64), np.full(len(patterns), self.n, np.int64)
        live = np.arange(len(patterns))
        for step in range(patterns.shape[1]):
            live = live[(lengths[live] > step) & (high[live] > low[live])]
            if not len(live):
                break
            symbol = patterns[live, lengths[live] - 1 - step]
            a, b = self.rank(symbol, low[live], high[live])
            low[live], high[live] = self.counts[symbol] + a, self.counts[symbol] + b
        return low, high

    def symbol_and_rank(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The transform's symbol in each row, and how many of it are before."""
        symbol, low = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
        for bits, zeros in zip(self.levels, self.zeros, strict=True):
            one = bits.get(at)
            ones, ones_low = bits.rank(at), bits.rank(low)
            at = np.where(one, zeros + ones, at - ones)
            low = np.where(one, zeros + ones_low, low - ones_low)
            symbol = symbol << 1 | one
        return symbol, at - low

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text position of each row: steps back to the next sampled one."""
        out, live, at = np.zeros(len(rows), np.int64), np.arange(len(rows)), rows.copy()
        for back in range(SAMPLE):
            found = self.marked.get(at)
            out[live[found]] = self.samples[self.marked.rank(at[found])] + back
            live, at = live[~found], at[~found]
            if not len(live):
                return out
            symbol, before = self.symbol_and_rank(at)
            at = self.counts[symbol] + before
        raise AssertionError("a suffix position is not sampled")


INDEX_SCHEMA = ("vocabulary binary, n long, levels array<binary>, zeros array<long>, counts binary, marked binary, "
                "samples binary, doc_row array<long>, doc_id array<long>, first_word array<long>, own_words array<long>, "
                "start array<long>")


def _index_row(pieces: list[tuple]) -> dict:
    """Index of a shard from its pieces ``(doc_row, doc_id, first_word, own_words, words)``."""
    ids: dict[bytes, int] = {}
    symbols, start, at = [], [], 0
    for *_, words in pieces:
        start.append(at)
        symbols.append(np.fromiter((ids.setdefault(w, len(ids) + FIRST_WORD) for w in words), np.int64, len(words)))
        symbols.append(np.array([SEPARATOR], np.int64))
        at += len(words) + 1
    s = np.concatenate([*symbols, np.array([END], np.int64)])
    order = suffix_order(s)
    levels, zeros = wavelet(s[order - 1])
    counts = np.bincount(s, minlength=len(ids) + FIRST_WORD)
    marked = order % SAMPLE == 0
    return {"vocabulary": b" ".join(ids), "n": len(s), "levels": [w.tobytes() for w in levels], "zeros": zeros,
            "counts": (np.cumsum(counts) - counts).tobytes(), "marked": _packed(marked).tobytes(),
            "samples": order[marked].astype(np.int32).tobytes(),
            "doc_row": [p[0] for p in pieces], "doc_id": [p[1] for p in pieces],
            "first_word": [p[2] for p in pieces], "own_words": [p[3] for p in pieces], "start": start}


def build_index(docs: DataFrame, window: int = WINDOW, shard: int = SHARD, piece: int = PIECE) -> DataFrame:
    """Table of the shards' FM-indexes over all words of ``docs(doc_id, text)``, written to the shared folder."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string
    schema = to_arrow_schema(_parse_datatype_string(INDEX_SCHEMA))

    def run(batches):
        held, size = [], 0
        for batch in batches:
            for row, doc_id, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                words = words_of(text)
                for at in range(0, max(1, len(words)), piece):
                    if held and size + min(piece, len(words) - at) > shard:
                        yield pa.RecordBatch.from_pylist([_index_row(held)], schema)
                        held, size = [], 0
                    part = words[at:at + piece + window - 1]
                    held.append((row, doc_id, at, min(piece, len(words) - at), part))
                    size += len(part) + 1
        if held:
            yield pa.RecordBatch.from_pylist([_index_row(held)], schema)

    rows = docs.select(F.monotonically_increasing_id().alias("doc_row"),
                       F.col("doc_id").cast("long").alias("doc_id"), "text")
    return materialize(rows.mapInArrow(run, INDEX_SCHEMA), "fm-index")


# ---------------------------------------------------------------------------
# phrases
# ---------------------------------------------------------------------------

def words(text: Column) -> Column:
    """Lower-cased words of a text, as :func:`words_of` has them."""
    lower = F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.regexp_extract_all(lower, F.lit(WORD), F.lit(0))


def benchmark_windows(benchmark: DataFrame, window: int = WINDOW) -> tuple[DataFrame, DataFrame]:
    """Written tables ``(window_id, phrase)`` of distinct windows and ``(window_id, item_id)`` of their items."""
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"),
                             words(F.col("text")).alias("w")).where(F.size("w") > 0)
    spread = items.select("item_id", "w", F.explode(
        F.sequence(F.lit(1), F.greatest(F.size("w") - (window - 1), F.lit(1)))).alias("at"))
    pairs = materialize(spread.select("item_id", F.array_join(F.slice("w", F.col("at"), window), " ").alias("phrase"))
                        .distinct(), "item-windows")
    phrases = materialize(pairs.select("phrase").distinct()
                          .select(F.monotonically_increasing_id().alias("window_id"), "phrase"), "windows")
    return phrases, materialize(pairs.join(phrases, "phrase").select("window_id", "item_id"), "window-items")


def _blocks(phrases: DataFrame, block_windows: int, block_bytes: int):
    """Bounded Arrow tables of the phrases, one after the other (at least one)."""
    n, size = phrases.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("phrase")), F.lit(0))).first()
    blocks = max(1, math.ceil(1.2 * n / block_windows), math.ceil(1.2 * size / block_bytes)) if n > block_windows \
        or size > block_bytes else 1
    for i in range(blocks):
        part = phrases if blocks == 1 else phrases.where(F.pmod(F.xxhash64("phrase"), F.lit(blocks)) == i)
        yield part.toArrow()


# ---------------------------------------------------------------------------
# search
# ---------------------------------------------------------------------------

def _merged(piece: np.ndarray, start: np.ndarray, end: np.ndarray):
    """Maximal spans of the hits, which are sorted by piece and start."""
    span_end = end.copy()
    shift = piece * (int(end.max()) + 1)                       # keeps the running maximum within a piece
    span_end = np.maximum.accumulate(end + shift) - shift
    new = np.concatenate([[True], (piece[1:] != piece[:-1]) | (start[1:] > span_end[:-1])])
    last = np.concatenate([np.flatnonzero(new)[1:] - 1, [len(piece) - 1]])
    return piece[new], start[new], span_end[last]


def _hits(row: dict, phrases: list[list[bytes]], window: int):
    """``(piece, start, end, window number)`` arrays of all occurrences in a shard."""
    ids = {w: i + FIRST_WORD for i, w in enumerate(row["vocabulary"].split(b" "))} if row["vocabulary"] else {}
    known = [(i, [ids[w] for w in p]) for i, p in enumerate(phrases) if all(w in ids for w in p)]
    if not known:
        return None
    lengths = np.array([len(p) for _, p in known], np.int64)
    patterns = np.zeros((len(known), window), np.int64)
    for i, (_, p) in enumerate(known):
        patterns[i, :len(p)] = p
    index = FMIndex([np.frombuffer(b, np.uint64) for b in row["levels"]], row["zeros"], row["n"],
                    np.frombuffer(row["marked"], np.uint64), np.frombuffer(row["samples"], np.int32),
                    np.frombuffer(row["counts"], np.int64))
    low, high = index.search(patterns, lengths)
    found = np.flatnonzero(high > low)
    if not len(found):
        return None
    sizes = high[found] - low[found]
    which = np.repeat(found, sizes)
    rows = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes) + low[which]
    at = index.locate(rows)
    starts = np.array(row["start"], np.int64)
    piece = np.searchsorted(starts, at, side="right") - 1
    begin = at - starts[piece] + np.array(row["first_word"], np.int64)[piece]
    by = np.lexsort((begin, piece))
    number = np.array([i for i, _ in known], np.int64)
    return piece[by], begin[by], begin[by] + lengths[which][by], number[which][by]


def _lists(piece: np.ndarray, values: np.ndarray, n: int) -> pa.Array:
    """One list per piece from values that are sorted by piece."""
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(piece, np.arange(n + 1)), pa.int32()), pa.array(values))


def search(index: DataFrame, phrases: DataFrame, window: int = WINDOW, block_windows: int = BLOCK_WINDOWS,
           block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Hits of ``phrases(window_id, phrase)`` in each piece of the index.

    Rows ``(doc_row, doc_id, n_words, starts, ends, windows)``: merged word
    spans of the document (end exclusive) and the windows that occur. With
    more than one block a piece has a row per block; its words are counted in
    the first.
    """
    spark = index.sparkSession
    parts = []
    for block, table in enumerate(_blocks(phrases, block_windows, block_bytes)):
        sent = spark.sparkContext.broadcast((table.column("window_id").to_numpy(),
                                             [p.encode().split(b" ") for p in table.column("phrase").to_pylist()]))

        def run(batches, sent=sent, block=block):
            window_ids, block_phrases = sent.value
            for batch in batches:
                for i in range(batch.num_rows):
                    row = batch.slice(i, 1).to_pylist()[0]
                    n = len(row["start"])
                    hits = _hits(row, block_phrases, window)
                    piece = start = end = of = which = np.zeros(0, np.int64)
                    if hits is not None:
                        piece, start, end = _merged(*hits[:3])
                        of, which = np.unique(np.stack([hits[0], window_ids[hits[3]]]), axis=1)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(row["doc_row"], pa.int64()), pa.array(row["doc_id"], pa.int64()),
                         pa.array(row["own_words"] if block == 0 else [0] * n, pa.int64()),
                         _lists(piece, start, n), _lists(piece, end, n), _lists(of, which, n)],
                        names=["doc_row", "doc_id", "n_words", "starts", "ends", "windows"])

        parts.append(index.mapInArrow(run, "doc_row long, doc_id long, n_words long, starts array<long>, "
                                           "ends array<long>, windows array<long>"))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return materialize(out, "window-hits")


def merge_spans(spans: Column) -> Column:
    """Disjoint sorted spans that cover the given ``(start, end)`` structs."""
    empty = F.array().cast("array<struct<start:bigint,end:bigint>>")

    def add(acc, s):
        last = F.element_at(acc, -1)
        joins = (F.size(acc) > 0) & (s["start"] <= F.try_element_at(acc, F.lit(-1))["end"])
        grown = F.struct(last["start"].alias("start"), F.greatest(last["end"], s["end"]).alias("end"))
        return F.when(joins, F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(grown))) \
            .otherwise(F.concat(acc, F.array(s)))

    return F.when(F.size(spans) <= 1, F.coalesce(spans, empty)).otherwise(
        F.aggregate(F.array_sort(spans), empty, add))


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, shard: int = SHARD,
                  piece: int = PIECE, block_windows: int = BLOCK_WINDOWS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``(doc_id, n_words, n_hit, n_items, items, removal_spans)`` of every row of ``docs(doc_id, text)``.

    ``items`` are the sorted item_ids whose windows occur, ``removal_spans``
    the maximal spans of hit words as structs ``(start, end)``, end exclusive.
    """
    phrases, items = benchmark_windows(benchmark, window)
    hits = search(build_index(docs, window, shard, piece), phrases, window, block_windows, block_bytes)
    spans = F.transform(F.arrays_zip("starts", "ends"),
                        lambda s: F.struct(s["starts"].alias("start"), s["ends"].alias("end")))
    rows = hits.groupBy("doc_row").agg(
        F.max("doc_id").alias("doc_id"), F.sum("n_words").alias("n_words"),
        F.flatten(F.collect_list(F.when(F.size("starts") > 0, spans))).alias("spans"))
    small = items.count() <= MAX_BROADCAST_ITEMS
    found = hits.where(F.size("windows") > 0).select("doc_row", F.explode("windows").alias("window_id")) \
        .join(F.broadcast(items) if small else items, "window_id") \
        .groupBy("doc_row").agg(F.array_sort(F.collect_set("item_id")).alias("items"))
    rows = rows.join(found, "doc_row", "left").withColumn("removal_spans", merge_spans(F.col("spans")))
    hit = F.aggregate("removal_spans", F.lit(0).cast("long"), lambda acc, s: acc + s["end"] - s["start"])
    listed = F.coalesce("items", F.array().cast("array<string>"))
    return rows.select("doc_id", "n_words", hit.alias("n_hit"), F.size(listed).cast("long").alias("n_items"),
                       listed.alias("items"), "removal_spans")


def op12_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document that a benchmark window hits, and the items it belongs to."""
    found = decontaminate(read_documents(spark, sf_dir), read_documents(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items",
                        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
                        (F.col("n_hit") > 0).alias("contaminated"))


_SQL_WORDS = (r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', "
              r"'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')")
SQL = f"""
WITH d AS (SELECT doc_id, {_SQL_WORDS} AS w FROM documents),
b AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item_id, {_SQL_WORDS} AS w FROM benchmark),
windows AS (SELECT DISTINCT item_id, phrase, len(phrase) AS size FROM
            (SELECT item_id, w[i:i + 9] AS phrase
             FROM b, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS u(i) WHERE len(w) > 0)),
places AS (SELECT doc_id, i, w[i:i + size - 1] AS phrase, size
       FROM d, (SELECT DISTINCT size FROM windows), unnest(range(1, len(w) - size + 2)) AS u(i)),
hits AS (SELECT DISTINCT doc_id, i, size, phrase FROM places SEMI JOIN windows USING (phrase, size)),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM hits, unnest(range(i, i + size)) AS u(p) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS items FROM
          (SELECT DISTINCT doc_id, item_id FROM hits JOIN windows USING (phrase, size)) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN items USING (doc_id)
"""
