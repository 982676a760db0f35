"""Best-fit packing by patterns fitted with non-negative least squares.

1. ``token_pieces``: every whole text becomes token ids plus an end id; only a
   document longer than the capacity is cut, into full pieces and a last one.
2. The histogram of piece lengths (at most ``capacity`` rows) goes to the
   driver. Lengths are put into ``units`` equal bins; all patterns of up to
   three bins that fill a sequence exactly are enumerated and their repeat
   counts fitted to the histogram by non-negative least squares, then rounded
   within what is there.
3. Pieces that the patterns leave over (and shorter ones than their bin allows
   for) are packed by best fit, longest first, on exact lengths: into the
   smallest gap that holds them, else into new sequences. The plan is a list
   of runs (length, first rank, count, first sequence, offset); it is bounded
   by the distinct lengths, not by the number of pieces.
4. Spark ranks the pieces within each length (salted, so that one very common
   length is dealt over many tasks) and looks up each piece's run.

Nothing is sent to the driver but the histogram, and broadcast but the plan.

Defined cases: null text counts as empty (one piece: the end id); repeated
rows are pieces of their own; an empty table gives an empty result; extra
columns pass through, and a column named like an output is replaced; lengths
outside 1..capacity raise ``ValueError``.
"""

from __future__ import annotations

import gc
import os
import re
import zlib
from bisect import bisect_left, bisect_right, insort
from collections import ChainMap
from itertools import chain, combinations_with_replacement, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialize, read_documents
from .op1_bpe import Vocabulary, byte_alphabet, vocabulary_path

VOCABULARY = "word_bpe_49k.json"
CAPACITY = 4096
END_ID = 1
UNITS = 128
SHARES = (1.0, 0.9, 0.75, 0.5)
#: Known chunks and words from which the memo starts anew, and the longest that it keeps.
CACHE_CHUNKS = 500_000
CACHE_CHARS = 64
#: Bytes of text that are tokenized at once.
GROUP_BYTES = 4 << 20
ROWS_PER_SALT = 100_000


# ---------------------------------------------------------------------------
# token pieces
# ---------------------------------------------------------------------------

#: Marks that end a chunk: behind a letter or digit they are a pre-token of their own.
MARKS = ".,;:!?#*$%&)"


def _gather(values: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The slices ``values[start:start + size]`` one after the other, and where each ends."""
    ends = np.cumsum(sizes)
    at = np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - sizes), sizes)
    return values[at], ends


#: Words of letters whose lower case is one letter each and that no normalisation changes (ASCII and Latin-1).
PLAIN = re.compile("[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+").fullmatch


#: The letter that stands for each byte in a byte-level vocabulary.
BYTE_LETTERS = dict(enumerate(byte_alphabet()))


class WordTokenizer:
    """The tokenizers library behind a bounded memo of blank-separated chunks and their words.

    White space separates pre-tokens and is dropped, so a text's ids are the
    ids of its chunks one after the other. A chunk is a word and the marks
    behind it; an ASCII word is looked up in lower case, as the tokenizer
    lowers it itself (chunks with ``<`` may hold special tokens and are left
    alone).

    Words of Latin letters need none of the normalisation or splitting before
    the merges and go to the library's model as they are, byte by byte.

    A batch of texts is split and its chunks are numbered by Arrow, only the
    distinct ones are looked up, and the ids are gathered by numpy from one
    array that holds the ids of every known chunk.
    """

    def __init__(self, spec: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_str(spec)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        self.encode_batch = getattr(self.tokenizer, "encode_batch_fast", self.tokenizer.encode_batch)
        self.merge = self.tokenizer.model.tokenize
        self._forget()

    def _forget(self) -> None:
        self.entries: dict[str, int] = {}
        self.starts, self.sizes, self.known = np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int64), 0
        self.ids, self.used = np.zeros(1 << 14, np.uint32), 0

    def _append(self, ids: np.ndarray, sizes: np.ndarray) -> int:
        """Store entries; returns the number of the first."""
        first, known, used = self.known, self.known + len(sizes), self.used + len(ids)
        if known > len(self.starts):
            more = max(known - len(self.starts), len(self.starts))
            self.starts, self.sizes = (np.concatenate([x, np.zeros(more, np.int64)]) for x in (self.starts, self.sizes))
        if used > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros(max(used - len(self.ids), len(self.ids)), np.uint32)])
        self.starts[first:known] = self.used + np.cumsum(sizes) - sizes
        self.sizes[first:known], self.ids[self.used:used] = sizes, ids
        self.known, self.used = known, used
        return first

    @staticmethod
    def _parts(chunk: str) -> tuple[str, ...]:
        if "<" in chunk:
            return (chunk,)
        word = chunk.rstrip(MARKS)
        # lowering may put a combining mark behind a letter, which then joins the marks
        if not word or not word[-1].lower()[-1].isalnum():
            word = chunk
        marks = chunk[len(word):]
        if word.isascii():
            word = word.lower()
        return (word, marks) if marks else (word,)

    def _learn(self, chunks: list[str], memo: dict[str, int]) -> None:
        """Entries of unknown chunks and their parts, into ``memo``."""
        known = self.entries if memo is self.entries else ChainMap(memo, self.entries)
        parts = [(c.lower(),) if c.isascii() and c.isalpha() else self._parts(c) for c in chunks]
        new = [p for p in set(chain.from_iterable(parts)) if p not in known]
        if new:
            plain = [p for p in new if PLAIN(p)]
            new = plain + [p for p in new if not PLAIN(p)]
            # ASCII parts are in lower case and their letters stand for themselves
            found = [[t.id for t in self.merge(p if p.isascii() else p.lower().encode().decode("latin-1").translate(BYTE_LETTERS))]
                     for p in plain]
            found += [e.ids for e in self.encode_batch(new[len(plain):], add_special_tokens=False)]
            sizes = np.fromiter(map(len, found), np.int64, len(found))
            first = self._append(np.fromiter(chain.from_iterable(found), np.uint32, int(sizes.sum())), sizes)
            memo.update(zip(new, range(first, first + len(new)), strict=True))
        joined = [(c, ps) for c, ps in zip(chunks, parts, strict=True) if len(ps) > 1]
        if joined:
            flat = [p for _, ps in joined for p in ps]
            of = np.fromiter(map(known.__getitem__, flat), np.int64, len(flat))
            ids, _ = _gather(self.ids, self.starts[of], self.sizes[of])
            sizes = np.add.reduceat(self.sizes[of], np.cumsum([0] + [len(ps) for _, ps in joined[:-1]]))
            first = self._append(ids, sizes)
            memo.update(zip((c for c, _ in joined), range(first, first + len(joined)), strict=True))
        memo.update([(c, known[ps[0]]) for c, ps in zip(chunks, parts, strict=True) if len(ps) == 1 and ps[0] != c])

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after the other, and the bounds of each text (null: no ids)."""
        collecting = gc.isenabled()
        gc.disable()                                          # many small objects, no cycles
        try:
            return self._encode(texts)
        finally:
            if collecting:
                gc.enable()

    def _encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        if len(self.entries) > CACHE_CHUNKS:
            self._forget()
        split = pc.split_pattern(pc.replace_substring(pc.fill_null(texts, ""), "\n", " "), " ")
        coded = split.flatten().dictionary_encode()
        names = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        entry = np.fromiter(map(self.entries.get, names, repeat(-1)), np.int64, len(names))
        missing = [names[i] for i in np.flatnonzero(entry < 0)]
        self._learn([c for c in missing if len(c) <= CACHE_CHARS], self.entries)
        kept, own = (self.known, self.used), {}
        self._learn([c for c in missing if len(c) > CACHE_CHARS], own)
        if missing:
            entry[entry < 0] = [own[c] if c in own else self.entries[c] for c in missing]
        at = entry[coded.indices.to_numpy()]
        ids, ends = _gather(self.ids, self.starts[at], self.sizes[at])
        self.known, self.used = kept                          # long chunks are not remembered
        chunks = np.concatenate([[0], np.cumsum(pc.list_value_length(split).to_numpy())])
        return ids, np.concatenate([[0], ends])[chunks]

    def encode_all(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit numbers."""
        ids, bounds = self.encode(pa.array(texts, pa.large_string()))
        return [ids[a:b].astype("<u4").tobytes() for a, b in zip(bounds, bounds[1:], strict=False)]


_TOKENIZERS: dict[str, WordTokenizer] = {}


def _groups(batches):
    """The rows of Arrow batches in tables whose texts (the last column) have about ``GROUP_BYTES`` bytes."""
    held, size = [], 0
    for batch in batches:
        lengths = pc.fill_null(pc.binary_length(batch.column(batch.num_columns - 1)), 0).to_numpy(zero_copy_only=False)
        start = 0
        for i, n in enumerate(lengths):
            size += int(n)
            if size >= GROUP_BYTES:
                held.append(batch.slice(start, i + 1 - start))
                yield pa.Table.from_batches(held).combine_chunks()
                held, size, start = [], 0, i + 1
        if start < batch.num_rows:
            held.append(batch.slice(start))
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def token_pieces(df: DataFrame, vocabulary: Vocabulary, text_col: str = "text", capacity: int = CAPACITY,
                 end_id: int = END_ID, digest: bool = False) -> DataFrame:
    """One row per piece: the input columns but the text, ``piece``, ``start``, ``length``, ``ids`` (binary).

    With ``digest`` the ids stay in the task and ``ids_crc32`` takes their place.
    """
    outputs = [("piece", T.IntegerType()), ("start", T.LongType()), ("length", T.LongType()),
               ("ids_crc32", T.LongType()) if digest else ("ids", T.BinaryType())]
    taken = {n for n, _ in outputs} | {text_col.lower()}
    kept = [f for f in df.schema.fields if f.name.lower() not in taken]
    schema = T.StructType(kept + [T.StructField(n, t) for n, t in outputs])
    src, spec = df.select(*[F.col(f"`{f.name}`") for f in kept], F.col(text_col).alias("__text")), vocabulary.broadcast

    def run(batches):
        if spec.value not in _TOKENIZERS:
            _TOKENIZERS.clear()
            _TOKENIZERS[spec.value] = WordTokenizer(spec.value)
        tok = _TOKENIZERS[spec.value]
        for part in _groups(batches):
            texts = part.column(part.num_columns - 1)
            ids, bounds = tok.encode(pa.concat_arrays(texts.chunks).cast(pa.large_string()))
            ids = np.insert(ids, bounds[1:], end_id).astype("<u4")
            bounds = bounds + np.arange(len(bounds))
            sizes = np.diff(bounds)
            pieces = -(-sizes // capacity)
            row = np.repeat(np.arange(len(sizes)), pieces)
            piece = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            start = piece * capacity
            length = np.minimum(capacity, sizes[row] - start)
            data, first = ids.tobytes(), 4 * (bounds[row] + start)        # pieces follow one another
            if digest:
                view = memoryview(data)
                last = pa.array([zlib.crc32(view[a:a + 4 * n]) for a, n in zip(first.tolist(), length.tolist(), strict=True)],
                                pa.int64())
            else:
                offsets = np.append(first, len(data)).astype(np.int32)
                last = pa.Array.from_buffers(pa.binary(), len(row), [None, pa.py_buffer(offsets), pa.py_buffer(data)])
            out = pa.Table.from_arrays(
                [*(part.column(c).take(pa.array(row)) for c in range(part.num_columns - 1)),
                 pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), last],
                names=schema.names)
            yield from out.to_batches()

    return src.mapInArrow(run, schema)


# ---------------------------------------------------------------------------
# the plan, from the histogram alone
# ---------------------------------------------------------------------------

def nnls(a: np.ndarray, b: np.ndarray, rounds: int = 1000, tol: float = 1e-9) -> np.ndarray:
    """Non-negative least squares by an active set (Lawson and Hanson 1974)."""
    n = a.shape[1]
    x, inside = np.zeros(n), np.zeros(n, bool)
    at_a, at_b = a.T @ a, a.T @ b
    scale = tol * max(1.0, float(np.abs(at_b).max(initial=0)))
    for _ in range(rounds):
        grad = at_b - at_a @ x
        grad[inside] = -np.inf
        new = int(np.argmax(grad)) if n else 0
        if not n or grad[new] <= scale:
            break
        inside[new] = True
        while True:
            own = np.flatnonzero(inside)
            gram = at_a[np.ix_(own, own)]
            try:
                z = np.linalg.solve(gram, at_b[own])
            except np.linalg.LinAlgError:
                z = np.linalg.lstsq(gram, at_b[own], rcond=None)[0]
            if z.min() > 0:
                x[:] = 0
                x[own] = z
                break
            low = own[z <= 0]
            zz = z[z <= 0]
            step = float(np.min(x[low] / np.maximum(x[low] - zz, 1e-300)))
            x[own] += step * (z - x[own])
            inside[own[x[own] <= 1e-12]] = False
            x[~inside] = 0
            if not inside.any():
                break
    return x


def patterns(units: int) -> list[tuple[int, ...]]:
    """All multisets of one to three bins that fill ``units`` exactly, longest first."""
    out: list[tuple[int, ...]] = [(units,)]
    out += [(units - s, s) for s in range(1, units // 2 + 1)]
    out += [(units - s - t, t, s) for s, t in combinations_with_replacement(range(1, units), 2)
            if units - s - t >= t]
    return out


class PackPlan:
    """Runs ``(length, first rank, count, first sequence, offset)`` for a histogram of lengths.

    The fitted repeat counts are taken in full or in part (``SHARES``): what a
    share leaves over fills the gaps that the bins' rounding leaves. The share
    that needs the fewest sequences is kept.
    """

    def __init__(self, histogram: dict[int, int], capacity: int, units: int = UNITS):
        if any(not 1 <= k <= capacity for k in histogram):
            raise ValueError(f"piece lengths must be within 1..{capacity}")
        self.capacity, self.sequences = capacity, 0
        self.histogram = {k: int(v) for k, v in histogram.items() if v}
        self.runs: list[tuple[int, int, int, int, int]] = []
        if self.histogram:
            fitted = self._fit(min(units, capacity))
            tokens = sum(k * v for k, v in self.histogram.items())
            best = None
            for share in SHARES:
                self._start()
                self._patterns(fitted, share)
                self._best_fit()
                if best is None or self.sequences < best[0]:
                    best = (self.sequences, self.runs)
                if best[0] == -(-tokens // capacity):
                    break
            self.sequences, self.runs = best
        self.runs.sort()

    def _start(self) -> None:
        self.sequences, self.runs = 0, []
        self.left = dict(self.histogram)
        self.there = sorted(self.left)
        self.rank = dict.fromkeys(self.left, 0)
        self.open: dict[int, list[tuple[int, int]]] = {}
        self.spaces: list[int] = []

    def _put(self, length: int, count: int, first: int, offset: int) -> None:
        self.runs.append((length, self.rank[length], count, first, offset))
        self.rank[length] += count
        self.left[length] -= count
        if not self.left[length]:
            self.there.pop(bisect_left(self.there, length))

    def _gap(self, space: int, first: int, count: int) -> None:
        if space and count:
            if not self.open.get(space):
                self.open[space] = []
                insort(self.spaces, space)
            self.open[space].append((first, count))

    def _fit(self, units: int) -> list[tuple[float, tuple[int, ...]]]:
        """Patterns with their fitted repeat counts, largest first."""
        unit = -(-self.capacity // units)
        units = -(-self.capacity // unit)
        self.bins: dict[int, list[int]] = {}
        for length in sorted(self.histogram, reverse=True):
            self.bins.setdefault(-(-length // unit), []).append(length)
        have = np.array([sum(self.histogram[x] for x in self.bins.get(u, ())) for u in range(1, units + 1)], float)
        usable = [p for p in patterns(units) if all(have[u - 1] for u in p)]
        if not usable:
            return []
        a = np.zeros((units, len(usable)))
        for j, p in enumerate(usable):
            for u in p:
                a[u - 1, j] += 1
        # a long piece that is left over costs a sequence, a short one fills a gap
        weight = np.sqrt(np.arange(1, units + 1) / units)
        x = nnls(a * weight[:, None], have * weight / have.sum()) * have.sum()
        return [(float(x[j]), usable[j]) for j in np.argsort(-x, kind="stable") if x[j] > 0]

    def _patterns(self, fitted: list[tuple[float, tuple[int, ...]]], share: float) -> None:
        for count, p in fitted:
            need = {u: p.count(u) for u in p}
            have = [sum(self.left[x] for x in self.bins[u]) // k for u, k in need.items()]
            want = min(round(count * share), *have)
            if want > 0:
                self._repeat([self.bins[u] for u in p], want)

    def _repeat(self, slots: list[list[int]], count: int) -> None:
        """Fill ``count`` sequences by one pattern: a piece of each slot's bin, longest lengths first.

        The last of several slots takes the longest piece that fits the exact rest.
        """
        while count:
            take: list[int] = []
            for i, lengths in enumerate(slots):
                if i and i == len(slots) - 1:
                    at = bisect_right(self.there, self.capacity - sum(take)) - 1
                    while at >= 0 and self.left[self.there[at]] <= take.count(self.there[at]):
                        at -= 1
                    got = self.there[at] if at >= 0 else None
                else:
                    got = next((x for x in lengths if self.left[x] > take.count(x)), None)
                if got is None:
                    return
                take.append(got)
            m = min([count, *(self.left[x] // take.count(x) for x in take)])
            offset = 0
            for x in take:
                self._put(x, m, self.sequences, offset)
                offset += x
            self._gap(self.capacity - offset, self.sequences, m)
            self.sequences += m
            count -= m

    def _best_fit(self) -> None:
        for length in sorted(self.left, reverse=True):
            while self.left[length]:
                rest = self.left[length]
                at = bisect_left(self.spaces, length)
                if at < len(self.spaces):
                    space = self.spaces[at]
                    first, count = self.open[space].pop()
                    if not self.open[space]:
                        self.spaces.pop(at)
                else:
                    space, first = self.capacity, self.sequences
                    count = -(-rest // (space // length))
                    self.sequences += count
                each = min(space // length, rest)
                m = min(count, rest // each)
                for k in range(each):
                    self._put(length, m, first, self.capacity - space + k * length)
                self._gap(space - each * length, first, m)
                self._gap(space, first + m, count - m)

    def arrays(self) -> dict[str, np.ndarray]:
        cols = np.array(self.runs, np.int64).reshape(-1, 5).T
        return {"key": (cols[0] << 44) | cols[1], "rank": cols[1], "first": cols[3], "offset": cols[4]}


# ---------------------------------------------------------------------------
# the operator
# ---------------------------------------------------------------------------

def pack(pieces: DataFrame, keys: list[str], length_col: str = "length", capacity: int = CAPACITY,
         units: int = UNITS) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to every row of ``pieces`` (a stored table, see ``materialize``).

    ``keys`` name the rows; rows that agree in all of them and in length are interchangeable.
    """
    spark = pieces.sparkSession
    rows = pieces.drop("sequence_id", "offset", "__salt", "__rank", "__before")
    total = rows.count()
    salts = max(1, -(-total // ROWS_PER_SALT))
    rows = rows.withColumn("__salt", F.pmod(F.xxhash64(*keys), F.lit(salts)).cast("int"))
    counts = rows.groupBy(F.col(length_col).alias("__length"), F.col("__salt").alias("__s")) \
        .agg(F.count("*").alias("__n"))
    counts = materialize(counts, "length-counts")
    histogram = {r[0]: r[1] for r in counts.groupBy("__length").agg(F.sum("__n")).collect()}
    plan = spark.sparkContext.broadcast(PackPlan(histogram, capacity, units).arrays())
    before = counts.withColumn("__before", F.sum("__n").over(
        Window.partitionBy("__length").orderBy("__s").rowsBetween(Window.unboundedPreceding, -1))) \
        .select("__length", "__s", F.coalesce("__before", F.lit(0)).alias("__before"))
    ranked = rows.withColumn("__rank", F.row_number().over(
        Window.partitionBy(length_col, "__salt").orderBy(*keys)).cast("long") - 1)
    ranked = ranked.join(before, (F.col(length_col) == F.col("__length")) & (F.col("__salt") == F.col("__s"))) \
        .withColumn("__rank", F.col("__rank") + F.col("__before")).drop("__salt", "__s", "__length", "__before")
    schema = T.StructType([f for f in ranked.schema.fields if f.name != "__rank"]
                          + [T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    at_length, at_rank = ranked.columns.index(length_col), ranked.columns.index("__rank")

    def place(batches):
        p = plan.value
        for batch in batches:
            length = batch.column(at_length).to_numpy(zero_copy_only=False).astype(np.int64)
            rank = batch.column(at_rank).to_numpy(zero_copy_only=False).astype(np.int64)
            run = np.searchsorted(p["key"], (length << 44) | rank, side="right") - 1
            cols = [batch.column(i) for i in range(batch.num_columns) if i != at_rank]
            yield pa.RecordBatch.from_arrays(
                [*cols, pa.array(p["first"][run] + rank - p["rank"][run]), pa.array(p["offset"][run])],
                names=schema.names)

    return ranked.mapInArrow(place, schema)


def pack_documents(docs: DataFrame, spark: SparkSession, capacity: int = CAPACITY) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32, sequence_id, offset`` for every piece of ``docs``."""
    vocabulary = Vocabulary.load(spark, vocabulary_path(VOCABULARY))
    pieces = token_pieces(docs.select("doc_id", "text"), vocabulary, capacity=capacity, digest=True)
    pieces = materialize(pieces, "pieces")
    return pack(pieces, ["doc_id", "piece", "ids_crc32"], capacity=capacity)


def op9_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of at most 4096 tokens."""
    return pack_documents(read_documents(spark, sf_dir), spark)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage (the last): the places of all pieces of all documents."""
    return pack_documents(docs, spark)
