"""Exact n-gram Jaccard self-join with filters under several global token orders.

A document's set holds its distinct 5-word shingles (64-bit hashes). Two
documents link when 100 * intersection >= 80 * union. For any global order of
the tokens, linked sets share a token within a prefix of each set, so a
candidate must pass under every order; the filters are intersected before the
full sets are compared:

* order 1: tokens that a sketch counts as rare first, ties by hash. The prefix of
  a set of n has its first n - ceil(0.8 n) + 1 + n // 10 tokens; linked sets of
  n and m share 1 + min(n, m) // 10 or more of these. A set of n leaves out
  ceil(0.8 n) // 10 of them, the commonest by level and then by their exact
  number of documents; as linked sets share more than that, they still share
  a token (the join). The shared ones are counted: as many are needed as the
  overlap leaves no room for elsewhere.
* order 2: as order 1 with ties by another hash. The prefixes of a pair are
  intersected and counted in the same way before any text moves.

A token above the sketch's noise is *hot*. If two sets need a larger overlap
than the hot tokens of either, they also share a token that is not hot, and
as hot tokens come last in order 1, all their other tokens are in the prefixes
as soon as one hot token is. So a set is in the bucket of a hot token only if
hot tokens are 80 % of it, and two sets meet there only if hot tokens alone
could link them: a passage that many documents share makes no pairs of them.
Pairs whose 256-bit parity bitmaps differ in more bits than linked sets of
their sizes have tokens apart never leave the join.

Rarity comes from a count sketch over the shingles of all documents (2**24
counters whatever the input's size). It only steers the order; results don't
depend on it.

Near copies come in groups of any size, so no group is expanded into pairs:

1. equal sets are one class, represented by its smallest doc_id;
2. documents meet in buckets (one per prefix token). In each round every
   member of a bucket is held against a few pivots; pairs that share enough
   prefix tokens are verified. Documents connected so far get one label;
3. a bucket whose members have one label is done. For what is left after the
   pivot rounds, all pairs with different labels are counted over their shared
   buckets and those that pass the counted filter are verified. A pair with
   one label needs no check, as it can't change a component.

Every step is a Spark job over tables in the shared folder; candidates, links
and components never reach the driver, which sees the levels of the sketch
only (16 MB). Texts are read once per round, for the documents of its pairs.

Defined cases: null text, and text without words, is an empty set that links
with nothing; rows with one doc_id are one document to the components; a null
doc_id has a null component and no links; empty tables give empty results;
other columns of the input are not read.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import connected_components, materialize, read_documents

WORDS = 5
#: Similarity as a fraction: NUM / DEN of the union.
NUM, DEN = 80, 100
#: Prefixes are longer by n / SPARE tokens than one shared token needs.
SPARE = 10
PIVOT_ROUNDS = 2
#: Pivots of a bucket in a round; with up to so many members a bucket mostly gives all its pairs.
PIVOTS = 16
#: Open buckets that a member carries to tell whether a pair meets in an earlier one.
FIRSTS = 8
SKETCH_BITS = 24
#: Rarity level from which a token is hot.
HOT = 1
#: Tokens that a task gathers before they are added up.
HELD = 1 << 22
#: Documents (8 MB) or classes (64 MB at most) that are broadcast to find their texts or prefixes; beyond, they are joined.
MAX_BROADCAST_NODES = 1_000_000
SLICES = 64
#: Bytes of text that are shingled at once (about 50 bytes of memory each), and bits of a set's bitmap.
GROUP_BYTES = 1 << 18
BITS = 256


_GOLDEN = 0x9E3779B97F4A7C15


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(32))


#: A random 64-bit number for each byte; capitals of ASCII have that of the small letter.
_BYTES = _mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_GOLDEN))
_BYTES[65:91] = _BYTES[97:123]
_BLANK = np.zeros(256, bool)
_BLANK[[32, 9, 10, 11, 12, 13]] = True
#: Odd multipliers of the positions within a shingle, from the golden ratio's powers.
_FACTORS = np.array([pow(_GOLDEN, 2 * i + 1, 1 << 64) for i in range(WORDS)], np.uint64)
#: Odd base of the polynomial that hashes a word's bytes, modulo 2**64.
_BASE = 0xD6E8FEB86659FD93


class _Powers:
    """Powers of the base and of its inverse, as many as the longest group needed."""

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def to(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        while len(self.up) < n:
            k = len(self.up)
            self.up = np.concatenate([self.up, self.up * np.uint64(pow(_BASE, k, 1 << 64))])
            self.down = np.concatenate([self.down, self.down * np.uint64(pow(_BASE, -k, 1 << 64))])
        return self.up[:n], self.down[:n]


_POWERS = _Powers()


def _word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of texts that lie one after the other, and the first word of each text.

    A word's hash is a polynomial in its bytes, taken from running sums over
    the whole buffer and shifted to the word's start.
    """
    n = len(data)
    if n == 0:
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    up, down = _POWERS.to(n)
    inside = ~_BLANK[data]
    border = np.zeros(n + 1, bool)
    border[offsets] = True
    start = np.flatnonzero(inside & (np.concatenate([[True], ~inside[:-1]]) | border[:-1]))
    end = np.flatnonzero(inside & (np.concatenate([~inside[1:], [True]]) | border[1:])) + 1
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTES[data] * up, dtype=np.uint64)])
    return _mix((sums[end] - sums[start]) * down[start]), np.searchsorted(start, offsets)


def _long_text(data: np.ndarray) -> np.ndarray:
    """Word hashes of one text of any length, taken in blocks that end at a blank."""
    parts, at, n = [], 0, len(data)
    while at < n:
        to = min(at + GROUP_BYTES, n)
        while to < n and not _BLANK[data[to]]:
            ahead = np.flatnonzero(_BLANK[data[to:to + 4096]])
            to = min(to + (int(ahead[0]) if len(ahead) else 4096), n)
        parts.append(_word_hashes(data[at:to], np.array([0, to - at]))[0])
        at = to
    return np.concatenate(parts)


def _few(words: np.ndarray) -> np.ndarray:
    """The whole sequence of fewer words than a shingle has."""
    if not len(words):
        return np.zeros(0, np.uint64)
    h = np.array([len(words)], np.uint64) * np.uint64(_GOLDEN)
    for i in range(len(words)):
        h = _mix(h) + words[i:i + 1] * _FACTORS[i]
    return _mix(h)


def shingle_sets(texts: pa.Array) -> list[np.ndarray]:
    """Sorted distinct hashes of the 5-word shingles of each text (fewer words: of the whole sequence; null: none)."""
    out: list[np.ndarray] = []
    texts = texts.cast(pa.large_string())
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    at = 0
    while at < len(texts):
        to, size = at + 1, int(sizes[at])
        while to < len(texts) and size + sizes[to] <= GROUP_BYTES:
            size += int(sizes[to])
            to += 1
        part = pc.fill_null(texts.slice(at, to - at), "")
        _, ends, data = part.buffers()
        offsets = np.frombuffer(ends, np.int64)[part.offset:part.offset + len(part) + 1]
        data = np.frombuffer(data, np.uint8)[offsets[0]:offsets[-1]] if data is not None else np.zeros(0, np.uint8)
        if len(data) > GROUP_BYTES:                                    # a group of one text
            words = _long_text(data)
            first = np.array([0, len(words)])
        else:
            words, first = _word_hashes(data, offsets - offsets[0])
        n = len(words) - WORDS + 1
        if n > 0:
            h = words[:n] * _FACTORS[0]
            for i in range(1, WORDS):
                h = _mix(h) + words[i:n + i] * _FACTORS[i]
            h = _mix(h)
        for a, b in zip(first.tolist(), first[1:].tolist(), strict=False):
            if b - a < WORDS:
                out.append(_few(words[a:b]))
                continue
            s = np.sort(h[a:b - WORDS + 1])
            out.append(s[np.concatenate([[True], s[1:] != s[:-1]])])
        at = to
    return out


def shingles(text: str | None) -> np.ndarray:
    """:func:`shingle_sets` of one text."""
    return shingle_sets(pa.array([text], pa.large_string()))[0]


def bitmap(s: np.ndarray) -> np.ndarray:
    """Parity of the tokens in each of ``BITS`` classes, as 64-bit numbers.

    Every token that only one of two sets has changes one bit, so the sets
    differ in at least as many tokens as their bitmaps do in bits.
    """
    odd = np.bincount((s >> np.uint64(40) & np.uint64(BITS - 1)).astype(np.int64), minlength=BITS) & 1
    return np.packbits(odd.astype(bool), bitorder="little").view(np.int64)


def probe_size(n: int) -> int:
    """Prefix of a set of n: linked sets of n and m share at least 1 + min(n, m) // SPARE tokens of theirs."""
    return n - -(-NUM * n // DEN) + 1 + n // SPARE


def dropped(n: int) -> int:
    """Commonest prefix tokens that a set of n may leave out, whatever the linked set's size."""
    return -(-NUM * n // DEN) // SPARE


def in_order(sets: np.ndarray, levels: np.ndarray, seed: int) -> np.ndarray:
    """A set's tokens under global order ``seed``: by rarity level, then by a hash of the token."""
    level = levels[(sets & np.uint64(len(levels) - 1)).astype(np.int64)].astype(np.uint64)
    tie = sets if seed == 1 else _mix(sets + np.uint64(seed * 0x9E3779B97F4A7C15 % (1 << 64)))
    return sets[np.argsort((level << np.uint64(58)) | (tie >> np.uint64(6)), kind="stable")]


def may_link(a: np.ndarray, b: np.ndarray, levels: np.ndarray, seed: int) -> bool:
    """Counted prefix filter under one order: False only for sets that don't link."""
    pa_, pb = probe_size(len(a)), probe_size(len(b))
    shared = len(np.intersect1d(in_order(a, levels, seed)[:pa_], in_order(b, levels, seed)[:pb], assume_unique=True))
    need = -(-NUM * (len(a) + len(b)) // (NUM + DEN))
    return shared >= max(1, need - max(len(a) - pa_, len(b) - pb))


def linked(a: np.ndarray, b: np.ndarray) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both > 0 and DEN * both >= NUM * (len(a) + len(b) - both)


# ---------------------------------------------------------------------------
# sets and the rarity sketch
# ---------------------------------------------------------------------------

def _slices(held: list[np.ndarray]):
    """Counts of the gathered tokens by counter, as compressed slices (counts above 255 are clipped)."""
    at = np.concatenate(held)
    sketch, part = np.empty(1 << SKETCH_BITS, np.uint8), 1 << (SKETCH_BITS - 4)
    for i in range(0, len(sketch), part):                     # in parts, as the counts are wider than the sketch
        own = at[(at >= i) & (at < i + part)] - i
        sketch[i:i + part] = np.minimum(np.bincount(own, minlength=part), 255)
    parts = [(i, part) for i, part in enumerate(np.split(sketch, SLICES)) if part.any()]
    return pa.RecordBatch.from_arrays(
        [pa.nulls(len(parts), pa.int64()), pa.nulls(len(parts), pa.int64()), pa.nulls(len(parts), pa.binary()),
         pa.nulls(len(parts), pa.list_(pa.int64())), pa.array([i for i, _ in parts], pa.int32()),
         pa.array([zlib.compress(part.tobytes(), 1) for _, part in parts], pa.binary())],
        names=["doc_id", "n", "sig", "bits", "slice", "counts"])


def _scan(docs: DataFrame) -> DataFrame:
    """One pass: ``(doc_id, n, sig, bits)`` of each document and slices of the sketch of each task's tokens."""
    def run(batches):
        held, held_n = [], 0
        for batch in batches:
            ns, sigs, bits = [], [], []
            for s in shingle_sets(batch.column(1)):
                ns.append(len(s))
                sigs.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                bits.append(bitmap(s) if len(s) else None)
                held.append((s & np.uint64((1 << SKETCH_BITS) - 1)).astype(np.int32))
                held_n += len(s)
            k = batch.num_rows
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(ns, pa.int64()), pa.array(sigs, pa.binary()),
                 pa.array(bits, pa.list_(pa.int64())), pa.nulls(k, pa.int32()), pa.nulls(k, pa.binary())],
                names=["doc_id", "n", "sig", "bits", "slice", "counts"])
            if held_n >= HELD:
                yield _slices(held)
                held, held_n = [], 0
        if held_n:
            yield _slices(held)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text") \
        .mapInArrow(run, "doc_id long, n long, sig binary, bits array<long>, slice int, counts binary")


def _levels(scanned: DataFrame) -> np.ndarray:
    """Rarity level of each counter: 0 within the noise of the mean, then by powers of two above it."""
    mean = float(scanned.agg(F.sum("n")).first()[0] or 0) / (1 << SKETCH_BITS)
    noise = 4 * mean ** 0.5 + 2

    def merge(batches):
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                part = np.frombuffer(zlib.decompress(blob), np.uint8)
                if i not in total:
                    total[i] = np.zeros(len(part), np.uint64)
                total[i] += part
        for i, counts in total.items():
            above = np.maximum(counts - mean, 0) / noise
            level = np.where(above <= 1, 0, 1 + np.floor(np.log2(np.maximum(above, 1)))).clip(0, 63)
            yield pa.RecordBatch.from_pydict({"slice": pa.array([i], pa.int32()),
                                              "level": pa.array([level.astype(np.uint8).tobytes()], pa.binary())})

    rows = scanned.where(F.col("slice").isNotNull()).select("slice", "counts").repartition(SLICES, "slice") \
        .mapInArrow(merge, "slice int, level binary").toLocalIterator()
    levels = np.zeros((SLICES, (1 << SKETCH_BITS) // SLICES), np.uint8)
    for r in rows:
        levels[r["slice"]] = np.frombuffer(r["level"], np.uint8)
    return levels.reshape(-1)


def kept_prefix(s: np.ndarray, levels: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """``(cold tokens, hot tokens, hot tokens before leaving out)`` of a set's probe prefix under order 1.

    Hot tokens are the first to be left out; what is left of them counts only
    for sets that hot tokens alone could link.
    """
    n = len(s)
    first = in_order(s, levels, 1)[:probe_size(n)]
    cold = int((levels[(first & np.uint64(len(levels) - 1)).astype(np.int64)] < HOT).sum())
    in_prefix = len(first) - cold
    if in_prefix == 0 or n - cold < -(-NUM * n // DEN):
        return first[:cold], first[:0], in_prefix
    return first[:cold], first[cold:len(first) - min(in_prefix, dropped(n))], in_prefix


def _prefixes(docs: DataFrame, levels) -> DataFrame:
    """``(doc_id, sig, tokens, marks)`` of each non-empty set: its kept prefix under order 1.

    A mark holds what a bucket has to know of the set and the token in one
    number: set size, hot tokens in the prefix, and whether the token is hot.
    """
    def run(batches):
        for batch in batches:
            ids, sigs, tokens, marks = [], [], [], []
            for i, s in zip(batch.column(0).to_pylist(), shingle_sets(batch.column(1)), strict=True):
                if i is not None and len(s):
                    cold, hot, in_prefix = kept_prefix(s, levels.value)
                    ids.append(i)
                    sigs.append(xxhash.xxh3_128_digest(s.tobytes()))
                    tokens.append(np.concatenate([cold, hot]).view(np.int64))
                    mark = np.full(len(cold) + len(hot), (len(s) << 32 | in_prefix) << 1, np.int64)
                    mark[len(cold):] += 1
                    marks.append(mark)
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(sigs, pa.binary()), pa.array(tokens, pa.list_(pa.int64())),
                 pa.array(marks, pa.list_(pa.int64()))], names=["doc_id", "sig", "tokens", "marks"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text") \
        .mapInArrow(run, "doc_id long, sig binary, tokens array<long>, marks array<long>")


def _needed(n, m):
    """Overlap that links sets of n and m tokens."""
    return F.ceil((n + m) * NUM / (NUM + DEN))


def _behind(n):
    """Tokens of a set of n behind its probe prefix."""
    return F.ceil(n * NUM / DEN) - 1 - F.floor(n / SPARE)


def _left_out(n):
    return F.floor(F.ceil(n * NUM / DEN) / SPARE)


def _candidates(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """``(node, text)`` of the documents of ``pairs``; the texts stay in place where the ids are counted to fit."""
    nodes = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    if nodes.count() <= MAX_BROADCAST_NODES:
        nodes = F.broadcast(nodes)
    return docs.select(F.col("doc_id").cast("long").alias("node"), "text").join(nodes, "node", "left_semi")


def _second_order(pairs: DataFrame, docs: DataFrame, levels) -> DataFrame:
    """Pairs that also share enough of their prefixes under order 2 (a written table)."""
    def run(batches):
        for batch in batches:
            sets = shingle_sets(batch.column(1))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(s) for s in sets], pa.int64()),
                 pa.array([in_order(s, levels.value, 2)[:probe_size(len(s))].view(np.int64) for s in sets],
                          pa.list_(pa.int64()))], names=["node", "n", "second"])

    pairs = materialize(pairs, "first-order-pairs")
    prefixes = materialize(_candidates(pairs, docs).mapInArrow(run, "node long, n long, second array<long>"),
                           "second-prefixes")
    of = [prefixes.select(F.col("node").alias(x), F.col("n").alias(f"n_{x}"), F.col("second").alias(f"second_{x}"))
          for x in ("a", "b")]
    n, m = F.col("n_a"), F.col("n_b")
    need = _needed(n, m) - F.greatest(_behind(n), _behind(m))
    return materialize(pairs.join(of[0], "a").join(of[1], "b").where(
        F.size(F.array_intersect("second_a", "second_b")) >= F.greatest(need, F.lit(1))).select("a", "b"), "candidate-pairs")


def _verify(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """The linked ones among ``pairs(a, b)`` of doc_ids."""
    def run(batches):
        last: tuple = (None, None)
        for batch in batches:
            ga, gb = [], []
            for a, b, ta, tb in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if last[0] != a or last[2] != ta:
                    last = (a, shingles(ta), ta)
                sa, sb = last[1], shingles(tb)
                if linked(sa, sb):
                    ga.append(a)
                    gb.append(b)
            yield pa.RecordBatch.from_pydict({"a": pa.array(ga, pa.int64()), "b": pa.array(gb, pa.int64())})

    texts = materialize(_candidates(pairs, docs), "candidate-texts")
    both = pairs.join(texts.select(F.col("node").alias("b"), F.col("text").alias("tb")), "b") \
        .join(texts.select(F.col("node").alias("a"), F.col("text").alias("ta")), "a") \
        .select("a", "b", "ta", "tb")
    return both.mapInArrow(run, "a long, b long")


#: What a bucket member carries: set size, hot tokens, hot tokens in the kept prefix; and its bitmap.
_MEMBER = ("node", "n", "hot", "hot_kept", "label")
_BITMAP = tuple(f"bits{i}" for i in range(BITS // 64))


def _member(x: str):
    return tuple(F.col(f"{x}.{c}") for c in _MEMBER)


def _needed_shared(n, m, alone, kept_a, kept_b):
    """Kept prefix tokens that linked sets of n and m tokens share where they meet (see :func:`_shared`)."""
    need = _needed(n, m) - F.greatest(_behind(n), _behind(m)) - F.greatest(_left_out(n), _left_out(m))
    return F.greatest(need - F.when(alone, 0).otherwise(F.least(kept_a, kept_b)), F.lit(1))


def _shared(joined: DataFrame, x: str, y: str) -> DataFrame:
    """``(a, b)`` of the joined bucket members that share enough prefix tokens (the counted filter).

    Sets of n and m tokens with prefixes of p and q tokens share at most
    (shared prefix tokens) + max(n - p, m - q); of the shared prefix tokens the
    sets leave out at most as many as the larger one does, as both leave out
    the last ones of one order. Pairs that don't meet in hot buckets are counted
    without them.
    """
    (a, n, hot_a, kept_a, _), (b, m, hot_b, kept_b, _) = _member(x), _member(y)
    low = a < b
    need = _needed_shared(n, m, _hot_alone(n, m, hot_a, hot_b), kept_a, kept_b)
    rows = joined.select(F.when(low, a).otherwise(b).alias("a"), F.when(low, b).otherwise(a).alias("b"),
                         need.alias("need"))
    return rows.groupBy("a", "b").agg(F.count("*").alias("k"), F.first("need").alias("need")) \
        .where(F.col("k") >= F.col("need")).select("a", "b")


def _hot_alone(n, m, hot_a, hot_b):
    """Whether two sets of n and m tokens could be linked by hot tokens only."""
    return F.least(hot_a, hot_b) >= _needed(n, m)


def _fits(x: str, y: str):
    """Whether two bucket members can be linked and have to meet in this bucket, and their labels differ."""
    (_, n, hot_a, _, label_a), (_, m, hot_b, _, label_b) = _member(x), _member(y)
    apart = sum(F.bit_count(F.col(f"{x}.{c}").bitwiseXOR(F.col(f"{y}.{c}"))) for c in _BITMAP)
    return (n * DEN >= m * NUM) & (m * DEN >= n * NUM) & (label_a != label_b) \
        & (~F.col(f"{x}.hot_bucket") | _hot_alone(n, m, hot_a, hot_b)) & (apart <= n + m - 2 * _needed(n, m))


def _pivot_pairs(buckets: DataFrame, seed: int) -> DataFrame:
    """Every member of a bucket with the bucket's pivots: of each hash class of nodes the smallest hash.

    A pivot is mostly the same in all buckets of a group, so that its shared
    tokens are counted; a pair that is missed here is found among all pairs
    later. Work is linear in the members.
    """
    h = F.xxhash64("node", F.lit(seed))
    pivot = buckets.groupBy("token", F.pmod(h, F.lit(PIVOTS)).alias("class")).agg(
        F.min_by(F.struct(*_MEMBER, *_BITMAP), h).alias("p")).select("token", "p.*")
    # of two pivots of a bucket only the pair in one direction
    is_pivot = pivot.select("token", F.col("node"), F.lit(True).alias("chief"))
    members = buckets.join(is_pivot, ["token", "node"], "left")
    once = F.col("m.chief").isNull() | (F.col("m.node") < F.col("p.node"))
    return _shared(members.alias("m").join(pivot.alias("p"), "token").where(once & _fits("m", "p")), "m", "p")


def _all_pairs(buckets: DataFrame) -> DataFrame:
    """All pairs with different labels: members outside a bucket's commonest label with all members.

    Every member carries the first ``FIRSTS`` of its open buckets, cold ones
    before hot ones. A pair with a common one before this bucket meets there and
    is dropped here, so a pair leaves the join about once however many buckets
    it shares. Each different pair is then counted over all its buckets.
    """
    own = buckets.groupBy("node").agg(
        *[F.array_sort(F.collect_set(F.when(F.col("hot_bucket") == hot, F.col("token")))).alias(c)
          for c, hot in (("cold", False), ("hot_tokens", True))],
        *[F.any_value(c).alias(c) for c in ("n", "hot", "hot_kept")])
    own = materialize(own, "open-tokens")
    firsts = own.select("node", F.slice("cold", 1, FIRSTS).alias("cold_firsts"), F.slice("hot_tokens", 1, FIRSTS).alias("hot_firsts"))
    buckets = buckets.join(firsts, "node")
    sizes = buckets.groupBy("token", "label").agg(F.count("*").alias("k"))
    main = sizes.groupBy("token").agg(F.max_by("label", F.struct("k", "label")).alias("main"))
    outside = buckets.join(main, "token").where(F.col("label") != F.col("main"))
    once = (F.col("m.label") == F.col("o.main")) | (F.col("m.node") < F.col("o.node"))
    cold = F.array_intersect("m.cold_firsts", "o.cold_firsts")
    hot = F.array_intersect("m.hot_firsts", "o.hot_firsts")
    before = F.when(F.col("m.hot_bucket"), (F.size(cold) > 0) | F.coalesce(F.array_min(hot) < F.col("m.token"), F.lit(False))) \
        .otherwise(F.coalesce(F.array_min(cold) < F.col("m.token"), F.lit(False)))
    pairs = buckets.alias("m").join(outside.alias("o"), "token").where(once & _fits("m", "o") & ~before)
    a, b = F.col("m.node"), F.col("o.node")
    pairs = materialize(pairs.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).distinct(), "bucket-pairs")
    # the counted filter
    of = [own.select(*[F.col(c).alias(f"{c}_{x}") for c in own.columns]).withColumnRenamed(f"node_{x}", x) for x in ("a", "b")]
    n, m = F.col("n_a"), F.col("n_b")
    alone = _hot_alone(n, m, F.col("hot_a"), F.col("hot_b"))
    shared = F.size(F.array_intersect("cold_a", "cold_b")) \
        + F.when(alone, F.size(F.array_intersect("hot_tokens_a", "hot_tokens_b"))).otherwise(0)
    return pairs.join(of[0], "a").join(of[1], "b") \
        .where(shared >= _needed_shared(n, m, alone, F.col("hot_kept_a"), F.col("hot_kept_b"))).select("a", "b")


def _open_buckets(buckets: DataFrame, labels: DataFrame | None) -> DataFrame:
    """Bucket members with their label, in buckets that have more than one label."""
    if labels is None:
        return buckets.withColumn("label", F.col("node"))
    state = buckets.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    state = materialize(state, "labelled-buckets")
    several = state.groupBy("token").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi")
    return materialize(state.join(several.select("token"), "token"), "open-buckets")


def _buckets(prefixes: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """``(token, hot_bucket, node, n, hot, hot_kept, bits...)``: the kept prefix tokens of each set.

    Tokens of one document only are dropped where they are not hot; hot ones
    need no such count, so no window holds a frequent token. What a set leaves
    out beside hot tokens are its commonest others.
    """
    rows = prefixes.select(F.col("doc_id").alias("node"), F.explode(F.arrays_zip("tokens", "marks")).alias("t")) \
        .select("node", F.col("t.tokens").alias("token"), F.col("t.marks").alias("mark"))
    is_hot = F.col("mark") % 2 == 1
    own = Window.partitionBy("token", F.when(is_hot, F.col("node")))
    rows = rows.withColumn("members", F.count("*").over(own)).where(is_hot | (F.col("members") > 1)).select(
        "token", is_hot.alias("hot_bucket"), "node", F.shiftright("mark", 33).alias("n"),
        F.shiftright("mark", 1).bitwiseAND(F.lit((1 << 32) - 1)).alias("in_prefix"), "members")
    common = Window.partitionBy("node", "hot_bucket").orderBy(F.col("members").desc(), F.col("token").desc())
    n, in_prefix = F.col("n"), F.col("in_prefix")
    quota = F.greatest(_left_out(n) - in_prefix, F.lit(0))
    size = n - _behind(n)                                              # of the probe prefix
    rows = rows.withColumn("nth", F.row_number().over(common)).where(F.col("hot_bucket") | (F.col("nth") > quota))
    return rows.join(bitmaps, "node").select(
        "token", "hot_bucket", "node", "n", *[F.col("bits")[i].alias(c) for i, c in enumerate(_BITMAP)], F.when(in_prefix > 0, n - size + in_prefix).otherwise(0).alias("hot"),
        F.greatest(in_prefix - _left_out(n), F.lit(0)).alias("hot_kept"))


def jaccard_components(docs: DataFrame) -> DataFrame:
    """``(doc_id, n_shingles, component_id)`` of every row of ``docs(doc_id, text)``."""
    spark = docs.sparkSession
    scanned = materialize(_scan(docs), "shingle-sets")
    levels = spark.sparkContext.broadcast(_levels(scanned))
    sets = scanned.where(F.col("slice").isNull()).select("doc_id", "n", "sig", "bits")
    classes = sets.where(F.col("sig").isNotNull() & F.col("doc_id").isNotNull()) \
        .groupBy("sig").agg(F.min("doc_id").alias("node"), F.any_value("bits").alias("bits"))
    classes = materialize(classes, "set-classes")
    reps = classes.select(F.col("node").alias("doc_id"), "sig")
    # prefixes of a class's first document; where classes are counted to fit, the wide rows stay in place
    bitmaps = classes.select("node", "bits")
    if classes.count() <= MAX_BROADCAST_NODES:
        reps, bitmaps = F.broadcast(reps), F.broadcast(bitmaps)
    buckets = materialize(_buckets(_prefixes(docs, levels).join(reps, ["doc_id", "sig"]), bitmaps), "buckets")

    labels = None
    for round_ in range(PIVOT_ROUNDS + 1):
        state = _open_buckets(buckets, labels)
        pairs = _pivot_pairs(state, round_) if round_ < PIVOT_ROUNDS else _all_pairs(state)
        pairs = _second_order(pairs, docs, levels)
        new = materialize(_verify(pairs, docs), "links")
        if labels is not None:
            # a component found so far is a star around its label
            new = new.unionByName(labels.select(F.col("node").alias("a"), F.col("label").alias("b")))
        labels = materialize(connected_components(new, comp="label"), "labels")
    comps = labels.withColumnRenamed("label", "comp")
    member = sets.drop("bits").join(classes.drop("bits"), "sig", "left").join(comps, "node", "left")
    return member.select("doc_id", F.col("n").alias("n_shingles"),
                         F.when(F.col("doc_id").isNotNull(), F.coalesce("comp", "node", "doc_id"))
                         .alias("component_id"))


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Set size and component of every document."""
    return jaccard_components(read_documents(spark, sf_dir).select("doc_id", "text"))


def jaccard_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: of every component the document with the smallest doc_id stays.

    Of repeated rows of one doc_id one stays; rows without a doc_id all stay.
    """
    comps = materialize(jaccard_components(docs), "document-components")
    drop = comps.where(F.col("doc_id") != F.col("component_id")).select("doc_id").distinct()
    kept = docs.join(drop, "doc_id", "left_anti")
    twice = materialize(comps.where(F.col("doc_id").isNotNull()).groupBy("doc_id").count()
                        .where("count > 1").select("doc_id"), "repeated-ids")
    if twice.isEmpty():
        return kept
    once = kept.join(twice, "doc_id", "left_semi").dropDuplicates(["doc_id"])
    return kept.join(twice, "doc_id", "left_anti").unionByName(once)
