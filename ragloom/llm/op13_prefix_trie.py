"""Prefix trie of conversations from vertical bitmaps.

Every turn of a conversation becomes a code, the MD5 of its position, role and
text. Conversations are cut into units of up to ``BAND`` turns, sorted by band,
what comes before the band, path and conv_id, and dealt by that order, so that
conversations with a common beginning lie side by side. Each task cuts its
rows into shards of ``SHARD`` units.

In a shard a bitmap per (position, turn) says which of its conversations have
the turn there. The trie is read off depth-first: the bitset of a node and the
posting of a turn at the next position intersect to the child's bitset, its
popcount is the number of members, and the members without a next turn are the
node's end list.

A node lies in several shards only if it holds the first or last unit of one,
or a conversation that goes on in the next band. These *edge* nodes, a few per
shard, are written as partial rows and added up by their key (depth and sums of
the codes of the path). All others are final at once. Sums over subtrees of
edge nodes use pointer jumping, in as many rounds as the depth has bits. End
lists of edge nodes travel as bitmaps of ids in ascending order; one hash runs
over them as a stream.

So nothing grows with a group: a first turn or a whole conversation that a
third of all rows share is spread over shards by what follows or by conv_id, a
very long conversation over bands. One conversation's own rows are numbered in
one task (an external sort, without its texts behind it).

Defined cases: rows with a null conv_id are left out; a null role or text is
empty; equal turn numbers are ordered by role and text, repeated rows all
stay; a conversation without rebuilt turns ends at the root; an empty table
gives an empty result; other columns of the input are not read.
"""

from __future__ import annotations

import hashlib
import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, read_documents

#: Fixed values of the contract: conversations of a family, and most turns taken over from its first.
FAMILY, MAX_HEAD = 20, 4
WORD = r"[^\x20\x09-\x0D]+"
#: Turns of a unit; units of a shard.
BAND, SHARD = 64, 2048
#: Edge nodes whose conv_ids are broadcast to their children; more are joined by a shuffle.
MAX_BROADCAST_EDGES = 200_000
CODE = 16


# ---------------------------------------------------------------------------
# rebuilt conversations
# ---------------------------------------------------------------------------

def rebuilt_turns(conversations: DataFrame) -> DataFrame:
    """``(base, conv_id, pos, code, words)``: turns from position 1, and a row of position 0 for each conversation.

    The first turns of a family's first conversation are handed to all its
    members where they lie, in one shuffle by family.
    """
    rows = conversations.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").alias("turn"),
        F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")) \
        .withColumn("base", F.col("conv_id") - F.col("conv_id") % FAMILY).repartition("base")
    order = Window.partitionBy("base", "conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    own = rows.withColumn("pos", F.row_number().over(order).cast("long")).select(
        "base", "conv_id", "pos",
        F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text")).alias("body"),
        F.regexp_count("text", F.lit(WORD)).cast("long").alias("words"))
    first = F.when((F.col("conv_id") == F.col("base")) & (F.col("pos") < MAX_HEAD), F.struct("pos", "body", "words"))
    own = own.withColumn("head", F.array_sort(F.collect_list(first).over(Window.partitionBy("base")))) \
        .withColumn("h", F.crc32(F.col("conv_id").cast("string")) % MAX_HEAD) \
        .withColumn("head", F.slice("head", F.lit(1), F.col("h").cast("int")))
    start = F.array(F.struct(F.lit(0).cast("long").alias("pos"), F.lit("").alias("body"),
                             F.lit(0).cast("long").alias("words")))
    none = F.array().cast("array<struct<pos:bigint,body:string,words:bigint>>")
    moved = F.struct((F.col("pos") - F.col("h") + F.size("head")).alias("pos"), "body", "words")
    turns = own.select("base", "conv_id", F.explode(F.concat(
        F.when(F.col("pos") == 1, F.concat(start, "head")).otherwise(none),
        F.when(F.col("pos") > F.col("h"), F.array(moved)).otherwise(none))).alias("t"))
    code = F.when(F.col("t.pos") > 0, F.md5(F.concat(F.col("t.pos").cast("string"), F.lit(":"), F.col("t.body")))) \
        .otherwise("")
    return turns.select("base", "conv_id", F.col("t.pos").alias("pos"), code.alias("code"), F.col("t.words").alias("words"))


def units(turns: DataFrame, band: int = BAND) -> DataFrame:
    """``(conv_id, band, entry, path, words, ends)``: conversations in bands of turns.

    ``entry`` holds the four sums of the 32-bit groups of all codes before the band.
    """
    sums = [F.sum(F.coalesce(F.conv(F.substring("code", 8 * i + 1, 8), 16, 10).cast("long"), F.lit(0))).alias(f"s{i}")
            for i in range(4)]
    of_band = F.floor(F.greatest(F.col("pos") - 1, F.lit(0)) / band)
    parts = turns.groupBy("base", "conv_id", of_band.alias("band")).agg(
        F.array_sort(F.collect_list(F.struct("pos", "code", "words"))).alias("t"), *sums)
    order = Window.partitionBy("base", "conv_id").orderBy("band")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    entry = F.concat_ws(",", *[F.coalesce(F.sum(f"s{i}").over(before), F.lit(0)).cast("string") for i in range(4)])
    return parts.select(
        "conv_id", "band", entry.alias("entry"), F.unhex(F.array_join("t.code", "")).alias("path"),
        F.filter("t", lambda t: t["pos"] > 0)["words"].alias("words"),
        F.lead("band").over(order).isNull().alias("ends"))


# ---------------------------------------------------------------------------
# trie of a shard
# ---------------------------------------------------------------------------

def pack_ids(ids: list[int]) -> bytes:
    """Ascending ids as a bitmap, or as numbers where they lie far apart."""
    a = np.array(ids, np.int64)
    span = int(ids[-1]) - int(ids[0])
    if span >= 64 * len(ids):
        return b"n" + a.tobytes()
    bits = np.zeros(span + 1, bool)
    bits[a - a[0]] = True
    return b"b" + struct.pack("<q", ids[0]) + np.packbits(bits, bitorder="little").tobytes()


def unpack_ids(blob: bytes) -> list[int]:
    if blob[:1] == b"n":
        return np.frombuffer(blob, np.int64, offset=1).tolist()
    first, = struct.unpack_from("<q", blob, 1)
    return (np.flatnonzero(np.unpackbits(np.frombuffer(blob, np.uint8, offset=9), bitorder="little")) + first).tolist()


def ids_sha256(ids: list[int]) -> str:
    return hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()


def _bits(bitset: int):
    while bitset:
        low = bitset & -bitset
        yield low.bit_length() - 1
        bitset ^= low


#: Columns of a node row; what they say of edge nodes is partial.
NODE_SCHEMA = ("edge boolean, key binary, up binary, conv_id long, depth long, parent_conv_id long, n_convs long, "
               "n_children long, n_leaves long, saved_tokens long, words long, ends_sha256 string, "
               "first_end long, ends binary")


def _group_nodes(conv_ids: list[int], paths: list[bytes], words: list, ends: list[bool], depth0: int,
                 entry: tuple[int, ...], outermost: int):
    """Node rows of the units of one band with one entry; ``outermost`` are the bits that make a node an edge."""
    n = len(paths)
    postings: dict[tuple[int, bytes], int] = {}
    going = [0] * (max(len(p) for p in paths) // CODE + 2)            # units with a turn at each position
    for i, path in enumerate(paths):
        bit = 1 << i
        for d in range(len(path) // CODE):
            turn = (d, path[CODE * d:CODE * d + CODE])
            postings[turn] = postings.get(turn, 0) | bit
            going[d] |= bit
        if not ends[i]:
            outermost |= bit
    everyone = (1 << n) - 1
    members, depth, parent, unit, key = [], [], [], [], []
    stack = [(everyone, 0, -1, 0)]
    while stack:                                                     # depth-first; a parent comes before its children
        bitset, d, above, i = stack.pop()
        me = len(members)
        members.append(bitset), depth.append(d), parent.append(above), unit.append(i)
        if above < 0:
            key.append(entry)
        elif bitset & outermost:
            code = struct.unpack_from(">4I", paths[i], CODE * (d - 1))
            key.append(tuple(a + b for a, b in zip(key[above], code, strict=True)))
        else:
            key.append(None)
        rest = bitset & going[d]
        while rest:
            i = (rest & -rest).bit_length() - 1
            child = bitset & postings[d, paths[i][CODE * d:CODE * d + CODE]]
            stack.append((child, d + 1, me, i))
            rest &= ~child
    size = len(members)
    lowest: list[int | None] = [None] * size
    children, leaves, saved = [0] * size, [0] * size, [0] * size
    ended = [[conv_ids[i] for i in _bits(members[v] & ~going[depth[v]]) if ends[i]] for v in range(size)]
    for v in reversed(range(size)):
        inner = key[v] is None
        at_band = depth[v] == 0 and depth0 > 0                       # counted by the band above
        own = [conv_ids[i] for i in _bits(members[v] & ~going[depth[v]])]
        if own and not at_band:
            lowest[v] = own[0] if lowest[v] is None else min(own[0], lowest[v])
        if inner:
            weight = words[unit[v]][depth[v] - 1]
            leaves[v] = leaves[v] if children[v] else 1
            saved[v] += (members[v].bit_count() - 1) * weight
        if (p := parent[v]) >= 0:
            lowest[p] = lowest[v] if lowest[p] is None else min(lowest[p], lowest[v])
            if inner:
                children[p] += 1
                leaves[p] += leaves[v]
                saved[p] += saved[v]
    packed = [None if k is None else struct.pack(">q4q", depth0 + d, *k) for k, d in zip(key, depth, strict=True)]
    for v in range(size):
        p, inner = parent[v], key[v] is None
        at_band = depth[v] == 0 and depth0 > 0
        up = packed[p] if p >= 0 else None
        yield (not inner, packed[v], up, None if at_band else lowest[v], depth0 + depth[v],
               lowest[p] if inner and up is None else None, 0 if at_band else members[v].bit_count(),
               children[v], leaves[v], saved[v], words[unit[v]][depth[v] - 1] if depth[v] else 0,
               ids_sha256(ended[v]) if inner else None,
               ended[v][0] if ended[v] and not inner else None, pack_ids(ended[v]) if ended[v] and not inner else None)


def _shard_nodes(shard: list[tuple], band_turns: int):
    """Node rows of consecutive units ``(conv_id, band, entry, path, words, ends)``."""
    at = 0
    while at < len(shard):
        to = at
        while to < len(shard) and shard[to][1:3] == shard[at][1:3]:
            to += 1
        outermost = (1 if at == 0 else 0) | (1 << (to - at - 1) if to == len(shard) else 0)
        conv_ids, bands, entries, paths, words, ends = (list(c) for c in zip(*shard[at:to], strict=True))
        yield from _group_nodes(conv_ids, paths, words, ends, bands[0] * band_turns,
                                tuple(map(int, entries[0].split(","))), outermost)
        at = to


def shard_nodes(sorted_units: DataFrame, band: int = BAND, shard: int = SHARD) -> DataFrame:
    """Nodes of each shard of the sorted units."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string
    schema = to_arrow_schema(_parse_datatype_string(NODE_SCHEMA))

    def emit(held):
        cols = list(zip(*_shard_nodes(held, band), strict=True))
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)

    def run(batches):
        held = []
        for batch in batches:
            held += zip(*(c.to_pylist() for c in batch.columns), strict=True)
            while len(held) >= shard:
                yield emit(held[:shard])
                held = held[shard:]
        if held:
            yield emit(held)

    return sorted_units.select("conv_id", "band", "entry", "path", "words", "ends").mapInArrow(run, NODE_SCHEMA)


# ---------------------------------------------------------------------------
# edge nodes
# ---------------------------------------------------------------------------

def _end_hashes(parts: DataFrame) -> DataFrame:
    """``(key, ends_sha256)``: a hash over each node's end lists, one part in memory at a time."""
    def run(batches):
        key, digest = None, None
        for batch in batches:
            done = []
            for k, blob in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if k != key:
                    if key is not None:
                        done.append((key, digest.hexdigest()))
                    key, digest = k, hashlib.sha256()
                else:
                    digest.update(b",")
                digest.update(",".join(map(str, unpack_ids(blob))).encode())
            yield pa.RecordBatch.from_pydict({"key": pa.array([d[0] for d in done], pa.binary()),
                                              "ends_sha256": pa.array([d[1] for d in done], pa.string())})
        if key is not None:
            yield pa.RecordBatch.from_pydict({"key": pa.array([key], pa.binary()),
                                              "ends_sha256": pa.array([digest.hexdigest()], pa.string())})

    return parts.repartition("key").sortWithinPartitions("key", "first_end").select("key", "ends") \
        .mapInArrow(run, "key binary, ends_sha256 string")


def _subtree_sums(edges: DataFrame) -> DataFrame:
    """``(key, n_leaves, saved_tokens)`` over whole subtrees of ``edges(key, up, depth, n_leaves, saved_tokens)``.

    Pointer jumping: after round i a node has the sum of its descendants
    nearer than 2**i and points at its ancestor that far up.
    """
    state = edges.select("key", F.col("up").alias("far"), "n_leaves", "saved_tokens")
    for _ in range(int(edges.agg(F.max("depth")).first()[0] or 0).bit_length()):
        below = state.where(F.col("far").isNotNull()).groupBy(F.col("far").alias("key")).agg(
            F.sum("n_leaves").alias("more_leaves"), F.sum("saved_tokens").alias("more_saved"))
        jump = state.select(F.col("key").alias("far"), F.col("far").alias("farther"))
        state = materialize(state.join(below, "key", "left").join(jump, "far", "left").select(
            "key", F.col("farther").alias("far"),
            (F.col("n_leaves") + F.coalesce("more_leaves", F.lit(0))).alias("n_leaves"),
            (F.col("saved_tokens") + F.coalesce("more_saved", F.lit(0))).alias("saved_tokens")), "subtree-sums")
    return state.select("key", "n_leaves", "saved_tokens")


def prefix_trie(conversations: DataFrame, band: int = BAND, shard: int = SHARD) -> DataFrame:
    """All nodes of the trie over the rebuilt conversations of ``conversations(conv_id, turn, role, text)``."""
    order = ["band", "entry", "path", "conv_id"]
    cut = materialize(units(rebuilt_turns(conversations), band), "trie-units")
    nodes = materialize(shard_nodes(cut.repartitionByRange(*order).sortWithinPartitions(*order), band, shard), "trie-nodes")
    partial = nodes.where("edge")
    edges = partial.groupBy("key").agg(
        F.max("up").alias("up"), F.min("conv_id").alias("conv_id"), F.max("depth").alias("depth"),
        F.sum("n_convs").alias("n_convs"), F.sum("n_children").alias("n_children"), F.sum("n_leaves").alias("n_leaves"),
        F.sum("saved_tokens").alias("saved_tokens"), F.max("words").alias("words"))
    edges = materialize(edges, "trie-edges")
    below = edges.where(F.col("up").isNotNull()).groupBy(F.col("up").alias("key")).agg(F.count("*").alias("edge_children"))
    edges = edges.join(below, "key", "left") \
        .withColumn("n_children", F.col("n_children") + F.coalesce("edge_children", F.lit(0))) \
        .withColumn("n_leaves", F.when(F.col("n_children") == 0, 1).otherwise(F.col("n_leaves"))) \
        .withColumn("saved_tokens", F.col("saved_tokens") + (F.col("n_convs") - 1) * F.col("words"))
    edges = materialize(edges.drop("edge_children", "words"), "trie-edges")
    parents = edges.select(F.col("key").alias("up"), F.col("conv_id").alias("above"))
    if edges.count() <= MAX_BROADCAST_EDGES:
        parents = F.broadcast(parents)
    whole = edges.drop("n_leaves", "saved_tokens").join(_subtree_sums(edges), "key") \
        .join(_end_hashes(partial.where(F.col("ends").isNotNull())), "key", "left") \
        .withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(ids_sha256([])))) \
        .join(parents, "up", "left").withColumn("parent_conv_id", F.col("above"))
    inner = nodes.where(~F.col("edge"))
    under = inner.where(F.col("up").isNotNull()).join(parents, "up").withColumn("parent_conv_id", F.col("above"))
    out = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return inner.where(F.col("up").isNull()).select(*out).unionByName(under.select(*out)).unionByName(whole.select(*out))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every node of the trie of rebuilt conversations."""
    return prefix_trie(read_documents(spark, sf_dir, "conversations"))


SQL = r"""
WITH t AS (SELECT conv_id AS c, coalesce(role, '') AS r, coalesce(text, '') AS x,
                  row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS p
           FROM conversations WHERE conv_id IS NOT NULL),
digits AS (SELECT c, i, CAST(ascii(substr(CAST(c AS VARCHAR), i, 1)) AS BIGINT) AS byte
           FROM (SELECT DISTINCT c FROM t), unnest(range(1, 21)) AS u(i) WHERE i <= length(CAST(c AS VARCHAR))),
crc AS (SELECT c, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list(byte ORDER BY i)),
                  lambda a, b: list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0],
                                           lambda y, z: xor(y >> 1, (y & 1) * 3988292384))) AS v FROM digits GROUP BY c),
ids AS (SELECT c, c - c % 20 AS base, xor(v, CAST(4294967295 AS BIGINT)) % 4 AS h FROM crc),
heads AS (SELECT ids.c, p, r, x FROM ids JOIN t ON t.c = base WHERE p <= h),
taken AS (SELECT c, count(*) AS k FROM heads GROUP BY c),
turns AS (SELECT * FROM heads UNION ALL
          SELECT t.c, p - h + coalesce(k, 0), r, x FROM t JOIN ids ON t.c = ids.c LEFT JOIN taken ON t.c = taken.c WHERE p > h),
tokens AS (SELECT c, p, md5(length(r) || ':' || r || x) AS e, len(regexp_extract_all(x, '[^\x20\x09-\x0D]+')) AS w FROM turns),
paths AS (SELECT ids.c, coalesce(any_value(path), []) AS path, any_value(ws) AS ws
          FROM ids LEFT JOIN (SELECT c, list(e ORDER BY p) AS path, list(w ORDER BY p) AS ws FROM tokens GROUP BY c) AS q
          ON ids.c = q.c GROUP BY ids.c),
members AS (SELECT c, d, md5(array_to_string(path[1:d], ',')) AS node, CASE WHEN d > 0 THEN md5(array_to_string(path[1:d - 1], ',')) END AS up,
                   CASE WHEN d > 0 THEN ws[d] ELSE 0 END AS w, len(path) = d AS ends
            FROM paths, unnest(range(0, len(path) + 1)) AS u(d)),
nodes AS (SELECT node, d, any_value(up) AS up, min(c) AS conv_id, count(*) AS n_convs, any_value(w) AS w,
                 string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (WHERE ends) AS ended FROM members GROUP BY node, d),
kids AS (SELECT up AS node, count(*) AS n_children FROM nodes WHERE up IS NOT NULL GROUP BY up),
pairs AS (SELECT DISTINCT a.node AS top, b.node FROM members AS a JOIN members AS b ON a.c = b.c AND a.d <= b.d),
sums AS (SELECT top AS node, count(*) FILTER (WHERE n_children IS NULL) AS n_leaves, sum((n_convs - 1) * w) AS saved
         FROM pairs JOIN nodes USING (node) LEFT JOIN kids USING (node) GROUP BY top)
SELECT n.conv_id, n.d AS depth, p.conv_id AS parent_conv_id, n.n_convs, coalesce(n_children, 0) AS n_children, n_leaves,
       CAST(saved AS BIGINT) AS saved_tokens, sha256(coalesce(n.ended, '')) AS ends_sha256
FROM nodes AS n LEFT JOIN nodes AS p ON n.up = p.node LEFT JOIN kids ON n.node = kids.node JOIN sums ON n.node = sums.node
"""
