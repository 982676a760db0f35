"""Prefix trie: whole table against SQL, random conversations against brute force, defined cases."""

import hashlib
import random
import re
import zlib

import duckdb

from conftest import SF_MID
from ragloom.llm import op13_prefix_trie as S

SCHEMA = "conv_id long, turn long, role string, text string"


def brute(rows):
    convs = {}
    for c, turn, role, text in rows:
        if c is not None:
            convs.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(ts)] for c, ts in convs.items()}
    built = {}
    for c, ts in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = c - (c % 20 if c >= 0 else -(-c % 20))
        built[c] = tuple(own.get(base, [])[:h] + ts[h:])
    nodes = {}
    for c, ts in built.items():
        for d in range(len(ts) + 1):
            nodes.setdefault(ts[:d], []).append(c)
    kids, leaves, saved = {}, dict.fromkeys(nodes, 0), dict.fromkeys(nodes, 0)
    for path in nodes:
        if path:
            kids[path[:-1]] = kids.get(path[:-1], 0) + 1
    for path, members in nodes.items():
        worth = (len(members) - 1) * len(re.findall(r"[^\x20\x09-\x0d]+", path[-1][1])) if path else 0
        for d in range(len(path) + 1):
            leaves[path[:d]] += path not in kids
            saved[path[:d]] += worth
    return sorted(((min(m), len(p), min(nodes[p[:-1]]) if p else None, len(m), kids.get(p, 0), leaves[p], saved[p],
                    hashlib.sha256(",".join(str(c) for c in sorted(m) if built[c] == p).encode()).hexdigest())
                   for p, m in nodes.items()), key=str)


def result(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_query_equals_sql_on_all_conversations(spark):
    got = S.op13_prefix_trie(spark, SF_MID)
    assert got.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
                           "ends_sha256"]
    con = duckdb.connect()
    con.sql(f"CREATE VIEW conversations AS SELECT * FROM '{SF_MID}/conversations.parquet'")
    assert result(got) == sorted(con.sql(S.SQL).fetchall(), key=str)


def test_random_conversations_in_small_shards_and_bands(spark):
    rnd = random.Random(13)
    rows = []
    for c in [*range(0, 60), *range(-45, 0, 7), 10**12, 10**12 + 3, 10**12 + 7]:
        for turn in range(rnd.choice([1, 1, 2, 3, 5, 9])):
            rows.append((c, turn, rnd.choice("ua"), rnd.choice(["x", "y z", "x"])))
    rows += [(200 + c, t, "u", "the same") for c in range(40) for t in range(4)]        # a large group of copies
    rows += [(400, t, "u", f"{t % 2}") for t in range(150)] + [(401, t, "u", f"{t % 2}") for t in range(149)]
    want = brute(rows)
    df = spark.createDataFrame(rows, SCHEMA)
    assert result(S.prefix_trie(df)) == want
    for band, shard in ((2, 3), (7, 1), (1, 50), (64, 10)):
        assert result(S.prefix_trie(df, band, shard)) == want


def test_defined_cases(spark):
    rows = [(None, 1, "u", "no conversation"), (20, None, "u", "first"), (20, 0, None, None), (20, 0, None, None),
            (21, 5, "b", "tie"), (21, 5, "a", "tie"), (21, 5, "a", "tea"), (39, 1, "u", "long " * 100_000), (40, 1, "u", ""),
            (1, 1, "u", "only"), (2, 1, "u", "only"), (3, 1, "u", "only"), (61, 1, "u", "no base"), (61, 2, "u", "c\td\n")]
    df = spark.createDataFrame([(*r, "z", 1) for r in rows], SCHEMA + ", code string, pos int")
    assert result(S.prefix_trie(df)) == brute(rows)
    assert S.prefix_trie(df.limit(0)).count() == 0
    assert result(S.prefix_trie(df.limit(1))) == []


def test_packed_ids():
    for ids in ([5], [-3, -1, 0, 7], list(range(1000, 3000)), [-2**63, 2**63 - 1], [0, 10**15]):
        assert S.unpack_ids(S.pack_ids(ids)) == ids
    assert S.pack_ids(list(range(2000)))[:1] == b"b" and S.pack_ids([0, 10**9])[:1] == b"n"
