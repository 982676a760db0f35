"""Fill-in-middle: contract, round trips, defined cases."""

import hashlib
import random

import duckdb
import pytest

from conftest import SF_MID
from ragloom.llm import op11_fim as S


def by_hand(doc_id, text):
    """The contract, word for word."""
    t = text or ""
    n, digits = len(t), hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digits[i:i + 8], 16) for i in (0, 8, 16, 24)]
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if t == "" or "<P>" in t or "<S>" in t or "<M>" in t or h[2] % 100 >= 90:
        return (doc_id, n, "plain", None, None, t)
    if h[3] % 100 < 20:
        return (doc_id, n, "spm", a, b - a, "<S>" + t[b:] + "<P>" + t[:a] + "<M>" + t[a:b])
    return (doc_id, n, "psm", a, b - a, "<P>" + t[:a] + "<S>" + t[b:] + "<M>" + t[a:b])


def test_query_equals_sql_on_all_documents(spark):
    got = sorted(tuple(r) for r in S.op11_fim(spark, SF_MID).collect())
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{SF_MID}/documents.parquet'")
    assert got == sorted(con.sql(S.SQL).fetchall())
    assert {r[2] for r in got} == {"plain", "psm", "spm"}


CASES = [(1, None), (2, ""), (3, "x"), (4, "a <M> b" * 40), (None, "no id, one text"), (7, "twice"), (7, "twice"),
         (8, "<P"), (9, "P><S"), (10, "é漢🙂" * 50), (11, "long " * 200_000), (12, "\x00\n\r\t"), (13, "a<b>c<<P>>")]


def test_defined_cases(spark):
    rnd = random.Random(5)
    rows = CASES + [(i, "".join(rnd.choice("ab <PSM>é🙂") for _ in range(rnd.randrange(12)))) for i in range(50, 400)]
    df = spark.createDataFrame([(i, t, "z", 1) for i, t in rows], "doc_id long, text string, output string, n int")
    made = S.fill_in_middle(df)
    want = sorted((by_hand(i, t) for i, t in rows), key=str)
    assert sorted((tuple(r)[:6] for r in made.collect()), key=str) == want
    back = S.restored(made, ["doc_id", "form", "output_sha256"]).collect()
    assert sorted((r["restored"], str(r["doc_id"])) for r in back) == sorted((t or "", str(i)) for i, t in rows)
    for r in back:
        assert r["restored_sha256"] == hashlib.sha256(r["restored"].encode()).hexdigest()
    assert S.fill_in_middle(df.limit(0)).count() == 0


def test_piece_table():
    t = S.PieceTable("abcdef")
    t.cut(6), t.cut(0), t.cut(3)
    assert t.text() == "abcdef" and [p.length for p in t.pieces] == [0, 3, 3, 0]
    with pytest.raises(ValueError):
        t.cut(7)
    for doc_id in range(300):
        table, form, *_ = S.transform(doc_id, "some text that is cut")
        assert table.buffers[0] == "some text that is cut"      # the buffer is never edited
        assert S.restore(table.text(), form).text() == "some text that is cut"
        assert table.sha256() == hashlib.sha256(table.text().encode()).hexdigest()
