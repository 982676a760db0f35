"""Bucketed id table, and the total order of inserts."""

import pytest

from conftest import plan_text
from ragloom.operators import corpus as C
from ragloom.operators import id_table as IT


@pytest.fixture()
def table(spark):
    name = IT.fresh_name()
    yield name
    IT.drop(spark, name)


def _load(spark, rows):
    return spark.createDataFrame(rows, "id string, load_seq long, t string")


def test_insert_needs_no_exchange_of_the_corpus(spark, tmp_dir, table):
    IT.create(spark, table, spark.range(5000).selectExpr("cast(id as string) id"), buckets=8)
    load = _load(spark, [("7", 1, "known"), ("x", 2, "new"), ("x", 1, "first"), ("y", None, "null order")])
    plan = plan_text(IT.absent(load.select("id"), table))
    assert plan.count("Exchange") == 1 and "SortMergeJoin" in plan          # of the load only
    corpus = f"{tmp_dir}/corpus"
    assert IT.insert(load, corpus, table) == 2
    assert sorted(map(tuple, spark.read.parquet(corpus).select("id", "t").collect())) == [("x", "first"), ("y", "null order")]
    assert IT.insert(load, corpus, table) == 0
    assert spark.table(table).count() == 5002
    again = plan_text(IT.absent(load.select("id"), table))
    assert again.count("Exchange") == 1                                     # appended files keep the buckets


def test_repair_after_half_an_insert(spark, tmp_dir, table):
    IT.create(spark, table, spark.range(10).selectExpr("cast(id as string) id"), buckets=4)
    corpus = f"{tmp_dir}/corpus"
    _load(spark, [("a", 1, "x"), ("b", 2, "y")]).select("id", "t").write.parquet(corpus)   # ids were not appended
    assert IT.repair(spark, corpus, table) == 2 and IT.repair(spark, corpus, table) == 0
    assert IT.insert(_load(spark, [("a", 1, "x"), ("c", 1, "z")]), corpus, table) == 1


def test_one_row_per_id_whatever_the_order(spark):
    rows = [("a", None, "x"), ("a", None, "y"), ("b", 2, "x"), ("b", 2, "w"), ("b", None, "v"), ("c", 1, "same"), ("c", 1, "same"),
            (None, 3, "n"), (None, 1, "m"), ("d", 5, None), ("d", 4, None)]
    got = {}
    for parts in (1, 3, 7):
        out = C.first_per_id(_load(spark, rows).repartition(parts)).collect()
        assert len(out) == 5 == len({r["id"] for r in out})
        got[parts] = sorted(map(tuple, out), key=str)
    assert got[1] == got[3] == got[7]
    by = {r[0]: r for r in got[1]}
    assert by["b"][1] == 2 and by[None][2] == "m" and by["d"][1] == 4 and by["c"] == ("c", 1, "same")
    assert C.first_per_id(_load(spark, rows).limit(0)).count() == 0


def test_insert_if_absent_keeps_one_of_equal_rows(spark):
    load = _load(spark, [("a", 1, "x"), ("a", 1, "x"), ("b", None, "y"), ("c", 1, "z")])
    known = spark.createDataFrame([("c",), ("c",)], "id string")
    for bound in (10, 0):
        out = C.rows_to_insert(load, known, max_broadcast_ids=bound).collect()
        assert sorted(map(tuple, out)) == [("a", 1, "x"), ("b", None, "y")]
