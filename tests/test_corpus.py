"""Ingest: positional ids, first-wins, insert-if-absent, contract and report."""

import pytest
from pyspark.sql import functions as F

from conftest import plan_text
from ragloom.operators import corpus as C
from ragloom.plans import ingest as I


def test_positional_ids_are_contiguous_and_ordered(spark):
    df = spark.range(0, 1000).select((F.col("id") * 7 % 1000).alias("k"), F.lit("x").alias("t"))
    out = C.positional_index(df.repartition(13), ["k"], "pos", num_partitions=9)
    rows = sorted((r.k, r.pos) for r in out.collect())
    assert [p for _, p in rows] == list(range(1000))
    ids = C.positional_ids(df, ["k"]).orderBy("k").select("id").collect()
    assert ids[0].id == "q_0" and ids[-1].id == "q_999"


def test_first_row_per_id_wins_within_a_load(spark):
    load = spark.createDataFrame([("q_1", "b", 2), ("q_1", "a", 1), ("q_2", "c", 3)],
                                 "id string, input string, load_seq int")
    got = {r.id: r.input for r in C.first_per_id(load).collect()}
    assert got == {"q_1": "a", "q_2": "c"}


def test_hot_id_collapses_map_side(spark):
    # a third of the load on one id: the aggregate has a partial step before the shuffle
    load = spark.range(0, 3000).select(
        F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.col("id").cast("string")).alias("id"),
        F.col("id").alias("load_seq"), F.lit("t").alias("input"))
    out = C.first_per_id(load)
    assert "partial_min" in plan_text(C._winner_keys(load, "id", "load_seq"))
    assert out.where("id = 'hot'").first().load_seq == 0


def test_insert_if_absent_is_idempotent(spark, tmp_dir):
    path = f"{tmp_dir}/corpus"
    corpus = spark.createDataFrame([("q_1", "old", 0)], "id string, input string, load_seq int")
    C.insert_if_absent(corpus, path)
    load = spark.createDataFrame([("q_1", "new", 1), ("q_2", "b", 2)], "id string, input string, load_seq int")
    C.insert_if_absent(load, path)
    C.insert_if_absent(load, path)
    got = {r.id: r.input for r in spark.read.parquet(path).collect()}
    assert got == {"q_1": "old", "q_2": "b"}
    rep = C.load_report(load, spark.read.parquet(path)).first()
    assert (rep.attempted, rep.distinct_ids, rep.already_present, rep.inserted) == (2, 2, 2, 0)


def test_contract_counts_each_violation(spark):
    rows = [("a", [1.0] * 4), ("a", [1.0] * 4), (None, [1.0] * 4), ("b", [1.0] * 3),
            ("c", None), ("d", [1.0, float("nan"), 0.0, 0.0]), ("e", [1.0, None, 0.0, 0.0])]
    df = spark.createDataFrame(rows, "id string, embedding array<float>")
    r = C.contract_report(df, 4).first().asDict()
    assert r == {"rows": 7, "null_id": 1, "duplicate_id": 1, "wrong_dim": 1, "null_vector": 1,
                 "bad_element": 2}
    with pytest.raises(ValueError):
        C.assert_contract(df, 4)


def test_ingest_plan_embeds_only_new_rows(spark, tmp_dir):
    path = f"{tmp_dir}/qa"
    calls = []

    class Counting:
        def __call__(self, texts):
            calls.append(len(texts))
            return [[float(len(t)), 1.0] for t in texts]

    raw = spark.createDataFrame([("가", None, 0), ("나", "b", 1)], "input string, output string, o int")
    rep = I.ingest(I.prepare(raw, ["o"]), path, dim=2, embedder=Counting()).first()
    assert rep.inserted == 2
    got = {r.id: (r.input, r.output) for r in spark.read.parquet(path).collect()}
    assert got == {"q_0": ("가", ""), "q_1": ("나", "b")}
    raw2 = spark.createDataFrame([("가", None, 0), ("나", "b", 1), ("다", "c", 2)],
                                 "input string, output string, o int")
    rep2 = I.ingest(I.prepare(raw2, ["o"]), path, dim=2, embedder=Counting()).first()
    assert (rep2.already_present, rep2.inserted) == (2, 1)
    assert spark.read.parquet(path).count() == 3


def test_insert_both_join_strategies_agree(spark):
    load = spark.range(0, 500).select((F.col("id") % 300).cast("string").alias("id"),
                                      F.col("id").alias("load_seq"))
    corpus = spark.range(0, 1000, 7).select(F.col("id").cast("string").alias("id"))
    small = C.rows_to_insert(load, corpus)
    big = C.rows_to_insert(load, corpus, max_broadcast_ids=10)
    assert "BroadcastHashJoin" in plan_text(small)
    assert sorted(map(tuple, small.collect())) == sorted(map(tuple, big.collect()))
    assert small.count() == 300 - len([i for i in range(0, 300) if i % 7 == 0])


def test_positional_ranges_scale_with_input(spark, tmp_dir):
    """More input than one split per range: the range count follows the input size."""
    src = f"{tmp_dir}/pairs"
    spark.read.parquet("/root/testdata/sf0.01/conversations.parquet").write.parquet(src)
    df = spark.read.parquet(src)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16k")
    try:
        from ragloom.sources.sizing import scan_tasks
        n = scan_tasks(df)
        assert n > 8
        out = C.positional_index(df, ["conv_id", "turn"])
        pos = sorted(r.pos for r in out.select("pos").collect())
        assert pos == list(range(df.count()))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
