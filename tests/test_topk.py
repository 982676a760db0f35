"""Exact top-k: brute force, both physical forms, edge cases, properties, plan shape."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL, plan_text
from ragloom.operators import topk as K
from ragloom.sources.sizing import scan_tasks
from ragloom.sources import testdata as TD


def _corpus(spark, rows):
    return spark.createDataFrame(rows, "id string, embedding array<float>")


def _queries(spark, rows):
    return spark.createDataFrame(rows, "qid string, qvec array<float>")


def _brute(corpus_rows, query_rows, k, exclude=None):
    out = []
    for qid, qv in query_rows:
        q = np.asarray(qv, dtype=np.float64)
        scored = []
        for cid, cv in corpus_rows:
            if exclude and cid == qid:
                continue
            c = np.asarray(cv, dtype=np.float64) if cv is not None else np.zeros_like(q)
            den = np.sqrt(c @ c * (q @ q))
            s = None if den == 0 else float(np.clip(c @ q / den, -1, 1))
            scored.append((cid, s))
        scored.sort(key=lambda t: (t[1] is None, -(t[1] or 0), t[0]))
        out += [(qid, r + 1, cid, s) for r, (cid, s) in enumerate(scored[:k])]
    return out


def _rows(df):
    return [(r.qid, r.rk, r.id, None if r.score is None else round(r.score, 9))
            for r in df.orderBy("qid", "rk").collect()]


@pytest.mark.parametrize("form", ["broadcast", "blocked"])
def test_matches_brute_force(spark, form):
    rng = np.random.default_rng(7)
    crow = [(f"c{i:03d}", rng.normal(size=8).astype(np.float32).tolist()) for i in range(60)]
    qrow = [(f"q{i}", rng.normal(size=8).astype(np.float32).tolist()) for i in range(9)]
    kw = dict(corpus_block_rows=7, query_block_rows=4) if form == "blocked" else {}
    got = _rows(K.top_k(_corpus(spark, crow), _queries(spark, qrow), 5, form=form, **kw))
    want = [(q, r, c, round(s, 9)) for q, r, c, s in _brute(crow, qrow, 5)]
    assert got == want


def test_forms_agree_on_test_table(spark):
    vc = TD.vector_corpus(spark, SF_SMALL)
    q = TD.vector_queries(vc)
    a = _rows(K.top_k(vc, q, 5, exclude_col="self_id", form="broadcast"))
    b = _rows(K.top_k(vc, q, 5, exclude_col="self_id", form="blocked",
                      corpus_block_rows=100, query_block_rows=64))
    assert a == b
    assert len(a) == 5 * vc.count()
    assert all(r[0] != r[2] for r in a)          # own row never returned


def test_zero_vector_scores_null_and_sorts_last(spark):
    c = _corpus(spark, [("a", [0.0, 0.0]), ("b", [1.0, 0.0]), ("c", [0.0, 1.0]), ("d", None)])
    q = _queries(spark, [("q", [1.0, 0.0])])
    rows = _rows(K.top_k(c, q, 10))
    assert [r[2] for r in rows] == ["b", "c", "a", "d"]
    assert rows[0][3] == 1.0 and rows[1][3] == 0.0
    assert rows[2][3] is None and rows[3][3] is None


def test_zero_query_gives_null_scores(spark):
    c = _corpus(spark, [("a", [1.0, 0.0]), ("b", [0.0, 1.0])])
    rows = _rows(K.top_k(c, _queries(spark, [("q", [0.0, 0.0])]), 2))
    assert [(r[2], r[3]) for r in rows] == [("a", None), ("b", None)]


def test_ties_go_to_lower_id(spark):
    c = _corpus(spark, [("z", [1.0, 1.0]), ("m", [1.0, 1.0]), ("a", [1.0, 1.0]), ("x", [0.0, 1.0])])
    rows = _rows(K.top_k(c, _queries(spark, [("q", [1.0, 1.0])]), 2))
    assert [r[2] for r in rows] == ["a", "m"]


def test_opposite_and_equal_vectors_stay_in_range(spark):
    v = [0.3, -0.7, 0.1]
    c = _corpus(spark, [("eq", v), ("neg", [-x for x in v])])
    rows = _rows(K.top_k(c, _queries(spark, [("q", v)]), 2))
    assert rows[0][2] == "eq" and rows[0][3] == 1.0
    assert rows[1][2] == "neg" and rows[1][3] == -1.0


def test_k_larger_than_corpus_returns_all(spark):
    c = _corpus(spark, [("a", [1.0, 0.0]), ("b", [0.0, 1.0])])
    assert len(_rows(K.top_k(c, _queries(spark, [("q", [1.0, 1.0])]), 50))) == 2


def test_k_below_one_rejected(spark):
    c = _corpus(spark, [("a", [1.0, 0.0])])
    with pytest.raises(ValueError):
        K.top_k(c, _queries(spark, [("q", [1.0, 0.0])]), 0)


def test_empty_corpus_gives_no_hits(spark):
    c = _corpus(spark, [])
    assert K.top_k(c, _queries(spark, [("q", [1.0, 0.0])]), 3).count() == 0


def test_wrong_dimension_fails(spark):
    c = _corpus(spark, [("a", [1.0, 0.0, 0.0])])
    with pytest.raises(Exception):
        K.top_k(c, _queries(spark, [("q", [1.0, 0.0])]), 1).collect()


def test_broadcast_bound_is_enforced(spark):
    c = _corpus(spark, [("a", [1.0, 0.0])])
    q = _queries(spark, [(f"q{i}", [1.0, float(i)]) for i in range(5)])
    with pytest.raises(ValueError):
        K.top_k(c, q, 1, form="broadcast", max_broadcast_queries=3)
    # auto falls back to the blocked form beyond the bound
    assert K.top_k(c, q, 1, max_broadcast_queries=3).count() == 5


def test_properties_prefix_ranks_partitioning(spark):
    vc = TD.vector_corpus(spark, SF_SMALL)
    q = TD.vector_queries(vc)
    k4 = _rows(K.top_k(vc, q, 4, exclude_col="self_id"))
    k5 = _rows(K.top_k(vc, q, 5, exclude_col="self_id"))
    assert set(k4) <= set(k5)
    by_q = {}
    for qid, rk, _, s in k5:
        by_q.setdefault(qid, []).append((rk, s))
    for lst in by_q.values():
        assert [r for r, _ in lst] == list(range(1, len(lst) + 1))
        assert all(-1 <= s <= 1 for _, s in lst)
    again = _rows(K.top_k(vc.repartition(7), q.repartition(3), 5, exclude_col="self_id"))
    assert again == k5


def test_plan_has_partial_limit_and_no_pair_join(spark):
    vc = TD.vector_corpus(spark, SF_SMALL)
    plan = plan_text(K.top_k(vc, TD.vector_queries(vc), 5, exclude_col="self_id"))
    assert "WindowGroupLimit" in plan and "MapInArrow" in plan
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_variants_shape(spark):
    from ragloom.sources.testdata import eval_questions, qa_corpus
    corpus = qa_corpus(spark, SF_SMALL)
    q = eval_questions(corpus).withColumn("self_id", F.col("qid"))
    assert K.search_ranked(corpus, q, 5, exclude_col="self_id").columns == \
        ["qid", "rank", "id", "score", "Q", "A"]
    assert K.search_no_id(corpus, q, 3, exclude_col="self_id").columns == \
        ["qid", "rk", "input", "output", "score"]
    assert K.search_no_score(corpus, q, 4, exclude_col="self_id").columns == ["qid", "rk", "input", "output"]
    per_k = K.search_per_question_k(corpus, q.withColumn("k", F.lit(None).cast("int")), default_k=2,
                                    exclude_col="self_id")
    assert per_k.groupBy("qid").count().where("count > 2").count() == 0


def test_scan_blocks_form_agrees(spark):
    vc = TD.vector_corpus(spark, SF_SMALL)
    q = TD.vector_queries(vc)
    a = _rows(K.top_k(vc, q, 5, exclude_col="self_id", form="broadcast"))
    b = _rows(K.top_k(vc, q, 5, exclude_col="self_id", form="scan_blocks", max_broadcast_queries=150))
    assert a == b


def test_two_level_merge_for_wide_scans(spark):
    vc = TD.vector_corpus(spark, SF_SMALL)
    q = TD.vector_queries(TD.vector_corpus(spark, SF_SMALL)).limit(7)
    assert scan_tasks(vc) >= 1
    one = K.top_k(vc, q, 5, exclude_col="self_id")
    two = K.top_k(vc, q, 5, exclude_col="self_id", merge_fanin=1)
    plan = plan_text(two)
    assert plan.count("WindowGroupLimit") >= 3
    assert _rows(one) == _rows(two)


@pytest.mark.parametrize("form", ["broadcast", "blocked", "scan_blocks"])
def test_late_payload_equals_carried(spark, form):
    """Payload fetched after the merge = payload carried through it, in every form."""
    corpus = TD.qa_corpus(spark, SF_SMALL)
    q = TD.eval_questions(corpus).withColumn("self_id", F.col("qid"))
    kw = {"blocked": dict(corpus_block_rows=8, query_block_rows=8),
          "scan_blocks": dict(max_broadcast_queries=20)}.get(form, {})

    def rows(late):
        df = K.top_k(corpus, q, 3, exclude_col="self_id", payload=["input", "output"], form=form,
                     late_payload=late, **kw)
        assert df.columns == ["qid", "rk", "id", "score", "input", "output"]
        return sorted((r.qid, r.rk, r.id, round(r.score, 9), r.input, r.output) for r in df.collect())

    carried, late = rows(False), rows(True)
    assert carried == late and len(late) == 3 * corpus.count()


def test_late_payload_decision():
    assert not K._late(None, [], 10 ** 6, 10 ** 4, 5)            # nothing to carry
    assert not K._late(None, ["input"], None, 10 ** 4, 5)        # size unknown: carry
    assert not K._late(None, ["input"], 8, 2000, 5)              # small scan: carry
    assert K._late(None, ["input"], 800_000, 20_000, 5)          # wide scan: fetch after merge
    assert K._late(True, ["input"], 1, 1, 1) and not K._late(False, ["input"], 10 ** 6, 10 ** 6, 5)


from hypothesis import HealthCheck, given, settings  # noqa: E402
from hypothesis import strategies as st  # noqa: E402

_small_vec = st.lists(st.integers(-2, 2).map(float), min_size=3, max_size=3)


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(corpus=st.lists(st.one_of(st.none(), _small_vec), min_size=0, max_size=25),
       queries=st.lists(st.tuples(st.integers(0, 30), _small_vec), min_size=1, max_size=6,
                        unique_by=lambda t: t[0]),
       k=st.integers(1, 6), exclude=st.booleans(),
       form=st.sampled_from(["broadcast", "blocked"]))
def test_property_equals_brute_force(spark, corpus, queries, k, exclude, form):
    """Random integer vectors (exact ties, zero and null vectors), optional own-row exclusion."""
    crow = [(f"c{i:02d}", v) for i, v in enumerate(corpus)]
    qrow = [(f"c{i:02d}", v) for i, v in queries]
    qdf = spark.createDataFrame([(q, v, q) for q, v in qrow], "qid string, qvec array<float>, self_id string")
    kw = dict(corpus_block_rows=4, query_block_rows=2) if form == "blocked" else {}
    got = _rows(K.top_k(_corpus(spark, crow), qdf, k, form=form,
                        exclude_col="self_id" if exclude else None, **kw))
    want = [(q, r, c, None if s is None else round(s, 9))
            for q, r, c, s in _brute(crow, qrow, k, exclude=exclude)]
    assert got == sorted(want, key=lambda t: (t[0], t[1]))


def test_one_question_at_a_time_equals_batched(spark):
    """Differential: R01 asked per question (the reference's loop) = R05 for all at once."""
    vc = TD.vector_corpus(spark, SF_SMALL)
    q = TD.vector_queries(vc)
    picked = [r.qid for r in q.select("qid").orderBy("qid").limit(5).collect()]
    batched = [t for t in _rows(K.top_k(vc, q, 5, exclude_col="self_id")) if t[0] in picked]
    single = []
    for qid in picked:
        one = q.where(F.col("qid") == qid)
        hits = K.search_ranked(vc.withColumn("input", F.lit("")).withColumn("output", F.lit("")),
                               one, 5, exclude_col="self_id")
        single += [(r.qid, r.rank, r.id, round(r.score, 9)) for r in hits.orderBy("rank").collect()]
    assert single == batched and len(single) == 25


def test_question_sets_over_the_byte_bound_at_1536_dimensions(spark):
    """Every form answers, and answers the same, when the question matrix exceeds the byte bound."""
    rng = np.random.default_rng(5)
    dim = 1536
    corpus = spark.createDataFrame([(i, rng.normal(size=dim).tolist()) for i in range(120)],
                                   "id long, embedding array<double>")
    q = spark.createDataFrame([(i, rng.normal(size=dim).tolist()) for i in range(40)], "qid long, qvec array<double>")
    want = _rows(K.top_k(corpus, q, 3, form="broadcast"))
    small = 10 * 8 * dim
    for form in ("auto", "scan_blocks", "blocked"):
        got = _rows(K.top_k(corpus, q, 3, form=form, max_broadcast_bytes=small, query_block_rows=7,
                            corpus_block_rows=50))
        assert got == want
    big = corpus.unionByName(corpus.withColumn("id", F.col("id") + 1000)).unionByName(
        corpus.withColumn("id", F.col("id") + 2000)).unionByName(corpus.withColumn("id", F.col("id") + 3000))
    assert _rows(K.top_k(big, q, 3, form="auto", max_broadcast_bytes=small)) == _rows(K.top_k(big, q, 3))


@pytest.mark.parametrize("aqe", ["true", "false"])
def test_tiles_equal_the_broadcast_form_for_any_partitioning(spark, aqe):
    """One tile key of one type on both sides: no question is lost however the tiles are dealt."""
    rng = np.random.default_rng(9)
    rows = [(1 if i % 3 == 0 else i, rng.normal(size=16).tolist(), f"t{i}") for i in range(400)]    # one hot id
    rows += [(None, rng.normal(size=16).tolist(), "no id"), (7, None, "no vector")]
    corpus = spark.createDataFrame(rows, "id long, embedding array<double>, t string")
    q = spark.createDataFrame([(i % 90, rng.normal(size=16).tolist(), i) for i in range(100)][:90],
                              "qid long, qvec array<double>, self_id long")

    def hits(**kw):
        got = K.top_k(corpus, q, 5, payload=["t"], exclude_col="self_id", **kw).collect()
        return sorted((r.qid, r.rk, r.id, round(r.score, 9), r.t) for r in got)

    want = hits(form="broadcast")
    assert len(want) == 450
    before = {c: spark.conf.get(c) for c in ("spark.sql.adaptive.enabled", "spark.sql.shuffle.partitions")}
    try:
        spark.conf.set("spark.sql.adaptive.enabled", aqe)
        for partitions in (1, 7, 211) if aqe == "true" else (1, 13):
            spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
            assert hits(form="blocked", tile_bytes=16 * 8 * 60) == want
    finally:
        for c, v in before.items():
            spark.conf.set(c, v)


def test_blocks_are_sized_by_bytes_and_rows():
    assert K._block_count(1000, 1536, 10**9, 1 << 20) == -(-12 * 1000 // (10 * ((1 << 20) // (8 * 1536 + 64))))
    assert K._block_count(1000, 4, 100, 1 << 30) == 12
    assert K._block_count(0, 0, 100, 1 << 30) == 1 and K._block_count(10, 10**6, 100, 1) == 12


def test_repeated_and_null_ids_keep_their_payload(spark):
    corpus = spark.createDataFrame([(1, [1.0, 0.0], "a"), (1, [1.0, 0.0], "b"), (1, [0.9, 0.1], "c"), (None, [1.0, 0.1], "n"),
                                    (None, [1.0, 0.1], None), (2, [0.0, 1.0], "d")],
                                   "id long, embedding array<double>, t string")
    q = spark.createDataFrame([(7, [1.0, 0.0], 1), (8, [1.0, 0.0], None), (9, [1.0, 0.0], 1)],
                              "qid long, qvec array<double>, self_id long")

    def rows(**kw):
        got = K.top_k(corpus.coalesce(1), q, 4, payload=["t"], **kw).collect()
        return sorted((r.qid, r.id or 0, round(r.score, 9), r.t or "") for r in got)

    carried = rows(late_payload=False)
    assert len(carried) == 12 and carried == rows(late_payload=True)
    excluded = rows(late_payload=False, exclude_col="self_id")
    assert [r[0] for r in excluded].count(7) == 3 and [r[0] for r in excluded].count(8) == 4
    assert not any(r[0] in (7, 9) and r[1] == 1 for r in excluded)
    assert excluded == rows(late_payload=True, exclude_col="self_id")


def test_all_null_scores_and_ties(spark):
    corpus = spark.createDataFrame([(i, [0.0, 0.0]) for i in range(30)], "id long, embedding array<double>")
    q = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0])], "qid long, qvec array<double>")
    for form in ("broadcast", "blocked", "scan_blocks"):
        got = K.top_k(corpus, q, 4, form=form).collect()
        assert sorted((r.qid, r.rk, r.id, r.score) for r in got) == [
            (x, i + 1, i, None) for x in (1, 2) for i in range(4)]


def test_per_question_k_is_met_in_full(spark):
    corpus = spark.createDataFrame([(i, [1.0, float(i)], f"o{i}") for i in range(20)],
                                   "id long, embedding array<double>, output string")
    q = spark.createDataFrame([(1, [1.0, 0.0], 8), (2, [1.0, 0.0], None), (3, [1.0, 0.0], 50)],
                              "qid long, qvec array<double>, k int")
    got = K.search_per_question_k(corpus, q, default_k=3).groupBy("qid").count().collect()
    assert {r["qid"]: r["count"] for r in got} == {1: 8, 2: 3, 3: 20}
    with pytest.raises(ValueError):
        K.search_per_question_k(corpus, q.withColumn("k", F.lit(0)))


def _plain_top(c, q, ids, excl, k):
    out = []
    for qi in range(len(q)):
        best = []
        for ri in range(len(c)):
            if excl[qi] is not None and excl[qi] == ids[ri]:
                continue
            d = float(np.sqrt((c[ri] @ c[ri]) * (q[qi] @ q[qi])))
            s = float(np.clip((c[ri] @ q[qi]) / d, -1, 1)) if d > 0 else None
            best.append((s is None, -(s or 0.0), ids[ri], s))
        out += [(qi, b[2], b[3]) for b in sorted(best, key=lambda b: b[:3])[:k]]
    return out


@pytest.mark.filterwarnings("ignore:overflow")
@pytest.mark.parametrize("kind", ["counts", "floats", "same", "tiny", "huge", "zeros"])
@pytest.mark.parametrize("k", [1, 4, 40])
def test_float32_filter_keeps_the_exact_first_k(kind, k, monkeypatch):
    """Score blocks in float32 lose no hit, whatever the sizes of vectors and blocks, also among ties and copies."""
    import pyarrow as pa
    monkeypatch.setattr(K, "BLOCK_ROWS", 16)
    monkeypatch.setattr(K, "BLOCK_QUESTIONS", 5)
    monkeypatch.setattr(K, "PAIR_PIECE", 64)
    rng = np.random.default_rng(7)
    c, q = rng.poisson(0.4, (90, 8)).astype(float), rng.poisson(0.4, (13, 8)).astype(float)
    if kind == "floats":
        c, q = rng.normal(size=c.shape), rng.normal(size=q.shape)
        c[40:60] = c[40] + 1e-9 * rng.normal(size=(20, 8))        # nearer to each other than float32 can tell
        q[:4] = c[40]
    elif kind == "same":
        c[:], q[:] = 1.0, 2.0
    elif kind in ("tiny", "huge"):
        c[::3] *= 2.0 ** -400 if kind == "tiny" else 2.0 ** 400
        q[::4] *= 2.0 ** -266 if kind == "tiny" else 2.0 ** 266
    elif kind == "zeros":
        c[::2], q[::3] = 0.0, 0.0
    ids = [f"d{i:03d}" for i in rng.permutation(90)]
    excl = [None if i % 3 == 0 else ids[i] for i in range(13)]
    vecs = pa.array(c.tolist(), pa.list_(pa.float64()))
    tbl = pa.table({"id": ids, "embedding": vecs})
    for blocks in ([tbl], [tbl.slice(0, 7), tbl.slice(7, 50), tbl.slice(57)]):
        out, _ = K._local_topk(blocks, "id", "embedding", ["id"], q, pa.array(range(13)), excl, 8, k)
        score = [None if np.isnan(s) else s for s in out.column(K._SCORE).to_pylist()]
        got = list(zip(out.column(K._QI).to_pylist(), out.column("id").to_pylist(), score, strict=True))
        want = _plain_top(c, q, ids, excl, k)
        if kind == "floats":          # sums of products may differ in the last bit
            assert [g[2] for g in got] == pytest.approx([w[2] for w in want], abs=1e-12)
            assert [g[0] for g in got] == [w[0] for w in want]
        else:
            assert [g[:2] for g in got] == [w[:2] for w in want]
            assert [g[2] for g in got] == pytest.approx([w[2] for w in want], abs=1e-12)


def test_tiles_stay_few_as_the_tables_grow():
    """Small tiles hold for small tables only: rows are not sent once per 100 rows of the other side."""
    small = K._tiles(2000, 2000, 64, K.CORPUS_BLOCK_ROWS, K.QUERY_BLOCK_ROWS, 64 << 10, 48)
    assert small == (16, 16)
    for n in (120_000, 720_000, 7_200_000):
        cb, qb = K._tiles(n, n, 64, K.CORPUS_BLOCK_ROWS, K.QUERY_BLOCK_ROWS, 64 << 10, 48)
        assert cb <= max(16, 1.3 * n / K.CORPUS_BLOCK_ROWS) and qb <= max(16, 1.3 * n / K.QUERY_BLOCK_ROWS)
        assert n / cb * 64 * 8 <= K.TILE_BYTES and n / qb * 64 * 8 <= K.TILE_BYTES
    # enough tiles for the cores, and the given bounds where they need few blocks
    assert K._tiles(20_000, 130_000, 64, 50_000, 32_768, K.TILE_BYTES, 48) == (1, 40)
    assert K._tiles(100, 100, 4, 50, 25, K.TILE_BYTES, 1) == (3, 5)


def test_tiles_are_not_gathered_into_few_tasks(spark):
    """However few bytes they have: a tile's work is its pairs."""
    rows = [(i, [float(i % 7 + 1), float(i % 5), 1.0]) for i in range(200)]
    vc = spark.createDataFrame(rows, "id long, embedding array<double>")
    q = vc.selectExpr("id as qid", "embedding as qvec")
    schema = K._local_schema(vc, q, "qid", "id", [])
    tiles = K._blocked_form(vc, q, schema, "qid", "qvec", "id", "embedding", None, [], 3, 50, 20, K.TILE_BYTES)
    assert tiles.rdd.getNumPartitions() == 5 * 12
